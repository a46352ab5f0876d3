"""What a user types as a query, as the fields of a query row.

``a b`` asks for both words, ``"a b"`` for the phrase, ``a*`` for words that begin so, ``a OR b OR c`` for at least one of
the words and ``a NOT b`` for the first without the second. Operators are upper case and stand between words; any other
mark only parts words. Other mixtures of operators are read item by item: words beside an OR form one choice.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.text import tokens

OPERATORS = ["AND", "OR", "NOT"]


def query_fields(text: Column) -> dict[str, Column]:
    """must, should, must_not, phrases and prefixes of a query text, for ``queries_of``."""
    items = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r'("[^"]*"?|[^\s"]+)'))
    marked = F.transform(
        items,
        lambda item, i: F.struct(
            item.alias("item"),
            F.when(i > 0, F.get(items, i - 1)).alias("before"),
            F.get(items, i + 1).alias("after"),
        ),
    )
    asked = F.filter(marked, lambda m: ~m["item"].isin(OPERATORS))

    def words(chosen: Column) -> Column:
        return F.flatten(F.transform(chosen, lambda m: tokens(m["item"])))

    quoted = lambda m: F.startswith(m["item"], F.lit('"'))
    begun = lambda m: ~quoted(m) & F.endswith(m["item"], F.lit("*"))
    plain = lambda m: ~quoted(m) & ~begun(m)
    refused = lambda m: F.coalesce(m["before"] == "NOT", F.lit(False))
    choice = lambda m: F.coalesce((m["before"] == "OR") | (m["after"] == "OR"), F.lit(False))
    lists = lambda keep: F.filter(F.transform(F.filter(asked, keep), lambda m: tokens(m["item"])), lambda w: F.size(w) > 0)
    return {
        "must": words(F.filter(asked, lambda m: plain(m) & ~refused(m) & ~choice(m))),
        "should": words(F.filter(asked, lambda m: plain(m) & ~refused(m) & choice(m))),
        "must_not": words(F.filter(asked, lambda m: plain(m) & refused(m))),
        "phrases": lists(quoted),
        "prefixes": F.transform(lists(begun), lambda w: F.element_at(w, -1)),
    }
