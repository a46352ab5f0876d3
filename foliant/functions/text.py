"""Column expressions for text: folding, tokens, cleaning and framing. All run in the JVM."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters of the blocks that hold cased or accented letters.
_FOLD_RANGE = range(0x80, 0x2000)


def _fold_char(ch: str) -> str:
    """Case-folded letter without its accent, if it has exactly one on a basic Latin letter."""
    parts = unicodedata.normalize("NFD", ch)
    if len(parts) == 2 and parts[0].isascii() and parts[0].isalpha():
        return parts[0].lower()
    folded = ch.casefold() if ch.isalpha() else ch
    return folded if len(folded) == 1 else ch


@lru_cache(maxsize=1)
def fold_map() -> tuple[str, str, str]:
    """(characters, their folded form, accents to delete), derived from the Unicode tables.

    Only accents that occur in such a single-accent letter are deleted; other
    combining marks separate words. Sources are single lower-case characters, so the
    two strings always line up.
    """
    source, target, marks = [], [], set()
    for code in _FOLD_RANGE:
        ch = chr(code)
        parts = unicodedata.normalize("NFD", ch)
        if len(parts) == 2 and parts[0].isascii() and parts[0].isalpha():
            marks.add(parts[1])
        to = _fold_char(ch)
        if to != ch and ch == ch.lower():
            source.append(ch)
            target.append(to)
    return "".join(source), "".join(target), "".join(sorted(marks))


def fold(c: Column) -> Column:
    source, target, marks = fold_map()
    return F.translate(F.lower(c), source + marks, target)


SEPARATORS = r"[^\p{L}\p{N}\p{Co}]+"


def tokens(c: Column) -> Column:
    """Words of a text: lower case, accents folded, cut at all but letters, numbers and private use."""
    words = F.split(fold(F.coalesce(c, F.lit(""))), SEPARATORS)
    return F.filter(words, lambda w: w != F.lit(""))


# All characters of Unicode that are white space, and the four separators that Python counts as such.
WHITE = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    """Trim every kind of white space on both ends, not only blanks."""
    return F.trim(c, F.lit(WHITE))  # looks at the ends only, where a pattern would try every gap of a long text


def is_blank(c: Column) -> Column:
    return ~F.coalesce(c, F.lit("")).rlike(r"(?U)[^\s\x{1c}-\x{1f}]")  # looks no further than the first other character


def clean_query(c: Column) -> Column:
    """Keep ASCII letters, digits, white space and ``*``, then trim."""
    return strip(F.regexp_replace(c, r"(?U)[^a-zA-Z0-9\s*]", ""))


def command_name(c: Column) -> Column:
    return F.lower(F.split(strip(c), " ", 2)[0])


def command_args(c: Column) -> Column:
    return F.coalesce(F.get(F.split(strip(c), " ", 2), F.lit(1)), F.lit(""))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]*>", "")


# Character entities of escaped markup.
HTML_ENTITIES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&#39;"), ('"', "&#34;")]


def escape_html(c: Column) -> Column:
    out = F.coalesce(c, F.lit(""))
    for raw, entity in HTML_ENTITIES:
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


def unquote_value(c: Column) -> Column:
    """Value of an SQL literal as text: NULL is empty, one pair of quotes goes, escapes are resolved."""
    v = strip(c)
    n = F.length(v)
    first, last = F.substring(v, 1, 1), F.substring(v, -1, 1)
    quoted = (first == last) & first.isin("'", '"')
    # a lone quote character counts as a pair around nothing
    inner = F.when(quoted, F.substring(v, F.lit(2), F.greatest(n - 2, F.lit(0)))).otherwise(v)
    for escaped, plain in [("\\'", "'"), ('\\"', '"'), ("\\\\", "\\")]:
        inner = F.replace(inner, F.lit(escaped), F.lit(plain))
    return F.when((n <= 4) & (F.upper(v) == "NULL"), F.lit("")).otherwise(inner)


def quote_value(c: Column) -> Column:
    """SQL literal that ``unquote_value`` reads back."""
    out = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("'"), F.lit("\\'"))
    return F.when(c.isNull(), F.lit("NULL")).otherwise(F.concat(F.lit("'"), out, F.lit("'")))


def slug(c: Column) -> Column:
    return F.regexp_replace(c, "[^a-zA-Z0-9_]", "")


def sse_escape(c: Column) -> Column:
    return F.replace(c, F.lit("\n"), F.lit("\\n"))


def sse_unescape(c: Column) -> Column:
    return F.replace(c, F.lit("\\n"), F.lit("\n"))


def build_prompt(context: Column, prompt: Column) -> Column:
    with_context = F.concat(F.lit("CONTEXT:\n"), context, F.lit("\n\nQUESTION: "), prompt)
    return F.when(F.coalesce(context, F.lit("")) != "", with_context).otherwise(prompt)


def rebase_path(c: Column, prefix: str = "static/") -> Column:
    """Remove a leading folder once."""
    return F.when(F.startswith(c, F.lit(prefix)), F.substring(c, F.lit(len(prefix) + 1), F.length(c))).otherwise(c)


def preview(c: Column, length: int = 250, leeway: int = 5, end: str = "...") -> Column:
    """First characters of a text, cut back to a whole word; slightly longer texts stay whole."""
    head = F.substring(c, 1, length - len(end))
    at_word = F.regexp_replace(head, r"(?s)^(.*) [^ ]*$", "$1")
    return F.when(F.length(c) <= length + leeway, c).otherwise(F.concat(at_word, F.lit(end)))


def contact_parts(c: Column) -> Column:
    """{email, message, accepted}: first word and the cleaned rest; one word alone is rejected."""
    parts = F.split(c, " ", 2)
    ok = F.size(parts) == 2
    return F.struct(
        F.when(ok, parts[0]).alias("email"),
        F.when(ok, strip_tags(F.get(parts, F.lit(1)))).alias("message"),
        ok.alias("accepted"),
    )
