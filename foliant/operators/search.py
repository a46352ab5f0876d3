"""Batches of full-text queries over an index.

A query row is (query_id, must, should, must_not, phrase, prefix, phrases, prefixes, columns): arrays of words, except for the
prefix, the array of phrases and the names of the columns to search, and all but the id may be NULL. A page matches if it has
all of ``must``, every phrase and every prefix, at least one of ``should`` if there are any, and none of ``must_not``. A query
with nothing but ``must_not``, or with nothing at all, matches no page.

A page with several columns is searched in all of them, or in those that the query names: words may stand in different
columns, a phrase stands in one. Occurrences in all searched columns count together, the length is the whole page's.

Each query becomes scoring units (a word, a phrase or a prefix). Hits of all units are found by joining the
postings to the wanted words; one aggregate by (query, page) then tests the boolean rule and adds up
the score, so AND, OR and NOT cost the same single shuffle. Phrases read pair postings for neighbouring frequent words, and
of several pieces the rarest decides which pages the others are read for. A ranked search over many hits looks at the blocks of
pages that may score best first, and then only at blocks that can still beat what was found.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions.scoring import bm25_term, idf
from foliant.functions.text import fold, is_blank
from foliant.operators.snippets import fragments, placed_words
from foliant.plans.sizing import BROADCAST_ROWS, inlined, is_small, lookup_join, written
from foliant.sources.index import PAGE, Index, block_of

QUERY_SCHEMA = (
    "query_id bigint, must array<string>, should array<string>, "
    "must_not array<string>, phrase array<string>, prefix string, phrases array<array<string>>, prefixes array<string>, "
    "columns array<string>"
)
FIELDS = {
    "must": "array<string>",
    "should": "array<string>",
    "must_not": "array<string>",
    "phrase": "array<string>",
    "prefix": "string",
    "phrases": "array<array<string>>",
    "prefixes": "array<string>",
    "columns": "array<string>",
}


def queries_of(df: DataFrame, **fields: Column) -> DataFrame:
    """Query table from columns of ``df``; fields that are not given are NULL."""
    rest = {n: F.lit(None) for n in FIELDS if n not in fields}
    cols = {**fields, **rest}
    return df.select("query_id", *[cols[n].cast(t).alias(n) for n, t in FIELDS.items()])


def skip_empty(queries: DataFrame, text: str) -> DataFrame:
    return queries.where(~is_blank(F.col(text)))


def query_units(queries: DataFrame) -> DataFrame:
    """(query_id, unit, role, kind, words, need_all, need_any, columns): roles are all, any and none.

    need_all and need_any say how many units of role all, and whether one of role any, the query asks for.
    """

    def word_units(field: str, role: str) -> Column:
        words = F.coalesce(F.col(field), F.array().cast("array<string>"))
        return F.transform(
            words,
            lambda w, i: F.struct(
                F.concat(F.lit(f"{field}-"), i.cast("string")).alias("unit"),
                F.lit(role).alias("role"),
                F.lit("word").alias("kind"),
                F.array(fold(w)).alias("words"),
            ),
        )

    def all_units(kind: str, wanted: Column) -> Column:
        """One unit for each list of words that is not empty."""
        return F.transform(
            F.filter(wanted, lambda ws: F.coalesce(F.length(F.array_join(ws, "")), F.lit(0)) > 0),
            lambda ws, i: F.struct(
                F.concat(F.lit(f"{kind}-"), i.cast("string")).alias("unit"),
                F.lit("all").alias("role"),
                F.lit(kind).alias("kind"),
                F.transform(ws, fold).alias("words"),
            ),
        )

    phrases = F.concat(F.array("phrase"), F.coalesce("phrases", F.array().cast("array<array<string>>")))
    prefixes = F.concat(F.array("prefix"), F.coalesce("prefixes", F.array().cast("array<string>")))
    units = F.concat(
        word_units("must", "all"),
        word_units("should", "any"),
        word_units("must_not", "none"),
        all_units("phrase", phrases),
        all_units("prefix", F.transform(prefixes, lambda p: F.array(p))),
    )
    listed = queries.select("query_id", "columns", units.alias("_units"))
    required = F.size(F.filter("_units", lambda u: u["role"] == "all"))
    any_of = F.exists("_units", lambda u: u["role"] == "any")
    return listed.select(
        "query_id", F.explode("_units").alias("u"), required.alias("need_all"), any_of.alias("need_any"), "columns"
    ).select("query_id", "u.*", "need_all", "need_any", "columns")


OF_UNIT = ["query_id", "unit", "role", "need_all", "need_any"]
UNITS_INLINE = 10_000
TERMS_PUSHED = 1_000
PREFIXES_PUSHED = 16
PRUNE_HITS = 5_000_000  # postings of a batch from which a ranked search looks at bounds first
LEAD_HITS = 1_000_000  # hits of a batch that must be saved for required words to be looked for on the rarest one's pages only
ROWS_OF_TASK = 1 << 20  # rows that are dealt by page and added up in one task, on average
ROWS_FOR_ALIKE = 1 << 23  # rows that one task makes of hits that go to many queries alike, on average
ALIKE_ROWS = 1_000_000  # queries of a large batch that go to every task
FIRST_PAGES = 20  # pages per wanted one in the blocks that are looked at first


@dataclass(frozen=True)
class Units:
    """Scoring units of a batch; ``rows`` are the units themselves if there are few."""

    df: DataFrame
    rows: list | None

    @classmethod
    def of(cls, queries: DataFrame) -> "Units":
        return cls(*inlined(query_units(queries), UNITS_INLINE))

    @property
    def bound(self) -> DataFrame | int:
        return self.df if self.rows is None else len(self.rows)

    def kinds(self) -> set[str]:
        rows = self.df.select("kind").distinct().collect() if self.rows is None else self.rows
        return {r["kind"] for r in rows}

    def of_kind(self, kind: str) -> DataFrame:
        return self.df.where(F.col("kind") == kind)

    def whole_and_chosen(self) -> tuple["Units | None", "Units | None"]:
        """Units that search all columns, and those that search chosen ones; None where there are none."""
        parts = []
        for condition, chosen in (("columns IS NULL", False), ("columns IS NOT NULL", True)):
            rows = None if self.rows is None else [r for r in self.rows if (r["columns"] is not None) == chosen]
            df = self.df.where(condition)
            parts.append(None if rows == [] else Units(df, rows))
        return parts[0], parts[1]

    def within(self, blocks: DataFrame | None) -> "Units":
        """The units with the blocks of pages to which each query is limited; ``blocks``: (query_id, blocks)."""
        if blocks is None:
            return Units(self.df.withColumn("blocks", F.lit(None).cast("array<int>")), self.rows)
        return Units(lookup_join(self.df, blocks, ["query_id"], bounded_by=self.bound), self.rows)

    def words(self, kind: str) -> list[str] | None:
        """Different words of one kind of unit, if few enough to be pushed into scans."""
        if self.rows is None:
            return None
        found = {w for r in self.rows if r["kind"] == kind for w in r["words"]}
        return sorted(found) if len(found) <= TERMS_PUSHED else None

    def prefix_lengths(self) -> list[int]:
        if self.rows is not None:
            return sorted({len(r["words"][0]) for r in self.rows if r["kind"] == "prefix"})
        lengths = self.of_kind("prefix").select(F.length(F.col("words")[0]).alias("n"))
        return [r["n"] for r in lengths.distinct().collect()]


def _under_prefixes(table: DataFrame, units: Units, wanted: DataFrame) -> DataFrame:
    """Rows of a term-keyed table joined to the wanted prefixes (``_prefix``) that their word starts with.

    A word is offered under those of its beginnings that have the length of a wanted prefix, so
    the match is an equi-join; a handful of prefixes is also pushed into the scan.
    """
    known = units.words("prefix")
    if known and len(known) <= PREFIXES_PUSHED:
        starts = [F.startswith("term", F.lit(p)) for p in known]
        table = table.where(reduce(lambda a, b: a | b, starts))
    beginnings = [
        F.when(F.length("term") >= n, F.substring("term", 1, n)) for n in units.prefix_lengths()
    ]
    offered = table.withColumn("_prefix", F.explode(F.array(*beginnings)))
    return lookup_join(
        offered, wanted, ["_prefix"], spread_by=["term"], bounded_by=units.bound
    ).drop("_prefix")


HIT = [*OF_UNIT, *PAGE, "tf", "dl", "n_columns"]
AT_PAGE = [*OF_UNIT, *PAGE]
LIMITS = ["columns", "blocks"]


def _allowed(index: Index, found: DataFrame) -> DataFrame:
    """Postings in the columns and blocks that their unit asks for."""
    names = F.array(*[F.lit(c) for c in index.columns])
    chosen = F.col("columns").isNull() | F.array_contains("columns", F.get(names, F.col("column_id")))
    near = F.col("blocks").isNull() | F.array_contains("blocks", block_of(F.col("dl")))
    return found.where(chosen & near).drop(*LIMITS)


def _by_page(index: Index, found: DataFrame, keys: list[str]) -> DataFrame:
    """Hits of a unit in all columns of a page as one."""
    if len(index.columns) == 1:
        return found.select(*keys, "tf", "dl", F.lit(1).alias("n_columns"))
    return found.groupBy(*keys).agg(
        F.sum("tf").cast("int").alias("tf"), F.first("dl").alias("dl"), F.count(F.lit(1)).cast("int").alias("n_columns")
    )


def _word_hits(index: Index, units: Units) -> DataFrame:
    whole, chosen = units.whole_and_chosen()
    parts = []
    for some in (whole, chosen):
        if some is None:
            continue
        words = some.of_kind("word").select(*OF_UNIT, *LIMITS, F.col("words")[0].alias("term"))
        known = some.words("word")
        postings = index.postings.drop("positions", "leads")
        leading = _leading(index, some, words, known) if some is whole else []
        if leading:
            schema = f"query_id {words.schema['query_id'].dataType.simpleString()}, unit string, _leads boolean"
            led = F.broadcast(index.spark.createDataFrame(leading, schema))
            marked = written(words.join(led, ["query_id", "unit"], "left"), "led-words")
            of_lead = index.lookup(postings, marked.where("coalesce(_leads, true)").drop("_leads"), known)
            hits = written(_by_page(index, _allowed(index, of_lead), [*AT_PAGE, "term"]), "lead-hits")
            leads = hits.join(led.where("_leads"), ["query_id", "unit"], "left_semi").select("query_id", *PAGE)
            needed = leads.join(F.broadcast(marked.where("NOT _leads").drop(*LIMITS, "_leads")), "query_id")
            terms = words.select("term").distinct()
            wanted = index.lookup(postings.select("bucket", "term", "column_id", *PAGE, "tf", "dl"), terms, known).drop("bucket")
            others = _by_page(index, lookup_join(wanted, needed, ["term", *PAGE], salts=1), [*AT_PAGE, "term"])
            hits = hits.unionByName(others.select(*hits.columns))
        else:
            found = _allowed(index, index.lookup(postings, words, known))
            hits = _by_page(index, found, [*AT_PAGE, "term"])
        if some is chosen:
            parts.append(_with_df(hits.drop("term"), some))
            continue
        if known is None:
            dfs = index.lookup(index.vocab, words.select("term").distinct(), None).select("term", "df")
        else:
            dfs = index.vocab.where(F.col("term").isin(known)).select("term", "df")
        parts.append(lookup_join(hits.select(*HIT, "term"), dfs, ["term"], spread_by=PAGE, bounded_by=units.bound).drop("term"))
    return reduce(DataFrame.unionByName, parts)


def _leading(index: Index, units: Units, words: DataFrame, known: list[str] | None) -> list[tuple]:
    """(query_id, unit, leads): of queries that require several words, the rarest leads; the others count on its pages only.

    Queries where that saves little, without an id or with a unit that comes twice are left out; the list is empty if all of
    them together have few hits.
    """
    if units.rows is None or index.buckets is None:
        return []
    rows = [r for r in units.rows if r["kind"] == "word" and r["query_id"] is not None and r["columns"] is None]
    twice = {q for (q, _), n in Counter((r["query_id"], r["unit"]) for r in units.rows).items() if n > 1}
    found = index.lookup(index.vocab, words.select("term").distinct(), known).select("term", "df").collect()  # a batch's words at most
    df = {r["term"]: r["df"] for r in found}
    by_query: dict = {}
    for r in rows:
        if r["query_id"] not in twice:
            by_query.setdefault(r["query_id"], []).append(r)
    led, saved = [], 0
    for query_id, of in by_query.items():
        required = [r for r in of if r["role"] == "all"]
        if not required or len(of) < 2:
            continue
        lead = min(required, key=lambda r: (df.get(r["words"][0], 0), r["unit"]))
        least, all_hits = df.get(lead["words"][0], 0), sum(df.get(r["words"][0], 0) for r in of)
        if 2 * least * len(of) < all_hits:
            saved += all_hits - least * len(of)
            led += [(query_id, r["unit"], r is lead) for r in of]
    return led if saved >= LEAD_HITS else []


def _with_df(hits: DataFrame, units: Units) -> DataFrame:
    """Pages by unit, counted from the hits themselves; these are written so as to be found only once."""
    found = written(hits, "hits")
    dfs = found.groupBy("query_id", "unit").agg(F.count(F.lit(1)).alias("df"))
    return lookup_join(found, dfs, ["query_id", "unit"], spread_by=PAGE, bounded_by=units.bound)


def _prefix_hits(index: Index, units: Units) -> tuple[DataFrame, DataFrame, int]:
    """(hits, members, rows): hits (_code, page, tf, dl, n_columns) are to be joined to the members (_code, unit, df), which makes so many rows.

    Hits of a prefix count as those of one word. What several units ask for alike is looked for once and has one code.

    If the prefixes stand for a few words of the corpus, these are looked up like words; else the
    postings themselves are matched by their beginnings. They are dealt by page, so that a task adds up few at a time.
    """
    wanted = units.of_kind("prefix").select(*OF_UNIT, *LIMITS, F.col("words")[0].alias("_prefix"))
    listed = wanted.groupBy(*OF_UNIT).agg(F.sort_array(F.collect_list(F.struct("_prefix", *LIMITS))).alias("_asked"))
    coded = written(listed.select("_asked").distinct().withColumn("_code", F.monotonically_increasing_id()), "prefixes")
    asked = coded.select("_code", F.explode("_asked").alias("_a")).select("_code", "_a.*")
    words, expanded = inlined(_under_prefixes(index.vocab.select("term", "df"), units, asked), TERMS_PUSHED)
    postings = index.postings.drop("positions", "leads")
    if expanded is None:
        found = _under_prefixes(postings, units, asked)
        n_found = words.agg(F.sum("df")).first()[0]
    else:
        found = index.lookup(postings, words.drop("df"), sorted({r["term"] for r in expanded}))
        n_found = sum(r["df"] for r in expanded)
    dealt = _allowed(index, found).select("_code", *PAGE, "column_id", "tf", "dl").repartition(_tasks(index, n_found), *PAGE)
    at_page = ["_code", *PAGE]
    if len(index.columns) > 1:
        dealt = dealt.groupBy(*at_page, "column_id").agg(F.sum("tf").alias("tf"), F.first("dl").alias("dl"))
    hits = dealt.groupBy(*at_page).agg(
        F.sum("tf").cast("int").alias("tf"),
        F.first("dl").alias("dl"),
        (F.count(F.lit(1)).cast("int") if len(index.columns) > 1 else F.first(F.lit(1))).alias("n_columns"),
    )
    hits = written(hits, "prefix-hits")
    pages = hits.groupBy("_code").agg(F.count(F.lit(1)).alias("_pages"))
    of_code = lookup_join(lookup_join(listed, coded, ["_asked"], bounded_by=units.bound), pages, ["_code"], bounded_by=units.bound)
    of_code = written(of_code.select("_code", *OF_UNIT, "_pages"), "of-prefixes")
    dfs = of_code.groupBy("query_id", "unit").agg(F.sum("_pages").alias("df"))
    members = lookup_join(of_code, dfs, ["query_id", "unit"], bounded_by=units.bound).drop("_pages")
    return hits, members, of_code.agg(F.coalesce(F.sum("_pages"), F.lit(0))).first()[0]


def _tasks(index: Index, rows: int | None) -> int:
    """Tasks for so many rows that are dealt by page and added up in each."""
    return max(index.spark.sparkContext.defaultParallelism, ceil((rows or 0) / ROWS_OF_TASK))


IN_COLUMN = [*AT_PAGE, "column_id"]


def _together(pieces: DataFrame) -> DataFrame:
    """Where all pieces of a phrase begin at one place; ``_starts`` are the places of the phrase that a piece allows."""
    by_page = pieces.groupBy(*IN_COLUMN).agg(
        F.first("dl").alias("dl"), F.first("_n").alias("_n"), F.collect_list("_starts").alias("_s")
    )
    # one list for each piece of the phrase, so the collected lists are bounded by the query
    both = F.aggregate(F.slice("_s", F.lit(2), F.size("_s")), F.col("_s")[0], F.array_intersect)
    return by_page.where(F.size("_s") == F.col("_n")).withColumn("tf", F.size(both)).where(F.col("tf") > 0)


def _starts_of() -> Column:
    return F.transform("positions", lambda p: p - F.col("_i")).alias("_starts")


def _starts(index: Index, found: DataFrame) -> DataFrame:
    return _allowed(index, found).select(*IN_COLUMN, "dl", "_n", _starts_of())


def phrase_pieces(words: list[str], frequent: frozenset[str]) -> list[tuple[int, str, bool]]:
    """(place, term, is a pair): pairs of neighbours that are both frequent, and the words that are in no such pair."""
    pairs = [i for i in range(len(words) - 1) if words[i] in frequent and words[i + 1] in frequent]
    covered = {i for i in pairs} | {i + 1 for i in pairs}
    pieces = [(i, f"{words[i]} {words[i + 1]}", True) for i in pairs]
    return sorted(pieces + [(i, w, False) for i, w in enumerate(words) if i not in covered])


def _planned_phrases(index: Index, units: Units) -> DataFrame:
    """Phrases of a batch whose words are known, piece by piece: the rarest piece first, the others only on its pages."""
    rows = {(r["query_id"], r["unit"]): phrase_pieces(list(r["words"]), index.frequent) for r in units.rows if r["kind"] == "phrase"}
    terms = {pair: sorted({t for pieces in rows.values() for _, t, p in pieces if p == pair}) for pair in (False, True)}
    df: dict[tuple[str, bool], int] = {}
    for pair, vocab in ((False, index.vocab), (True, index.pair_vocab)):
        if terms[pair]:  # at most as many rows as the batch has different words
            df |= {(r["term"], pair): r["df"] for r in vocab.where(F.col("term").isin(terms[pair])).select("term", "df").collect()}
    planned = []
    for (query_id, unit), pieces in rows.items():
        if all((t, p) in df for _, t, p in pieces):  # else a piece stands nowhere
            rarest = min(pieces, key=lambda x: (df[x[1], x[2]], x[0]))
            planned += [(query_id, unit, i, t, p, (i, t, p) == rarest, len(pieces)) for i, t, p in pieces]
    spark = index.spark
    schema = f"query_id {units.df.schema['query_id'].dataType.simpleString()}, unit string, _i int, term string, is_pair boolean, is_rarest boolean, _n int"
    plan = spark.createDataFrame(planned, schema)
    wanted = units.of_kind("phrase").select(*OF_UNIT, *LIMITS).join(F.broadcast(plan), ["query_id", "unit"])

    def read(rarest: bool, single: bool) -> DataFrame | None:
        parts = []
        for pair, table in ((False, index.postings), (True, index.pairs)):
            some = sorted({x[3] for x in planned if x[4] == pair and x[5] == rarest and (x[6] == 1) == single})
            if some:
                asked = wanted.where((F.col("is_pair") == pair) & (F.col("is_rarest") == rarest) & ((F.col("_n") == 1) == single))
                found = index.lookup(table.drop("leads"), asked.drop("is_pair", "is_rarest"), some)
                parts.append(_starts(index, found))
        return reduce(DataFrame.unionByName, parts) if parts else None

    hits = []
    alone = read(rarest=True, single=True)
    if alone is not None:
        hits.append(alone.select(*IN_COLUMN, "dl", F.size("_starts").alias("tf")))
    first = read(rarest=True, single=False)
    if first is not None:
        first = written(first, "rarest")
        rest = F.broadcast(plan.where(~F.col("is_rarest")).select("query_id", "unit", "_i", "term", "is_pair"))
        needed = first.select(*IN_COLUMN, "_n").join(rest, ["query_id", "unit"])
        parts = [first]
        for pair, table in ((False, index.postings), (True, index.pairs)):
            some = sorted({x[3] for x in planned if x[4] == pair and not x[5]})
            if some:
                table = index.of_terms(table.select("bucket", "term", *PAGE, "column_id", "dl", "positions"), some)
                # One posting for a place, so the postings are shuffled once however many phrases need them.
                found = lookup_join(table, needed.where(F.col("is_pair") == pair), ["term", *PAGE, "column_id"], salts=1)
                parts.append(found.select(*IN_COLUMN, "dl", "_n", _starts_of()))
        hits.append(_together(reduce(DataFrame.unionByName, parts)).select(*IN_COLUMN, "dl", "tf"))
    if not hits:
        return units.df.limit(0).select(*OF_UNIT, *[F.lit(0).cast(t).alias(n) for n, t in (("doc_id", "bigint"), ("page_num", "int"), ("column_id", "int"), ("dl", "int"), ("tf", "int"))])
    return reduce(DataFrame.unionByName, hits)


def _phrase_hits(index: Index, units: Units) -> DataFrame:
    """Pages where the words follow each other inside a column; tf is the number of places."""
    known = units.words("phrase")
    if known is not None and index.pairs is not None:
        found = _planned_phrases(index, units)
    else:
        words = units.of_kind("phrase").select(
            *OF_UNIT, *LIMITS,
            F.size("words").alias("_n"), F.posexplode("words").alias("_i", "term"),
        )
        found = _together(_starts(index, index.lookup(index.postings.drop("leads"), words, known)))
    return _with_df(_by_page(index, found, AT_PAGE).select(*HIT), units)


FINDERS = {"word": _word_hits, "phrase": _phrase_hits}


def match(index: Index, queries: DataFrame, count_columns: bool = False, digits: int | None = None) -> DataFrame:
    """(query_id, doc_id, page_num, score) of all matching pages.

    ``count_columns`` adds n_column_hits: in how many columns each unit stands, added up over the units. ``digits`` rounds the
    scores. Queries of a large batch that ask for the same are searched once.
    """
    units = Units.of(queries)
    if units.rows is not None:
        found = _rounded(_match(index, units, None), digits)
    else:
        found = _match_alike(index, written(queries.select("query_id", *FIELDS), "queries"), digits)
    return found if count_columns else found.drop("n_column_hits")


def _rounded(hits: DataFrame, digits: int | None) -> DataFrame:
    return hits if digits is None else hits.withColumn("score", F.round("score", digits) + 0.0)  # a rounded negative may be -0.0


def _match_alike(index: Index, queries: DataFrame, digits: int | None) -> DataFrame:
    """Hits of a large batch: one query of each that ask for the same is searched, and its hits go to all of them.

    Hits are dealt to as many tasks as their copies ask for, whatever few bytes the hits themselves are.
    """
    asked = queries.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(*FIELDS))).alias("_asked"))
    asked = asked.withColumn("_no_id", F.col("query_id").isNull())
    # A null id has hits of other kinds than an id with a value, so it stands alone.
    alike = asked.groupBy("_asked", "_no_id").agg(F.min("query_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    alike = written(alike.withColumn("_class", F.monotonically_increasing_id()), "asked-once")
    first = alike.select(F.col("_first").alias("query_id"), F.explode("_asked").alias("_a")).select("query_id", "_a.*")
    same = asked.join(alike.select("_asked", "_no_id", "_class"), ["_asked", "_no_id"])
    members = written(same.select("_class", "query_id"), "alike")
    found = _rounded(_match(index, Units.of(first), None), digits)
    found = found.withColumn("_of", F.struct(F.col("query_id").alias("_first"))).drop("query_id")
    classes = alike.select(F.struct("_first").alias("_of"), "_class", "_n")
    hits = written(lookup_join(found, classes, ["_of"], spread_by=PAGE).drop("_of"), "alike-hits")
    n = hits.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    tasks = max(index.spark.sparkContext.defaultParallelism, ceil(n / ROWS_FOR_ALIKE))
    dealt = hits.drop("_n").repartition(tasks, *PAGE, "_class")
    joined = lookup_join(dealt, members, ["_class"], max_rows=ALIKE_ROWS, spread_by=PAGE)
    return joined.select("query_id", *PAGE, "score", "n_column_hits")


def _hits(index: Index, units: Units, kinds: set[str]) -> DataFrame | None:
    """Hits of all units with their df, or None if there are no units.

    With prefixes all hits are dealt by page, and those of a prefix go to its units there, so that their copies are not shuffled.
    """
    found = [find(index, units).select(*HIT, "df") for kind, find in FINDERS.items() if kind in kinds]
    if "prefix" in kinds:
        coded, members, n = _prefix_hits(index, units)
        if not is_small(members):
            found.append(lookup_join(coded, members, ["_code"], spread_by=PAGE).select(*HIT, "df"))
        else:
            of = [*OF_UNIT, "df"]
            unknown = [F.lit(None).cast(members.schema[c].dataType).alias(c) for c in of]
            coded = coded.select("_code", *PAGE, "tf", "dl", "n_columns", *unknown)
            rows = reduce(DataFrame.unionByName, [coded, *[f.withColumn("_code", F.lit(None).cast("bigint")) for f in found]])
            of_code = members.select("_code", F.struct(*of).alias("_of"))
            given = lookup_join(rows.repartition(_tasks(index, n), *PAGE), of_code, ["_code"], "left")
            given = given.where("_code IS NULL OR _of IS NOT NULL")
            found = [given.select(*PAGE, "tf", "dl", "n_columns", *[F.coalesce(f"_of.{c}", c).alias(c) for c in of])]
    return reduce(DataFrame.unionByName, found) if found else None


def _match(index: Index, units: Units, blocks: DataFrame | None) -> DataFrame:
    kinds = units.kinds()
    units = units.within(blocks)
    hits = _hits(index, units, kinds)
    if hits is None:
        empty = "query_id bigint, doc_id bigint, page_num int, score double, n_column_hits bigint"
        return index.spark.createDataFrame([], empty)
    share = bm25_term(index.n_docs, index.avgdl, F.col("df"), F.col("tf"), F.col("dl"))
    found = (
        hits.withColumn("_share", F.when(F.col("role") != "none", share))
        .groupBy("query_id", *PAGE)
        .agg(
            F.sum("_share").alias("score"),
            F.first("need_all").alias("need_all"),
            F.first("need_any").alias("need_any"),
            F.count_if(F.col("role") == "all").alias("_all"),
            F.count_if(F.col("role") == "any").alias("_any"),
            F.count_if(F.col("role") == "none").alias("_none"),
            F.sum("n_columns").alias("n_column_hits"),
        )
    )
    passed = found.where(
        (F.col("_all") == F.col("need_all"))
        & ((F.col("_any") > 0) | ~F.col("need_any"))
        & (F.col("_none") == 0)
        & (F.col("_all") + F.col("_any") > 0)
    )
    return passed.select("query_id", *PAGE, "score", "n_column_hits")


def _first_k(hits: DataFrame, k: int, order: list[str]) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(*order)
    return hits.withColumn("rank_no", F.row_number().over(w)).where(F.col("rank_no") <= k)


def _bounded(index: Index, units: Units) -> DataFrame:
    """(query_id, block, reach, n): the best score that a page of the block may have, and how many pages may match.

    Blocks where a required word does not occur are left out.
    """
    known = units.words("word")
    words = units.df.select(*OF_UNIT, F.col("words")[0].alias("term"))
    dfs = index.vocab.where(F.col("term").isin(known)).select("term", "df")
    bounds = index.bounds.where(F.col("term").isin(known))
    joined = lookup_join(lookup_join(bounds, words, ["term"], bounded_by=units.bound), dfs, ["term"], bounded_by=units.bound)
    role = F.col("role")
    blocks = joined.groupBy("query_id", "block").agg(
        F.sum(F.when(role != "none", idf(index.n_docs, F.col("df")) * F.col("most"))).alias("reach"),
        F.first("need_all").alias("need_all"),
        F.first("need_any").alias("need_any"),
        F.count_if(role == "all").alias("_all"),
        F.count_if(role == "any").alias("_any"),
        F.min(F.when(role == "all", F.col("n"))).alias("_least"),
        F.max(F.when(role == "any", F.col("n"))).alias("_most"),
    )
    possible = (F.col("_all") == F.col("need_all")) & ((F.col("_any") > 0) | ~F.col("need_any")) & (F.col("_all") + F.col("_any") > 0)
    return blocks.where(possible).select("query_id", "block", "reach", F.coalesce("_least", "_most").alias("n"))


def _pruned(index: Index, units: Units, k: int, prune_hits: int) -> DataFrame | None:
    """All hits that may be among the best ``k`` of a query, or None where pruning does not pay."""
    if index.bounds is None or units.rows is None or units.kinds() != {"word"} or units.words("word") is None:
        return None
    if any(r["columns"] is not None for r in units.rows):  # the bounds are those of all columns
        return None
    words = Counter(w for r in units.rows for w in r["words"])
    pages = index.vocab.where(F.col("term").isin(list(words))).select("term", "df").collect()  # a batch's words at most
    if sum(words[r["term"]] * r["df"] for r in pages) < prune_hits:
        return None
    blocks = written(_bounded(index, units), "reach")
    order = Window.partitionBy("query_id").orderBy(F.desc("reach"), "block")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tried = blocks.withColumn("_first", before < FIRST_PAGES * k)
    listed = lambda df: df.groupBy("query_id").agg(F.collect_list("block").alias("blocks"))  # noqa: E731  a few dozen a query
    first = written(_match(index, units, listed(tried.where("_first"))), "first-hits")
    kth = _first_k(first.withColumn("_order", F.round("score", 9)), k, ["_order", *PAGE])
    kth = kth.where(F.col("rank_no") == k).select("query_id", (-F.col("_order")).alias("kth"))
    left = tried.where("NOT _first").join(kth, "query_id", "left").where("kth IS NULL OR reach >= kth - 1e-6")
    return first.unionByName(_match(index, units, listed(left)))


def search_ranked(index: Index, queries: DataFrame, k: int = 5, prune_hits: int = PRUNE_HITS) -> DataFrame:
    """Best ``k`` pages by query. Each task keeps its own best ``k`` before the shuffle by query.

    A batch of words with ``prune_hits`` postings or more is searched block by block.
    """
    units = Units.of(queries)
    hits = _pruned(index, units, k, prune_hits)
    if hits is None:
        hits = _match(index, units, None)
    scored = hits.drop("n_column_hits").withColumn("_order", F.round("score", 9))
    return _first_k(scored, k, ["_order", *PAGE]).drop("_order")


def search_first_n(index: Index, queries: DataFrame, n: int = 3) -> DataFrame:
    """First ``n`` matching pages by query in id order, without ranking."""
    return _first_k(match(index, queries), n, PAGE).drop("score")


def hit_counts(hits: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Hits by query, in total and as returned under the limit; 0 and a message if there are none."""
    counts = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    total = F.coalesce("n", F.lit(0))
    joined = lookup_join(
        queries.select("query_id"), counts, ["query_id"], "left",
        spread_by=["query_id"], bounded_by=queries,
    )
    return joined.select(
        "query_id",
        total.alias("n_total"),
        F.least(total, F.lit(k)).alias("n_returned"),
        F.when(total == 0, F.lit("No matches found")).alias("message"),
    )


def with_snippets(
    hits: DataFrame,
    index: Index,
    queries: DataFrame,
    n: int = 20,
    marks: tuple[str, str] = ("<b>", "</b>"),
    cut: str = "...",
    column: str | None = None,
) -> DataFrame:
    """Add the best fragment of a column, by default the first, to returned hits.

    Texts are read only for the pages that were returned, from the parts of the index where these lie.
    """
    units = query_units(queries).where(F.col("role") != "none")
    asked = units.groupBy("query_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("unit", "words", "kind"))),
            lambda u: F.struct(
                u["words"].alias("words"), (u["kind"] == F.lit("prefix")).alias("is_prefix")
            ),
        ).alias("units")
    )
    shown, rows = inlined(hits, BROADCAST_ROWS)
    documents = None if rows is None else sorted({r["doc_id"] for r in rows})
    known = documents if documents is not None and len(documents) <= TERMS_PUSHED else None
    pages = placed_words(index.texts_of(shown, column or index.columns[0], known))
    by_query = lookup_join(shown.select("query_id", *PAGE), asked, ["query_id"], spread_by=PAGE, bounded_by=queries)
    ready = written(by_query.join(pages, PAGE), "placed")
    most_units = ready.agg(F.max(F.size("units"))).first()[0] or 1
    cut_out = fragments(ready, n, marks, cut, most_units)
    return shown.join(cut_out, ["query_id", *PAGE], "left")  # one row for one row
