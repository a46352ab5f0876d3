"""Indexes over several columns, pair postings, pruned ranking and generations of an index."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from foliant.operators import search
from foliant.operators.search import QUERY_SCHEMA, match, phrase_pieces, search_ranked, with_snippets
from foliant.sources import index as index_tables
from foliant.sources.index import (
    Index,
    current_generation,
    drop_generations,
    open_index,
    open_or_build_index,
    path_exists,
    reload_index,
    write_index,
)

COLUMNS = ("title", "body")
FIELDS = ["must", "should", "must_not", "phrase", "prefix", "phrases", "prefixes", "columns"]


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    odds = [1 / (i + 1) for i in range(40)]
    make = lambda n: " ".join(rnd.choices(words, odds, k=n))
    out = [(i, make(rnd.randrange(0, 6)), make(rnd.randrange(0, 60))) for i in range(300)]
    return out + [(900, None, None), (901, "", "w0 w1"), (902, "w0", "w1 w0"), (903, "w1 w0", None), (904, "w0 w0 w0", "w0 " * 500)]


@pytest.fixture(scope="module")
def fts(rows):
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table s using fts5(title, body)")
    con.executemany("insert into s(rowid, title, body) values (?, ?, ?)", [(i + 1, t or "", b or "") for i, t, b in rows])
    return con


def pages(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, title string, body string")
    return df.withColumn("page_num", F.lit(1)).repartition(3)


@pytest.fixture(scope="module", params=["stored", "computed"])
def index(request, spark, rows, tmp_path_factory):
    if request.param == "computed":
        return Index.of(pages(spark, rows), COLUMNS)
    path = str(tmp_path_factory.mktemp("columns") / "i")
    return write_index(pages(spark, rows), path, tokens_per_file=2_000, columns=COLUMNS, frequent_df=30)


def asked(spark, batch):
    return spark.createDataFrame([(i, *[f.get(n) for n in FIELDS]) for i, (f, _) in enumerate(batch)], QUERY_SCHEMA)


def forms():
    rnd = random.Random(4)
    out = []
    for _ in range(10):
        a, b, c = (f"w{rnd.randrange(0, n)}" for n in (4, 12, 40))
        out += [
            ({"must": [a, b]}, f"{a} {b}"),
            ({"should": [a, c]}, f"{a} OR {c}"),
            ({"must": [b], "must_not": [c]}, f"{b} NOT {c}"),
            ({"phrase": [a, b]}, f'"{a} {b}"'),
            ({"phrase": [a, "w0", b], "must": ["w1"]}, f'"{a} w0 {b}" AND w1'),
            ({"phrases": [["w0", "w1", "w2"], [a, c]]}, f'"w0 w1 w2" AND "{a} {c}"'),
            ({"prefix": c[:2], "must": [b]}, f"{c[:2]}* AND {b}"),
            ({"must": [a, b], "columns": ["title"]}, f"title : ({a} AND {b})"),
            ({"phrase": [a, b], "columns": ["body"]}, f'body : "{a} {b}"'),
            ({"prefix": b[:2], "columns": ["title"]}, f"title : {b[:2]}*"),
            ({"must": [c], "must_not": [b], "columns": ["title"]}, f"title : ({c} NOT {b})"),
            ({"should": [a, c], "columns": ["title", "body"]}, f"{a} OR {c}"),
        ]
    return out


def test_matches_and_scores_over_columns(spark, index, fts):
    batch = forms()
    got = {}
    for r in match(index, asked(spark, batch)).collect():
        got.setdefault(r["query_id"], {})[r["doc_id"]] = r["score"]
    for i, (_, expression) in enumerate(batch):
        theirs = dict(fts.execute("select rowid - 1, bm25(s) from s where s match ?", (expression,)).fetchall())
        assert got.get(i, {}).keys() == theirs.keys(), expression
        for doc, score in theirs.items():
            assert got[i][doc] == pytest.approx(score, abs=1e-9), expression


def test_column_hits_are_counted(spark, index):
    batch = [({"must": ["w0", "w1"]}, ""), ({"must": ["w0"], "columns": ["body"]}, ""), ({"must": ["w0"], "columns": ["none"]}, "")]
    found = match(index, asked(spark, batch), count_columns=True).where("doc_id >= 900").collect()
    assert sorted((r["query_id"], r["doc_id"], r["n_column_hits"]) for r in found) == [
        (0, 901, 2), (0, 902, 3), (0, 903, 2), (1, 901, 1), (1, 902, 1), (1, 904, 1)
    ]


def test_pieces_of_phrases():
    often = frozenset("abc")
    assert phrase_pieces(["a", "b"], often) == [(0, "a b", True)]
    assert phrase_pieces(["a", "b", "x", "c", "a", "b"], often) == [(0, "a b", True), (2, "x", False), (3, "c a", True), (4, "a b", True)]
    assert phrase_pieces(["x"], often) == [(0, "x", False)] and phrase_pieces(["a"], often) == [(0, "a", False)]


def test_frequent_neighbours_are_read_as_pairs(spark, index):
    if index.pairs is None:
        pytest.skip("only a stored index has pairs")
    assert {"w0", "w1"} <= index.frequent
    found = search._phrase_hits(index, search.Units.of(asked(spark, [({"phrase": ["w0", "w1"]}, "")])).within(None))
    assert found.count() > 20
    # the words' own lists are not read for it, and of "w0 w1 w39" they are read on the pages of the rarest piece only
    words = index.__class__(**{**index.__dict__, "postings": index.postings.limit(0)})
    again = search._phrase_hits(words, search.Units.of(asked(spark, [({"phrase": ["w0", "w1"]}, "")])).within(None))
    assert sorted(map(str, again.collect())) == sorted(map(str, found.collect()))
    unplanned = index.__class__(**{**index.__dict__, "pairs": None})
    batch = asked(spark, [({"phrase": [f"w{a}", f"w{b}", f"w{c}"]}, "") for a in range(3) for b in range(3) for c in (0, 1, 9, 30)])
    one, two = (sorted(map(str, match(i, batch).select("query_id", "doc_id", F.round("score", 9)).collect())) for i in (index, unplanned))
    assert one == two and len(one) > 50


def test_pruned_ranking_is_the_plain_one(spark, index):
    if index.bounds is None:
        pytest.skip("only a stored index has bounds")
    batch = asked(spark, [f for f in forms() if "columns" not in f[0] and not {"phrase", "phrases", "prefix"} & f[0].keys()])
    for k in (1, 5, 60):
        plain, pruned = (
            sorted((r["query_id"], r["rank_no"], r["doc_id"], round(r["score"], 9)) for r in search_ranked(index, batch, k, n).collect())
            for n in (10**9, 0)
        )
        assert plain == pruned and plain


def test_pruning_leaves_out_rows(spark, tmp_path):
    # A word in a quarter of the pages: short pages score best, so blocks of long pages need not be read.
    text = "concat(if(id % 4 = 0, 'free ', ''), repeat('x ', CAST(1 + id % 400 AS INT))) AS content"
    spark.range(4000).selectExpr("id AS doc_id", "1 AS page_num", text).write.parquet(str(tmp_path / "p"))
    index = write_index(spark.read.parquet(str(tmp_path / "p")), str(tmp_path / "i"))
    batch = asked(spark, [({"should": ["free", "unheard"]}, "")])
    units = search.Units.of(batch)
    hits = search._pruned(index, units, 5, 0)
    assert hits.count() < 250 and match(index, batch).count() == 1000
    assert [r["doc_id"] for r in search_ranked(index, batch, 5, 0).orderBy("rank_no").collect()] == [0, 400, 800, 1200, 1600]


def test_empty_pages_and_snippets_of_a_column(spark, rows, tmp_path):
    empty = write_index(pages(spark, rows).limit(0), str(tmp_path / "e"), columns=COLUMNS)
    batch = asked(spark, forms())
    assert match(empty, batch).collect() == [] and search_ranked(empty, batch, 5, 0).collect() == []
    index = write_index(pages(spark, rows).where("doc_id >= 900"), str(tmp_path / "s"), columns=COLUMNS)
    one = asked(spark, [({"must": ["w0"]}, "")])
    found = with_snippets(search_ranked(index, one), index, one, column="body").collect()
    assert {r["doc_id"]: r["snippet"] for r in found}[902] == "w1 <b>w0</b>"


def test_generations(spark, rows, tmp_path):
    base = str(tmp_path / "gens")
    with pytest.raises(FileNotFoundError):
        open_or_build_index(spark, base, None)
    first = open_or_build_index(spark, base, pages(spark, rows), columns=COLUMNS)
    reader = open_or_build_index(spark, base, None)
    assert reader.path == first.path == current_generation(spark, base) and reader.columns == COLUMNS
    second = reload_index(pages(spark, rows).limit(7), base, columns=COLUMNS)
    # the next reader gets the new generation, who reads the old one goes on with it
    assert open_or_build_index(spark, base, None).doc_stats().count() == 7
    assert reader.doc_stats().count() == len(rows) and second.path != first.path
    assert drop_generations(spark, base) == []
    write_index(pages(spark, rows).limit(1), f"{base}/gen-0-left", columns=COLUMNS)  # a build that never became current
    assert len(drop_generations(spark, base, older_than=0)) == 2 and not path_exists(spark, first.path)
    assert open_index(spark, current_generation(spark, base)).doc_stats().count() == 7
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        write_index(pages(spark, rows), second.path, columns=COLUMNS)


def test_large_batches_search_equal_queries_once(spark, monkeypatch):
    pages = spark.createDataFrame([(1, 1, "red fox"), (2, 1, "red hen"), (3, 1, "blue fox")], "doc_id long, page_num int, content string")
    index = Index.of(pages)
    asked = [(i, ["red"] if i % 2 else ["fox"]) for i in range(8)] + [(8, ["red"]), (8, ["hen"]), (None, ["red"]), (9, None)]
    queries = search.queries_of(spark.createDataFrame(asked, "query_id long, w array<string>"), must=F.col("w"))
    found = lambda: sorted((str(r["query_id"]), r["doc_id"], round(r["score"], 9)) for r in search.match(index, queries).collect())
    plain, sizes = found(), []
    monkeypatch.setattr(search, "UNITS_INLINE", 3)
    once = search._match
    monkeypatch.setattr(search, "_match", lambda i, units, b: sizes.append(units.df.select("query_id").distinct().count()) or once(i, units, b))
    assert found() == plain and len(plain) == 19
    assert sizes == [4]


def test_hits_of_alike_queries_are_dealt_by_their_copies(spark, monkeypatch):
    few = spark.range(40).select(F.col("id").alias("doc_id"), F.lit(1).alias("page_num"), F.lit("a b").alias("title"))
    monkeypatch.setattr(search, "UNITS_INLINE", 3)
    monkeypatch.setattr(search, "ROWS_FOR_ALIKE", 100)
    found = match(Index.of(few, ("title",)), asked(spark, [({"phrase": ["a", "b"]}, None)] * 200), digits=2)
    assert found.rdd.getNumPartitions() == 40 * 200 / 100
    assert found.distinct().count() == found.count() == 40 * 200


def test_a_prefix_is_looked_for_once_and_its_copies_are_not_shuffled(spark, index):
    batch = [({"prefix": "w1"}, None)] * 5 + [({"prefix": "w2", "must": ["w0"]}, None), ({"prefixes": ["w1", "w2"], "columns": ["title"]}, None)]
    hits, members, n = search._prefix_hits(index, search.Units.of(asked(spark, batch)).within(None))
    assert hits.select("_code").distinct().count() == members.select("_code").distinct().count() == 4
    assert hits.groupBy("_code", *index_tables.PAGE).count().where("count > 1").isEmpty()
    assert members.count() == 8 and members.join(hits, "_code").count() == n > hits.count()
    plan = match(index, asked(spark, batch))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in plan and "hashpartitioning(query_id" not in plan.split("hashpartitioning(doc_id")[0]


def test_required_words_are_looked_for_on_the_rarest_ones_pages(spark, index, monkeypatch):
    words = [["w0", "w1", "w30"], ["w0", "w0", "w39", "w2"], ["w0", "nowhere", "w1"], ["w0", "w1"]]
    batch = [{"must": w, "should": ["w3", "w4"], "must_not": ["w5"]} for w in words] + [{"must": w} for w in words] + [{"should": ["w0", "w1"]}]
    ids = [*range(len(batch)), 1, None]
    queries = spark.createDataFrame([(i, *[q.get(n) for n in FIELDS]) for i, q in zip(ids, [*batch, batch[1], batch[4]])], QUERY_SCHEMA)
    found = lambda: sorted((str(r["query_id"]), r["doc_id"], round(r["score"], 9), r["n_column_hits"]) for r in match(index, queries, True).collect())
    plain, led, leading = found(), [], search._leading
    monkeypatch.setattr(search, "LEAD_HITS", 1)
    monkeypatch.setattr(search, "_leading", lambda *a: led.append(leading(*a)) or led[-1])
    assert found() == plain and len(plain) > 100
    assert index.buckets is None or {q for q, _, _ in led[0]} >= {4, 5, 6} and not {q for q, _, _ in led[0]} & {1, None, 8}


def test_other_pieces_of_phrases_are_read_once_by_place(spark, rows, tmp_path, monkeypatch):
    index = write_index(pages(spark, rows), str(tmp_path / "i"), tokens_per_file=2_000, columns=COLUMNS, frequent_df=10_000)
    keys, join = [], search.lookup_join
    monkeypatch.setattr(search, "lookup_join", lambda f, d, k, *a, **o: keys.append(k) or join(f, d, k, *a, **o))
    queries = [(i, *[["w0", "w1", f"w{2 + i % 2}"] if n == "phrase" else None for n in FIELDS]) for i in range(6)]
    found = match(index, spark.createDataFrame(queries, QUERY_SCHEMA)).groupBy("query_id").count().collect()
    assert len({r["count"] for r in found if r["query_id"] % 2 == 0}) == 1 and len(found) in (3, 6)
    assert ["term", "doc_id", "page_num", "column_id"] in keys


def test_files_of_large_indexes_do_not_grow():
    for tokens in (200_000_000, 1_000_000_000, 30_000_000_000):
        buckets, splits = index_tables._layout(tokens, None, 12)
        assert tokens / (buckets * splits) <= 2_000_000


def test_postings_come_in_the_order_of_their_files(spark, monkeypatch):
    """Rows of many pages at once, whole however they are cut, so that the sort before writing only merges."""
    pages = [(7, 1, "b a b", "a c"), (3, 2, "b", ""), (None, 1, "c a b", "b a"), (3, 1, "", ""), (7, 1, "b a b", "a c")]
    df = spark.createDataFrame(pages, "doc_id bigint, page_num int, x string, y string").coalesce(1)
    toks = index_tables.tokenize_columns(df, ["x", "y"])
    key = lambda r: (r[0], r[2] is not None, r[2], r[3], r[1])

    def expected(words):
        out = []
        for doc, page, *texts in pages:
            seen, dl = set(), sum(len(t.split()) for t in texts)
            for c, text in enumerate(texts):
                found = words(text.split())
                for term in sorted(set(found)):
                    at = [i for i, w in enumerate(found) if w == term]
                    out.append((term, c, doc, page, len(at), dl, term not in seen, at))
                seen |= set(found)
        return sorted(out, key=key)

    def rows(found):
        return [(r.term, r.column_id, r.doc_id, r.page_num, r.tf, r.dl, r.leads, r.positions) for r in found.collect()]

    for at_once in (1 << 20, 1):
        monkeypatch.setattr(index_tables, "WORDS_AT_ONCE", at_once)
        singles, pairs = rows(index_tables.build_postings(toks)), rows(index_tables.build_pairs(toks, ["a", "b"]))
        assert sorted(singles, key=key) == expected(lambda ws: ws)
        # a pair's place is that of its first word; other neighbours leave a gap
        assert sorted(pairs, key=key) == [r for r in expected(lambda ws: [f"{v} {w}" for v, w in zip(ws, ws[1:])]) if "c" not in r[0]]
    monkeypatch.setattr(index_tables, "WORDS_AT_ONCE", 1 << 20)
    order = [(r[0], r[2] if r[2] is not None else -1) for r in rows(index_tables.build_postings(toks))]
    assert order == sorted(order)
    assert rows(index_tables.build_pairs(toks, [])) == []


def test_postings_travel_packed_by_file(spark, rows):
    toks = index_tables.tokenize_columns(pages(spark, [*rows, (None, "w0 w1", None)]), list(COLUMNS))
    layout = index_tables.Layout(3, 4)
    packs = index_tables._postings(toks, F.col("cols"), None, layout)
    assert [f.dataType.simpleString() for f in packs.schema] == ["int", "binary"]
    assert packs.count() <= 12 * toks.rdd.getNumPartitions() and packs.select("file").distinct().count() == 12
    found = layout.unpacked(packs)
    plain = index_tables.build_postings(toks)
    listed = lambda df: sorted(map(str, df.select(*plain.columns).collect()))
    assert listed(found) == listed(plain)
    assert found.where(F.col("bucket") != index_tables._bucket(F.col("term"), 3)).isEmpty()
    # a page's words of one bucket lie in one file
    files = found.withColumn("_file", F.spark_partition_id()).groupBy("bucket", *index_tables.PAGE).agg(F.count_distinct("_file").alias("n"))
    assert files.where("n > 1").isEmpty()


def test_texts_of_an_index_are_not_shuffled(spark, tmp_path, monkeypatch):
    from foliant.plans import sizing

    spark.range(50).select(F.col("id").alias("doc_id"), F.lit(1).alias("page_num"), F.lit(0).alias("part"), F.lit("a b").alias("c0")).write.parquet(f"{tmp_path}/t")
    texts = spark.read.parquet(f"{tmp_path}/t")
    monkeypatch.setattr(sizing, "SPLIT_BYTES", 1)
    monkeypatch.setattr(index_tables, "FILES_OF_PART", 1 << 30)
    assert index_tables._dealt_texts(texts, index_tables.Layout(2, 2)) is texts
    monkeypatch.setattr(index_tables, "FILES_OF_PART", 0)  # so large that each task's files would be small
    assert index_tables._dealt_texts(texts, index_tables.Layout(2, 2)).rdd.getNumPartitions() == 4
