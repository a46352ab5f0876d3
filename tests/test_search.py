"""Search compared with an FTS5 table of sqlite3 that holds the same texts."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from foliant.operators.search import (
    QUERY_SCHEMA,
    hit_counts,
    match,
    queries_of,
    search_first_n,
    search_ranked,
    with_snippets,
)
from foliant.operators import search
from foliant.sources.index import Index, open_or_build_index, reload_index, write_index
from foliant.sources.pages import whole_pages


@pytest.fixture(scope="module")
def corpus(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    extra = spark.createDataFrame(
        [
            (100000, "one two power-free three. Free power: thirteen free fourteen fifteen sixteen"),
            (100001, ""),
            (100002, "free free free power free free power free power power free"),
            (100003, " ".join(f"w{i}" for i in range(50)) + ". Then free speech: " + " ".join(f"v{i}" for i in range(60)) + " power free"),
        ],
        "doc_id bigint, text string",
    )
    return whole_pages(docs.select("doc_id", "text").unionByName(extra), "doc_id", "text").cache()


@pytest.fixture(scope="module")
def fts(corpus):
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table s using fts5(page_num unindexed, content)")
    rows = [(r["doc_id"] + 1, 1, r["content"]) for r in corpus.collect()]
    con.executemany("insert into s(rowid, page_num, content) values (?, ?, ?)", rows)
    return con


@pytest.fixture(scope="module", params=["stored", "computed"])
def index(request, spark, corpus, tmp_path_factory):
    if request.param == "computed":
        return Index.of(corpus)
    return write_index(corpus, str(tmp_path_factory.mktemp("index") / "i"), tokens_per_file=5_000, frequent_df=12)


def vocabulary(fts):
    fts.execute("create virtual table if not exists v using fts5vocab(s, row)")
    return [t for (t,) in fts.execute("select term from v where doc > 1 order by term") if t.isascii() and t.isalnum()]


def batch(fts):
    """(query row, FTS5 expression) of every form."""
    rnd, words = random.Random(7), vocabulary(fts)
    common = [t for (t,) in fts.execute("select term from v order by doc desc limit 60") if t.isascii()]
    texts = [t for (t,) in fts.execute("select content from s where length(content) > 100")]
    out = []

    def add(expression, **fields):
        out.append((len(out), fields, expression))

    for _ in range(12):
        a, b, c = rnd.choice(common), rnd.choice(common), rnd.choice(words)
        add(f'"{a}"', must=[a])
        add(f'"{a}" "{b}"', must=[a, b])
        add(f'"{a}" OR "{c}"', should=[a, c])
        add(f'"{a}" NOT "{b}"', must=[a], must_not=[b])
        add(f'("{c}" OR "{b}") AND "{a}"', must=[a], should=[c, b])
        add(f'"{c[:2]}" * "{a}"', must=[a], prefix=c[:2])
        run = [w for w in rnd.choice(texts).split()[3:6] if w.isascii() and w.isalpha()]
        if run:
            add('"' + " ".join(run) + '"', phrase=run)
            add('"' + " ".join(run) + f'" "{a}"', phrase=run, must=[a])
    add('"free"', must=["free"])
    add('"free" "power"', must=["FREE", "Power"])
    add('"power free"', phrase=["power", "free"])
    add('"free free"', phrase=["free", "free"])
    add('"free" "free"', must=["free", "free"])
    return out


def query_table(spark, rows):
    names = ["must", "should", "must_not", "phrase", "prefix", "phrases", "prefixes", "columns"]
    return spark.createDataFrame([(i, *[f.get(n) for n in names]) for i, f, _ in rows], QUERY_SCHEMA)


def test_matches_and_scores(spark, index, fts):
    rows = batch(fts)
    got = {}
    for r in match(index, query_table(spark, rows)).collect():
        got.setdefault(r["query_id"], {})[r["doc_id"]] = r["score"]
    for i, fields, expression in rows:
        found = fts.execute("select rowid - 1, bm25(s) from s where s match ?", (expression,)).fetchall()
        theirs = dict(found)
        ours = got.get(i, {})
        assert set(ours) == set(theirs), expression
        for doc, score in theirs.items():
            assert ours[doc] == pytest.approx(score, abs=1e-9), expression


def test_large_batches_take_the_same_way(spark, index, fts, monkeypatch):
    rows = batch(fts)
    few = {tuple(r)[:3]: r["score"] for r in match(index, query_table(spark, rows)).collect()}
    monkeypatch.setattr(search, "UNITS_INLINE", 1)
    from foliant.plans import sizing

    monkeypatch.setattr(sizing.lookup_join, "__defaults__", ("inner", 1, 4, None, None))
    many = {tuple(r)[:3]: r["score"] for r in match(index, query_table(spark, rows)).collect()}
    assert few.keys() == many.keys()
    assert all(few[k] == pytest.approx(many[k], abs=1e-9) for k in few)


def test_snippets(spark, index, fts):
    rows = batch(fts)
    asked = query_table(spark, rows)
    hits = search_ranked(index, asked, 5).cache()
    expressions = {i: e for i, _, e in rows}
    for n in (10, 20, 40):
        got = with_snippets(hits, index, asked, n, ("[", "]")).collect()
        assert len(got) == hits.count() > 100
        for r in got:
            theirs = fts.execute(
                f"select snippet(s, 1, '[', ']', '...', {n}) from s where s match ? and rowid = ?",
                (expressions[r["query_id"]], r["doc_id"] + 1),
            ).fetchone()[0]
            assert r["snippet"] == theirs, expressions[r["query_id"]]


def test_ranked_and_first(spark, index, fts):
    rows = batch(fts)
    asked = query_table(spark, rows)
    ranked, first = search_ranked(index, asked, 5).collect(), search_first_n(index, asked, 3).collect()
    for i, _, e in rows:
        top = fts.execute("select round(bm25(s), 9) from s where s match ? order by bm25(s) limit 5", (e,)).fetchall()
        mine = sorted((r["rank_no"], round(r["score"], 9)) for r in ranked if r["query_id"] == i)
        assert [s for _, s in mine] == pytest.approx([s for (s,) in top], abs=1e-8)
        ids = fts.execute("select rowid - 1 from s where s match ? order by rowid limit 3", (e,)).fetchall()
        assert [r["doc_id"] for r in sorted((r for r in first if r["query_id"] == i), key=lambda r: r["rank_no"])] == [
            d for (d,) in ids
        ]


def test_only_not_or_nothing_matches_no_page(spark, index):
    asked = query_table(spark, [(0, {"must_not": ["free"]}, ""), (1, {}, "")])
    assert match(index, asked).collect() == []
    counts = hit_counts(match(index, asked), asked, 5).orderBy("query_id").collect()
    assert [tuple(r) for r in counts] == [(0, 0, 0, "No matches found"), (1, 0, 0, "No matches found")]


PAGES = [
    (1, 1, "Democracy requires free institutions and open debate."),
    (1, 2, "Autocracy consolidates power by undermining opposition."),
]


def test_reference_cases(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "doc_id bigint, page_num int, content string")
    path = str(tmp_path / "index")
    with pytest.raises(FileNotFoundError):
        open_or_build_index(spark, path, None)
    open_or_build_index(spark, path, pages)
    index = open_or_build_index(spark, path, None)
    words = ["democracy", "xyznonexistent", "AUTOCRACY"]
    asked = queries_of(
        spark.createDataFrame(list(enumerate(words)), "query_id bigint, w string"), must=F.array("w")
    )
    hits = match(index, asked)
    assert sorted((r["query_id"], r["page_num"]) for r in hits.collect()) == [(0, 1), (2, 2)]
    assert hit_counts(hits, asked, 5).where("query_id = 1").first()["message"] == "No matches found"
    again = reload_index(pages.limit(1), path)
    assert again.doc_stats().count() == 1 and index.doc_stats().count() == 2
    assert open_or_build_index(spark, path, None).doc_stats().count() == 1


def test_stored_lookup_reads_only_wanted_words(spark, corpus, tmp_path):
    index = write_index(corpus, str(tmp_path / "i"), tokens_per_file=5_000)
    asked = query_table(spark, [(0, {"must": ["free", "power"]}, "")])
    plan = search_ranked(index, asked)._jdf.queryExecution().executedPlan().toString()
    postings_scan = next(line for line in plan.splitlines() if "FileScan" in line and "tf" in line)
    assert "In(term" in postings_scan and "bucket" in postings_scan.split("PartitionFilters")[1]
    assert "positions" not in postings_scan.split("ReadSchema")[1]
    assert "WindowGroupLimit" in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_typed_queries(spark):
    from foliant.functions.querytext import query_fields

    typed = {
        "free power": {"must": ["free", "power"]},
        'say "a b, C" now free* pow*': {"must": ["say", "now"], "phrases": [["a", "b", "c"]], "prefixes": ["free", "pow"]},
        "a OR b OR c d": {"must": ["d"], "should": ["a", "b", "c"]},
        "a NOT b AND c": {"must": ["a", "c"], "must_not": ["b"]},
        "it's, Éa or": {"must": ["it", "s", "ea", "or"]},
        '  "" * ': {},
        None: {},
    }
    df = spark.createDataFrame([(t,) for t in typed], "t string")
    for row in df.select("t", *[c.alias(n) for n, c in query_fields(F.col("t")).items()]).collect():
        assert {n: row[n] for n in row.asDict() if n != "t" and row[n]} == typed[row["t"]]
