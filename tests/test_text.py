"""Tokenizer and text functions; the tokenizer is compared with the FTS5 tokenizer of sqlite3."""

import sqlite3
import unicodedata

import pytest
from pyspark.sql import functions as F

from foliant.functions import text


def fts5_tokens(texts):
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(x)")
    con.execute("create virtual table v using fts5vocab(t, instance)")
    con.executemany("insert into t(rowid, x) values (?, ?)", list(enumerate(texts)))
    out = [[] for _ in texts]
    for term, doc, at in con.execute("select term, doc, offset from v order by doc, offset"):
        out[doc].append(term)
    return out


def spark_tokens(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = rows.select("i", text.tokens(F.col("t")).alias("w")).collect()
    return [r["w"] for r in sorted(got, key=lambda r: r["i"])]


SAMPLES = [
    "a_b", "x-y", "don't", "3.14", "ab½", "日本語テキスト", "İstanbul", "straße", "😀x", "Ⅻ", "ét", "", "  ",
    "Ünïcode ÀÉÎ", "ΟΔΟΣ ὀδός", "ǣ ǿ", "Việt Nam", "x", "a­b", "µm", "ſ",
]


def test_samples(spark):
    assert spark_tokens(spark, SAMPLES) == fts5_tokens(SAMPLES)


def test_every_latin_greek_cyrillic_character(spark):
    chars = [chr(c) for c in range(1, 0x2000) if unicodedata.category(chr(c)) not in ("Cn", "Cs")]
    texts = [f"a{c}b" for c in chars]
    ours, theirs = spark_tokens(spark, texts), fts5_tokens(texts)
    wrong = [c for c, a, b in zip(chars, ours, theirs) if a != b]
    # Characters younger than either side's Unicode tables are all that may differ.
    assert len(wrong) < 500
    assert not [c for c in wrong if ord(c) < 0x0370]


CASES = [
    (text.clean_query, ' "free" power*! é ', "free power*"),
    (text.command_name, "  SEARCH Europe now", "search"),
    (text.command_args, "search Europe  now ", "Europe  now"),
    (text.command_args, "ls", ""),
    (text.strip_tags, "<p>a <b>c</b></p>", "a c"),
    (text.strip_tags, None, ""),
    (text.escape_html, "<a href='x'>&\"", "&lt;a href=&#39;x&#39;&gt;&amp;&#34;"),
    (text.unquote_value, " NULL ", ""),
    (text.unquote_value, "null", ""),
    (text.unquote_value, "'it\\'s'", "it's"),
    (text.unquote_value, '"say \\"x\\""', 'say "x"'),
    (text.unquote_value, "'a''b'", "a''b"),
    (text.unquote_value, "'back\\\\slash\\n'", "back\\slash\\n"),
    (text.unquote_value, "42", "42"),
    (text.unquote_value, "'half", "'half"),
    (text.unquote_value, "'", ""),
    (text.slug, "a-b_c d9!", "ab_cd9"),
    (text.sse_escape, "a\nb", "a\\nb"),
    (text.sse_unescape, "a\\nb", "a\nb"),
    (text.rebase_path, "static/static/x", "static/x"),
    (text.rebase_path, "img/static/x", "img/static/x"),
    (text.preview, "w" * 255, "w" * 255),
    (text.preview, "word " * 100, "word " * 48 + "word..."),
    (text.preview, "x" * 300, "x" * 247 + "..."),
    (text.strip, " \x1c a  \n", "a"),
]


@pytest.mark.parametrize("fn,given,expected", CASES, ids=range(len(CASES)))
def test_scalar(spark, fn, given, expected):
    row = spark.createDataFrame([(given,)], "v string").select(fn(F.col("v")).alias("r")).first()
    assert row["r"] == expected


def test_build_prompt(spark):
    df = spark.createDataFrame([("c", "p"), ("", "p"), (None, "p")], "c string, p string")
    got = [r[0] for r in df.select(text.build_prompt(F.col("c"), F.col("p"))).collect()]
    assert got == ["CONTEXT:\nc\n\nQUESTION: p", "p", "p"]


def test_contact(spark):
    df = spark.createDataFrame([("a@b <b>hi</b> you",), ("a@b",)], "v string")
    got = [tuple(r[0]) for r in df.select(text.contact_parts(F.col("v"))).collect()]
    assert got == [("a@b", "hi you", True), (None, None, False)]


def test_quote_round_trip(spark):
    values = ["plain", "it's", "a\\b", "'", "\\'", ' "x" ', "", "NULL x", "new\nline", None]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    back = [r[0] for r in df.select(text.unquote_value(text.quote_value(F.col("v")))).collect()]
    assert back == [v or "" for v in values]


def test_all_white_space_goes_at_both_ends(spark):
    from foliant.functions.text import WHITE, is_blank, strip

    texts = [f"{w}a {w} b{w}\n" for w in WHITE] + [w * 2 for w in WHITE] + ["", "​a​", "NULL"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    stripped = df.select("t", strip(F.col("t")).alias("s"), is_blank(F.col("t")).alias("b"))
    assert [(r.s, r.b) for r in stripped.collect()] == [(t.strip(), not t.strip()) for t in texts]
    # the ends alone are looked at: a pattern would try every gap of a long text
    assert "regexp" not in stripped.select("s")._jdf.queryExecution().executedPlan().toString()
