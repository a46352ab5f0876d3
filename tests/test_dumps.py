"""Dump reading: nasty values, breaks inside values, split files, and the import rules."""

import pytest
from pyspark.sql import functions as F

from foliant.functions.sqlvalues import tuples_of
from foliant.sources import dumps

NOW = "2024-02-01 00:00:00"


def dump_file(tmp_path, body, name="dump.sql", raw=None):
    folder = tmp_path / name.replace(".", "_")
    folder.mkdir()
    (folder / name).write_bytes(body.encode() if raw is None else raw)
    return str(folder)


def test_tuples_of():
    body = r"""('a, (b)', 'it\'s' , NULL, "x)""y",  3 , ), (1,,2), (), ('deep' (4, 5), 6)"""
    assert list(tuples_of(body)) == [
        ["'a, (b)'", r"'it\'s'", "NULL", '"x)""y"', "3"],
        ["1", "", "2"],
        [],
        ["'deep' (4", "5)", "6"],
    ]


HEAD = """/*M!999999\\- enable the sandbox mode */
-- MariaDB dump, it's a comment
--
/*!40111 SET @OLD='NO_AUTO' */;
DROP TABLE IF EXISTS `wp_posts`;
CREATE TABLE `wp_posts` (
  `ID` bigint(20) NOT NULL DEFAULT '0'
);
INSERT INTO `other` VALUES ('no','rows');
"""


def literal(v):
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


NASTY = [
    "plain", "it's", 'say "x"', "a\\b", "\\", "a);b", "); INSERT INTO `wp_posts` VALUES ('x');", "-- not a comment",
    "line\n-- neither\nis this", "a,b,(c),d", "ends with quote'", "tab\tand ü", "",
]


def test_values_survive(spark, tmp_path):
    rows = ",".join(f"({i},{literal(v)})" for i, v in enumerate(NASTY))
    path = dump_file(tmp_path, HEAD + f"INSERT INTO `wp_posts` VALUES {rows};\nUNLOCK TABLES;\n")
    got = dumps.read_sql_dump(spark, path, "wp_posts")
    back = {int(r["values"][0]): r["values"][1] for r in got.collect()}
    assert {i: v for i, v in back.items()} == {i: literal(v).strip() for i, v in enumerate(NASTY)}


@pytest.mark.parametrize("split_bytes", ["128m", "64b", "300b"])
def test_breaks_inside_values(spark, tmp_path, split_bytes):
    values = [f"v{i};\nINSERT INTO `wp_posts` VALUES ('trap{i}');\n\"tail'{i}" for i in range(12)]
    statements = [f"INSERT INTO `wp_posts` VALUES ({i},{literal(v)}),({i}00,'next');\n" for i, v in enumerate(values)]
    path = dump_file(tmp_path, HEAD + "".join(statements))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    try:
        got = sorted((int(r["values"][0]), r["values"][1]) for r in dumps.read_sql_dump(spark, path, "wp_posts").collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == sorted(
        [(i, literal(v)) for i, v in enumerate(values)] + [(i * 100, "'next'") for i in range(len(values))]
    )


MIXED = "SET x=1; INSERT INTO `t` VALUES (1,'a;b');INSERT INTO `other` VALUES ('no');\n-- it's; a note\ninsert  into `t` values (2,'c'),(3,'d')"


@pytest.mark.parametrize("line_break", ["\n", "\r\n"])
def test_inserts_stand_anywhere(spark, tmp_path, line_break):
    body = (MIXED + ";\n/* 'x; */ INSERT INTO `t` VALUES (4,'e')" + ";\nINSERT INTO `t` VALUES (5,'f');").replace("\n", line_break)
    path = dump_file(tmp_path, body)
    got = sorted(r["values"] for r in dumps.read_sql_dump(spark, path, "t").collect())
    assert got == [["1", "'a;b'"], ["2", "'c'"], ["3", "'d'"], ["4", "'e'"], ["5", "'f'"]]
    if line_break == "\r\n":
        assert dumps.read_statements(spark, path).count() > 2


def test_other_encodings_are_ignored(spark, tmp_path):
    raw = b"INSERT INTO `t` VALUES (1,'ab\xff\xfec\xc3');\n"
    assert dumps.read_sql_dump(spark, dump_file(tmp_path, "", raw=raw), "t").first()["values"] == ["1", "'abc'"]


def post(**given):
    values = ["''"] * 23
    for i, v in given.items():
        values[int(i[1:])] = v
    return "(" + ",".join(values) + ")"


def test_import_rules(spark, tmp_path):
    rows = [
        post(_1="'7'", _2="'2024-01-05 10:00:00'", _4="'body'", _5="'Title'", _20="'post'"),
        post(_2="''", _4="'body'", _5="''", _20="'page'"),
        post(_2="NULL", _4="''", _5="'only title'", _20='"post"'),
        post(_2="'2024-01-05'", _4="'  '", _5="' '", _20="'post'"),
        post(_2="'2024-01-05'", _4="'\t'", _5="'\n'", _20="'post'"),
        post(_2="'2024-01-05'", _4="'x'", _5="'y'", _20="'revision'"),
        post(_2="'0000-00-00 00:00:00'", _4="'x'", _5="'y'", _20="'post'"),
        "(1,2,3)",
    ]
    path = dump_file(tmp_path, f"INSERT INTO `p` VALUES {','.join(rows)};\n")
    tuples = dumps.read_sql_dump(spark, path, "p")
    assert tuples.count() == 8
    found = dumps.post_rows(tuples, F.lit(NOW))
    assert tuple(dumps.import_stats(found).first()) == (4, 3, 1)
    out = str(tmp_path / "posts")
    dumps.import_posts(found, out)
    dumps.import_posts(found, out)
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == list(range(1, 9))
    dumps.import_posts(found, out, truncate=True)
    titles = {(r["title"], str(r["created_at"])) for r in spark.read.parquet(out).collect()}
    assert titles == {
        ("Title", "2024-01-05 10:00:00"),
        ("", "2024-02-01 00:00:00"),
        ("only title", "2024-02-01 00:00:00"),
        ("y", "None"),
    }
    assert spark.read.parquet(out).where("title = 'y'").first()["created_text"] == "0000-00-00 00:00:00"
    by_author = dumps.post_rows(tuples, F.lit(NOW), title_col=1).where("content = 'body' and post_type = 'post'").first()
    assert by_author["title"] == "7"


def test_comments_and_headers_of_all_kinds(spark, tmp_path):
    body = (
        "# it's a note\nINSERT INTO `t` VALUES (1,'a');\n# it's another \"one\nINSERT INTO `t` VALUES (2,'# no comment');\n"
        "SET x = 1; -- it's trailing\nINSERT INTO `t` (`id`, `it's`) VALUES (3,'c'),(4,'d -- e');\n"
        "INSERT IGNORE INTO t VALUES (5,'x'); REPLACE INTO `db`.`t` (id,\n name) VALUES (6,'y');\n"
        "INSERT LOW_PRIORITY t VALUE (7,'z');\nINSERT INTO `tt` VALUES (8,'no');\nINSERT INTO `t2` VALUES (9,'t');\n"
        "INSERT /* it's */ INTO # and '\n `t` VALUES\n (10,'--');\n"
    )
    for i, text in enumerate((body, body.replace("\n", "\r\n"))):
        path = dump_file(tmp_path, text, f"kinds{i}.sql")
        got = {int(r["values"][0]): r["values"][1] for r in dumps.read_sql_dump(spark, path, "t").collect()}
        assert got == {1: "'a'", 2: "'# no comment'", 3: "'c'", 4: "'d -- e'", 5: "'x'", 6: "'y'", 7: "'z'", 10: "'--'"}


def test_one_break_of_the_other_kind_does_not_decide(spark, tmp_path):
    lines = "".join(f"INSERT INTO `t` VALUES ({i},'a;\r\nb');\n" for i in range(50))
    path = dump_file(tmp_path, lines)
    assert dumps._break_of(spark, path) == ";\n"
    assert dumps.read_sql_dump(spark, path, "t").count() == 50
    assert dumps._break_of(spark, dump_file(tmp_path, lines.replace(";\r\nb", "").replace("\n", "\r\n"), "crlf.sql")) == ";\r\n"


def test_equal_posts_get_ids_of_their_own(spark):
    rows = [(i % 3, "t" * 50, "c", "2024-01-05 10:00:00", "post", "imported") for i in range(9)] + [(None, "n", None, "", "page", "undated")]
    df = spark.createDataFrame(rows, "dump_id bigint, title string, content string, created_text string, post_type string, status string")
    got = sorted((r["id"], r["title"]) for r in dumps.imported_posts(df.repartition(4), 10).collect())
    assert [i for i, _ in got] == list(range(11, 21)) and got[0][1] == "n"
    assert dumps.imported_posts(df.limit(0)).collect() == []


def test_tuples_of_many_statements_come_together(spark, tmp_path, monkeypatch):
    path = dump_file(tmp_path, "".join(f"INSERT INTO `t` VALUES ({i},'x{i}'),({i},'');\n" for i in range(200)), "many.sql")
    wanted = sorted((str(i), v) for i in range(200) for v in (f"'x{i}'", "''"))
    for chars in (4 << 20, 1):
        monkeypatch.setattr(dumps, "BATCH_CHARS", chars)
        found = dumps.read_sql_dump(spark, path, "t")
        assert sorted(tuple(r["values"]) for r in found.collect()) == wanted
        assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
