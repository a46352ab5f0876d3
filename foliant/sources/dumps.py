"""Reading SQL dumps as tables, and the import of posts.

The text source cuts a dump at ``;`` and a line break (of the kind that its statements end with), in parallel over splits
of a file. A record between two cuts may hold any number of statements. Whether such a break stands inside a quoted value is checked for every record: each record maps the
quote state before it to the state after it. Dumps as their tools write them never have one, and then records
are whole. If some do, the maps are composed: inside a file split, then over the splits of a
file (one tiny row each), and the records of one value are put together again.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.sqlvalues import COMMENT, insert_bodies, insert_header, tuples_of
from foliant.functions.text import is_blank, unquote_value
from foliant.operators.filters import default_created, min_arity
from foliant.plans.ordered import ordered
from foliant.plans.sizing import spread, written
from foliant.sources.index import path_exists

if TYPE_CHECKING:
    import pyarrow as pa

BREAK = ";\n"
MIN_VALUES = 21
BATCH_CHARS, ROW_CHARS = 4 << 20, 400  # of the tuples that a task gives out at a time, and what one counts for besides its text

# Positions in a posts tuple.
AUTHOR_COL, DATE_COL, CONTENT_COL, TITLE_COL, TYPE_COL = 1, 2, 4, 5, 20

POST_TYPES = ["post", "page"]
PLAIN, SINGLE, DOUBLE = 0, 1, 2


def _state_after(record: Column, before: int) -> Column:
    """Quote state at the end of a record that starts in the given state."""
    opening = {PLAIN: "", SINGLE: "'", DOUBLE: '"'}[before]
    bare = F.regexp_replace(record, r"(?s)\\.", "")
    rest = F.regexp_replace(
        F.concat(F.lit(opening), bare), r"""(?m)'[^']*'|"[^"]*"|`[^`]*`|/\*(?s:.*?)\*/|""" + COMMENT, ""
    )
    first = F.regexp_extract(rest, "['\"]", 0)
    return F.when(first == "'", SINGLE).when(first == '"', DOUBLE).otherwise(PLAIN)


def _break_of(spark: SparkSession, path: str) -> str:
    """Where records end: at CR LF if more lines end with ``;`` and that than with a bare ``;``.

    All lines are looked at, so what stands at the head or inside a text does not decide. The statements are the same with
    either; where both kinds occur, some records come out longer.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    ends = lines.agg(F.count_if(F.col("value").endswith(";")).alias("lf"), F.count_if(F.col("value").endswith(";\r")).alias("cr")).first()
    return ";\r\n" if ends["cr"] > ends["lf"] else BREAK


def _records(spark: SparkSession, path: str, line_sep: str) -> DataFrame:
    return (
        spark.read.option("lineSep", line_sep)
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("seq"),
            F.col("value").alias("record"),
        )
    )


def _glued(records: DataFrame, line_sep: str) -> DataFrame:
    """Statements of records whose breaks may stand inside quoted values."""
    maps = [_state_after(F.col("record"), s).alias(f"to{s}") for s in (PLAIN, SINGLE, DOUBLE)]
    kept = written(records.select("*", *maps), "records")
    steps = kept.select("file", "block", "seq", "to0", "to1", "to2")

    def over_block(pdf: pd.DataFrame) -> pd.DataFrame:
        ends = [0, 1, 2]
        for step in pdf.sort_values("seq")[["to0", "to1", "to2"]].to_numpy():
            ends = [int(step[e]) for e in ends]
        return pd.DataFrame([[pdf["file"].iloc[0], pdf["block"].iloc[0], *ends]])

    def over_file(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, state, entries = pdf.sort_values("block"), PLAIN, []
        for step in pdf[["to0", "to1", "to2"]].to_numpy():
            entries.append(state)
            state = int(step[state])
        return pdf[["file", "block"]].assign(entry=entries)

    def starts(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        state, fresh = int(pdf["entry"].iloc[0]), []
        for step in pdf[["to0", "to1", "to2"]].to_numpy():
            fresh.append(state == PLAIN)
            state = int(step[state])
        return pdf[["file", "block", "seq"]].assign(fresh=fresh)

    blocks = steps.groupBy("file", "block").applyInPandas(
        over_block, "file string, block bigint, to0 int, to1 int, to2 int"
    )
    entries = blocks.groupBy("file").applyInPandas(over_file, "file string, block bigint, entry int")
    marked = (
        steps.join(entries, ["file", "block"])
        .groupBy("file", "block")
        .applyInPandas(starts, "file string, block bigint, seq bigint, fresh boolean")
    )
    flagged = kept.select("file", "block", "seq", "record").join(marked, ["file", "block", "seq"])
    begun = flagged.withColumn("_start", F.when(F.col("fresh"), F.struct("block", "seq")))
    whole = ordered(begun, ["file"], ["block", "seq"]).carry("_start", "start").rows()
    parts = F.array_sort(F.collect_list(F.struct("block", "seq", "record")))
    return whole.groupBy("file", "start").agg(
        F.array_join(F.transform(parts, lambda p: p["record"]), line_sep).alias("statement")
    ).select("statement")


def read_statements(spark: SparkSession, path: str) -> DataFrame:
    """(statement): texts that begin and end outside quotes and together hold all statements of the dump."""
    line_sep = _break_of(spark, path)
    records = _records(spark, path, line_sep)
    # an aggregate looks at all splits at once; looking for a first row would go through them in turns
    if (records.agg(F.max(_state_after(F.col("record"), PLAIN))).first()[0] or PLAIN) == PLAIN:
        return records.select(F.col("record").alias("statement"))
    return _glued(records, line_sep)


def read_sql_dump(spark: SparkSession, path: str, table: str) -> DataFrame:
    """(values array<string>), one row for each tuple of ``INSERT INTO `table` VALUES``, wherever it stands.

    ``REPLACE``, ``IGNORE`` and a list of columns are known too; values come in the order of the statement. Bytes that are not
    UTF-8 are ignored. The statements stay where the scan put them.
    """
    header = insert_header(table)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        def given(rows: list[list[str]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.string()))], ["values"])

        rows, size = [], 0
        for batch in batches:
            for raw in batch.column("raw"):
                text = raw.as_py().decode("utf-8", "ignore")
                for body in insert_bodies(text, header):
                    for row in tuples_of(body):
                        rows.append(row)
                        size += ROW_CHARS + sum(map(len, row))
                        if size >= BATCH_CHARS:
                            yield given(rows)
                            rows, size = [], 0
        if rows:
            yield given(rows)

    found = read_statements(spark, path).where(F.contains(F.lower("statement"), F.lit(table.lower())))
    return spread(found.select(F.col("statement").cast("binary").alias("raw"))).mapInArrow(
        parse, "values array<string>"
    )


def post_rows(
    tuples: DataFrame,
    now: Column,
    title_col: int = TITLE_COL,
    content_col: int = CONTENT_COL,
    date_col: int = DATE_COL,
    type_col: int = TYPE_COL,
    min_values: int = MIN_VALUES,
) -> DataFrame:
    """Posts before filtering: (dump_id, title, content, created_text, post_type, status).

    ``status`` is imported, undated (imported as well, but the date cannot be read) or skipped. Tuples with too few
    values are no rows at all. ``title_col=1`` takes the author column as title.
    """

    def value(i: int) -> Column:
        return unquote_value(F.get("values", F.lit(i)))

    rows = min_arity(tuples, "values", min_values).select(
        value(0).try_cast("bigint").alias("dump_id"),
        value(title_col).alias("title"),
        value(content_col).alias("content"),
        default_created(value(date_col), now).alias("created_text"),
        value(type_col).alias("post_type"),
    )
    blank = is_blank(F.col("title")) & is_blank(F.col("content"))
    skipped = ~F.col("post_type").isin(POST_TYPES) | blank
    unreadable = F.col("created_text").try_cast("timestamp").isNull()
    return rows.withColumn(
        "status", F.when(skipped, "skipped").when(unreadable, "undated").otherwise("imported")
    )


def imported_posts(rows: DataFrame, last_id: int = 0) -> DataFrame:
    """The accepted posts under new ids after ``last_id``, in the order of their ids in the dump.

    ``created_text`` is the date as it was given; ``created_at`` is null where it cannot be read. Only the dump's ids, dates and a
    digest of the texts are put in order; of posts that are alike in all of these, each gets an id of its own.
    """
    digest = F.md5(F.to_json(F.struct("title", "content", "post_type")))
    accepted = rows.where(F.col("status").isin("imported", "undated")).withColumn("_digest", digest)
    accepted = written(accepted.withColumn("_row", F.monotonically_increasing_id()), "posts")
    narrow = accepted.select("dump_id", "created_text", "_digest", "_row")
    numbered = ordered(narrow, [], ["dump_id", "created_text", "_digest", "_row"]).number("_no").rows()
    return accepted.join(numbered.select("_row", "_no"), "_row").select(
        (F.col("_no") + last_id).cast("bigint").alias("id"),
        "title",
        "content",
        F.col("created_text").try_cast("timestamp").alias("created_at"),
        "created_text",
        "post_type",
    )


def import_stats(rows: DataFrame) -> DataFrame:
    """imported counts all accepted posts, undated those among them whose date cannot be read."""
    accepted = F.col("status").isin("imported", "undated")
    return rows.agg(
        F.count_if(accepted).alias("imported"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if(F.col("status") == "undated").alias("undated"),
    )


def import_posts(rows: DataFrame, path: str, truncate: bool = False) -> None:
    """Append the accepted posts, with ids after those that are there; ``truncate`` clears the table first."""
    spark = rows.sparkSession
    last = 0
    if not truncate and path_exists(spark, f"{path}/_SUCCESS"):
        last = spark.read.parquet(path).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    imported_posts(rows, last).write.mode("overwrite" if truncate else "append").parquet(path)


def write_sql_dump(rows: DataFrame, path: str, table: str, values: list[Column]) -> None:
    """Dump text of one INSERT a row, for tests and hand-over; ``values`` are SQL literals."""
    tuple_text = F.concat(F.lit("("), F.concat_ws(",", *values), F.lit(")"))
    statement = F.concat(F.lit(f"INSERT INTO `{table}` VALUES "), tuple_text)
    rows.select(statement.alias("value")).write.mode("errorifexists").option("lineSep", BREAK).text(path)
