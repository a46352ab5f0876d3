"""Size checks, shared scratch storage and skew-safe joins.

Every broadcast in this package goes through ``lookup_join``: rows and bytes are looked at first, and a
salted shuffle is used beyond the bounds.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructField, StructType

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 << 20
SPLIT_BYTES = 128 << 20
SALTS = 16


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder, beside its warehouse; the session's settings are left alone.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/foliant-scratch"


def app_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/foliant/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{app_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage by writing ``df`` to shared storage and reading it back."""
    path = scratch_path(df.sparkSession, label)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _bytes(field: StructField) -> Column:
    """Rough size of a value; only types without a fixed width are looked at."""
    kind = field.dataType
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(field.name), F.lit(0))
    if isinstance(kind, (ArrayType, MapType, StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(field.name))), F.lit(0))
    return F.lit(8)


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a table is within both bounds.

    The widths of its rows are taken partition after partition until a bound is passed; nothing is shuffled, and at most
    ``max_rows`` + 1 numbers come to the driver, none of them if these are more than ``BROADCAST_ROWS``.
    """
    width = reduce(lambda a, b: a + b, [_bytes(f) for f in df.schema.fields])
    if max_rows > BROADCAST_ROWS:
        rows, size = df.select(width.cast("bigint").alias("w")).limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum("w")).first()
        return rows <= max_rows and (size or 0) <= max_bytes
    seen = df.select(width.cast("bigint").alias("w")).take(max_rows + 1)
    return len(seen) <= max_rows and sum(r["w"] for r in seen) <= max_bytes


def inlined(df: DataFrame, max_rows: int) -> tuple[DataFrame, list | None]:
    """A small table as a local relation together with its rows, else the table itself and None.

    One job looks at ``max_rows`` + 1 rows at most; plans over a local relation need no further size checks.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return df, None
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    columns = pa.Table.from_pylist([r.asDict(True) for r in rows], to_arrow_schema(df.schema))
    return df.sparkSession.createDataFrame(columns, df.schema), rows


def estimated_bytes(df: DataFrame) -> int:
    """What Spark takes a table for, from the file sizes; nothing is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for heavy per-row work on an input too small to give every core a full split.

    The estimate comes from the file sizes, nothing is run; larger inputs are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if estimated_bytes(df) <= cores * SPLIT_BYTES else df


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application has written to the shared folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(app_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def lookup_join(
    facts: DataFrame,
    dim: DataFrame,
    keys: list[str],
    how: str = "inner",
    max_rows: int = BROADCAST_ROWS,
    salts: int = SALTS,
    spread_by: list[str] | None = None,
    bounded_by: DataFrame | int | None = None,
) -> DataFrame:
    """Join facts, whose keys may be skewed, to a table with few rows per key.

    A checked small ``dim`` is broadcast. Beyond the bound the facts of one key are
    spread over ``salts`` tasks and ``dim`` is repeated once for each of them.
    ``how`` must keep the facts on the left (inner, left, left_semi, left_anti).
    ``bounded_by`` may name a cheaper table that has at least as many rows, and as wide ones, as ``dim``, or the number
    of rows, which saves a look at a large ``dim``.
    """
    if isinstance(bounded_by, int):
        fits = bounded_by <= max_rows and is_small(dim, max_rows)
    else:
        fits = is_small(dim if bounded_by is None else bounded_by, max_rows)
    if fits:
        return facts.join(F.broadcast(dim), keys, how)
    # The partition number also parts rows that are equal in all columns, and is the same on a retry.
    others = spread_by or [c for c in facts.columns if c not in keys]
    salt = F.pmod(F.xxhash64(F.spark_partition_id(), *others), F.lit(salts))
    salted_facts = facts.withColumn("_salt", salt)
    salted_dim = dim.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint")))
    )
    # Spark takes the repeated rows for as small as the file they come from; without the hint it would broadcast them.
    return salted_facts.join(salted_dim.hint("merge"), [*keys, "_salt"], how).drop("_salt")
