"""Tables kept in buckets of their key, of which a change rewrites only those that it touches.

base/data-*/bucket=n/    Parquet files of the rows of one bucket, written by one change and never altered
base/log/<version>.json  which folders hold each bucket at that version

A change reads the buckets of its keys, writes their next state to a new folder and commits a record that names
the new folder for them and the old ones for all others. The record of a version can be made only once, so of two changes
that began at one version the second fails and can be tried again on the new one; nothing is lost or half done.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foliant.operators.tables import insert_if_absent


class Conflict(RuntimeError):
    """Another change was committed since the table was opened."""


def _path(spark: SparkSession, path: str):  # noqa: ANN202
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _read_text(spark: SparkSession, path: str) -> str:
    target = _path(spark, path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _names(spark: SparkSession, folder: str) -> list[str]:
    target = _path(spark, folder)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in files.listStatus(target)] if files.exists(target) else []


def _create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Make a whole file unless it is there already; whether it was made."""
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    conf = spark._jsc.hadoopConfiguration()
    files = _path(spark, draft).getFileSystem(conf)
    stream = files.create(_path(spark, draft), False)
    stream.write(bytearray(text.encode()))
    stream.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, draft).toUri(), conf)
    never_over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(_path(spark, draft), _path(spark, path), never_over)
    except Exception as e:  # noqa: BLE001  Py4J wraps what the file system throws
        files.delete(_path(spark, draft), False)
        if "FileAlreadyExists" in str(e) or "already exists" in str(e):
            return False
        raise
    return True


@dataclass(frozen=True)
class KeyedTable:
    """A table at one version; ``folders`` lists by bucket the folders with its rows."""

    spark: SparkSession
    base: str
    version: int
    key: str
    buckets: int
    schema: StructType
    folders: dict[int, list[str]]

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit(""))), F.lit(self.buckets)).cast("int")

    def rows(self, buckets: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        wanted = self.folders if buckets is None else {b: self.folders.get(b, []) for b in buckets}
        paths = [f"{self.base}/{folder}/bucket={b}" for b, folders in sorted(wanted.items()) for folder in folders]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def touched(self, changes: DataFrame) -> list[int]:
        """The buckets of the keys of a change: as many numbers as the table has buckets, at most."""
        found = changes.select(self.bucket(F.col(f"`{self.key}`")).alias("b")).distinct()
        return sorted(r["b"] for r in found.collect())

    def _written(self, rows: DataFrame) -> tuple[str, list[int]]:
        """A new folder with the rows by bucket; a bucket that is much larger than others is written by several tasks."""
        folder = f"data-{uuid.uuid4().hex}"
        named = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema])
        placed = named.withColumn("bucket", self.bucket(F.col(f"`{self.key}`"))).hint("rebalance", "bucket")
        placed.write.mode("errorifexists").partitionBy("bucket").parquet(f"{self.base}/{folder}")
        names = _names(self.spark, f"{self.base}/{folder}")
        return folder, [int(n.removeprefix("bucket=")) for n in names if n.startswith("bucket=")]

    def _committed(self, folders: dict[int, list[str]]) -> KeyedTable:
        version = self.version + 1
        record = {
            "key": self.key, "buckets": self.buckets, "schema": self.schema.jsonValue(),
            "folders": {str(b): f for b, f in sorted(folders.items()) if f},
        }
        if not _create_once(self.spark, f"{self.base}/log/{version:020d}.json", json.dumps(record)):
            raise Conflict(f"{self.base} has a version {version} already; open it again and repeat the change")
        return KeyedTable(self.spark, self.base, version, self.key, self.buckets, self.schema, folders)

    def append(self, rows: DataFrame) -> KeyedTable:
        """Add rows; no file that is there is read or written."""
        folder, buckets = self._written(rows)
        return self._committed({**self.folders, **{b: [*self.folders.get(b, []), folder] for b in buckets}})

    def change(self, keys: DataFrame, next_state: Callable[[DataFrame], DataFrame]) -> KeyedTable:
        """Rewrite the buckets of some keys: ``next_state`` makes their new rows out of their rows.

        New rows must have keys of these buckets, as rows of the keys themselves do.
        """
        touched = self.touched(keys)
        if not touched:
            return self
        folder, buckets = self._written(next_state(self.rows(touched)))
        if not set(buckets) <= set(touched):
            raise ValueError("a change made rows of keys that it was not about")
        left = {b: f for b, f in self.folders.items() if b not in touched}
        return self._committed(left | {b: [folder] for b in buckets})

    def add_absent(self, rows: DataFrame, order: list[str] | None = None) -> KeyedTable:
        """Append the rows whose key is not there; only the buckets of their keys are looked at."""
        there = self.rows(self.touched(rows))
        known = there.select(F.col(f"`{self.key}`").alias("_known")).distinct()
        fresh = rows.join(known, F.col(f"`{self.key}`") == F.col("_known"), "left_anti")
        return self.append(insert_if_absent(there.limit(0), self.key, fresh, order))


def create_keyed(rows: DataFrame, base: str, key: str, buckets: int) -> KeyedTable:
    """A new table at ``base`` with its first version."""
    spark = rows.sparkSession
    log = _path(spark, f"{base}/log")
    log.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(log)
    empty = KeyedTable(spark, base, 0, key, buckets, rows.schema, {})
    return empty.append(rows)


def open_keyed(spark: SparkSession, base: str, version: int | None = None) -> KeyedTable:
    """The table at its latest version, or at an earlier one."""
    versions = sorted(int(n[:20]) for n in _names(spark, f"{base}/log") if n.endswith(".json"))
    if not versions or (version is not None and version not in versions):
        raise FileNotFoundError(f"no such version of a table at {base}")
    number = versions[-1] if version is None else version
    known = json.loads(_read_text(spark, f"{base}/log/{number:020d}.json"))
    folders = {int(b): f for b, f in known["folders"].items()}
    return KeyedTable(spark, base, number, known["key"], known["buckets"], StructType.fromJson(known["schema"]), folders)
