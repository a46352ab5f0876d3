"""Running a streaming operator over a whole table and reading back what it gave out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.plans.sizing import scratch_path


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table, one file or a folder of part files, as a file stream; reading its schema fails if there is none."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    # A stream reads the files of a folder; a glob also takes a single file, whose folder has other tables.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def run_once(spark: SparkSession, stream: DataFrame, label: str) -> DataFrame:
    """Process all that is there, with state and output in the shared folder."""
    path = scratch_path(spark, label)
    running = (
        stream.writeStream.format("parquet")
        .option("path", f"{path}/out")
        .option("checkpointLocation", f"{path}/state")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
