"""A file-source stream that keeps a table of nodes fresh: each batch replaces the files that it names, and nothing else.

The table is a log: batch n writes its rows to the folder batch=n, so a batch that is run again after a failure
overwrites itself.  `current` reads, for each unit (source and file), the rows of its last batch; `compact` writes that
state as a single batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import upsert

UNIT = ("source", "file_path")


def write_batch(rows: DataFrame, path: str, number: int) -> None:
    """Rows of one batch; of repeated uids the latest."""
    upsert.latest(rows).write.mode("overwrite").parquet(f"{path}/batch={number}")


def refresh_on_arrival(stream: DataFrame, parse: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Starts the query; each batch is parsed, and its rows stand for the files that they name.

    A file that is to vanish arrives as a batch with one row of type 'gone' and its source and file_path.
    """

    def batch(df: DataFrame, number: int) -> None:
        write_batch(parse(df), path, number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    """The rows of each unit's last batch.  Rows without a file (namespaces) all stay, the last of each uid."""
    log = spark.read.parquet(path)
    filed = log.where("file_path is not null")
    last = filed.groupBy(*UNIT).agg(F.max("batch").alias("_b")).select(F.col("source").alias("_s"), F.col("file_path").alias("_f"), "_b")
    rows = filed.join(last, F.col("source").eqNullSafe(F.col("_s")) & (F.col("file_path") == F.col("_f")) & (F.col("batch") == F.col("_b")), "left_semi")
    rows = rows.where("type is null or type <> 'gone'").unionByName(log.where("file_path is null"))
    return upsert.latest(rows, order=("batch", "ord")).drop("batch")


def compact(spark: SparkSession, path: str, to: str) -> None:
    """The current state as batch 0 of a new log."""
    current(spark, path).write.mode("overwrite").parquet(f"{to}/batch=0")
