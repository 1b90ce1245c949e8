"""Tables written once to the folder that all executors share, so that what reads them doesn't make them again."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; only a local session without one gets a temporary folder."""
    own = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not own:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = "file://" + tempfile.mkdtemp(prefix="codeloom-")
        spark.conf.set("spark.checkpoint.dir", own)
    return own.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    """The path of a folder that is removed when the driver ends."""
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    path = new_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _sweep() -> None:
    for spark, path in _written:
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001, S112 - the session may be gone, or one folder; the others still go
            continue
