"""Tables written once and read again, in the folder all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder named in ``spark.checkpoint.dir``.

    Only where a local session names none (tests, a laptop) a temporary folder is
    made and set, so that later calls find the same one; on a cluster that is an error.
    """
    own = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not own:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = "file://" + tempfile.mkdtemp(prefix="codeloom-")
        spark.conf.set("spark.checkpoint.dir", own)
    return own.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001, S112 - the session may be gone, or one folder; the others still go
            continue


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage ends there.

    A lost executor costs the tasks that read the table, never the work that
    made it.  The files go when the driver process ends or `discard` is called.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._codeloom_path = path
    return out


def discard(df: DataFrame) -> None:
    """Removes the files of a table that `materialize` wrote and nothing reads any more."""
    path = getattr(df, "_codeloom_path", None)
    if path:
        _remove(df.sparkSession, path)
        _written[:] = [(s, p) for s, p in _written if p != path]


def fresh(taken, *names: str) -> list[str]:
    """Working column names that no column of ``taken`` has, in any case."""
    low = {c.lower() for c in taken}
    out = []
    for n in names:
        while n.lower() in low:
            n = "_" + n
        low.add(n.lower())
        out.append(n)
    return out


def row_key(doc_id: str = "doc_id", text: str = "text") -> tuple[Column, Column]:
    """Two hashes, 96 bits together and never null, that stand for a row's id and text."""
    return F.xxhash64(doc_id, text).alias("k1"), F.hash(text, doc_id).alias("k2")
