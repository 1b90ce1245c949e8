"""Walks over edges: reachability, and paths with bounded depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators import store


def reachable(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(root, node) for all nodes that edges (src, dst) lead to from start (root); each round's frontier is a written table."""
    spark = edges.sparkSession
    folder = store.new_folder(spark, "walk")
    edges = store.materialize(edges.select("src", "dst").distinct(), "edges")  # read in each round
    seen = None
    front = start.select("root", F.col("root").alias("node")).distinct()
    k = 0
    while True:
        step = front.join(edges, front.node == edges.src).select("root", F.col("dst").alias("node")).distinct()
        if seen is not None:
            step = step.join(seen, ["root", "node"], "left_anti")
        step.write.parquet(f"{folder}/k={k}")
        front = spark.read.schema("root string, node string").parquet(f"{folder}/k={k}")
        if front.isEmpty():
            return (seen if seen is not None else front).select("root", "node")
        k += 1
        seen = spark.read.schema("root string, node string").parquet(*(f"{folder}/k={i}" for i in range(k)))


def paths(edges: DataFrame, start: DataFrame, max_depth: int = 5) -> DataFrame:
    """(root, node, depth), a row for each path; no edge occurs twice in one path.

    The depth limit holds inside the walk.  Each level is a written table, so a level is
    joined once, whatever the depth; equal edges count once.
    """
    spark = edges.sparkSession
    folder = store.new_folder(spark, "paths")
    e = store.materialize(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), "edges")
    key = F.concat_ws("\u0001", "src", "dst")
    now = start.select(F.col("root").cast("string").alias("root"), F.col("root").cast("string").alias("node"), F.array().cast("array<string>").alias("via"))
    schema = "root string, node string, via array<string>, depth int"
    levels: list[str] = []
    for depth in range(1, max_depth + 1):
        step = now.join(e, now.node == e.src).withColumn("_e", key).where(~F.array_contains("via", F.col("_e")))
        step = step.select("root", F.col("dst").cast("string").alias("node"), F.concat("via", F.array("_e")).alias("via"), F.lit(depth).alias("depth"))
        step.write.parquet(f"{folder}/{depth}")
        levels.append(f"{folder}/{depth}")
        now = spark.read.schema(schema).parquet(levels[-1]).drop("depth")
        if now.isEmpty():
            break
    if not levels:
        return spark.createDataFrame([], "root string, node string, depth int")
    return spark.read.schema(schema).parquet(*levels).select("root", "node", "depth")
