"""Graph JSON, flat JSON and bulk-load CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import names
from codeloom.operators import upsert


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each node with its outgoing edges as an array of structs."""
    kinds = nodes.select(F.col("uid").alias("dst_uid"), F.col("type").alias("target_type"))
    e = edges.join(kinds, "dst_uid", "left")
    e = e.groupBy(F.col("src_uid").alias("uid")).agg(F.array_sort(F.collect_list(F.struct(F.col("rel_type").alias("relation_type"), F.coalesce("dst_uid", "dst_name").alias("target_uid"), "target_type"))).alias("edges"))
    return nodes.join(e, "uid", "left")


def write_graph_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    graph_json(nodes, edges).write.mode("overwrite").json(path)


def write_flat_json(nodes: DataFrame, edges: DataFrame, path: str, source: str) -> None:
    """A folder for each list; implementations stay out, as do the edges to them."""
    nodes.where("type <> 'ImplementationNode'").drop("implementation", "impl_embedding").write.mode("overwrite").partitionBy("type").json(f"{path}/nodes")
    edges.where("rel_type <> 'HAS_IMPLEMENTATION'").write.mode("overwrite").partitionBy("rel_type").json(f"{path}/edges")
    meta = nodes.sparkSession.range(1).select(F.lit(source).alias("source"), F.current_timestamp().alias("generated_at"), F.lit(1).alias("format_version"))
    meta.write.mode("overwrite").json(f"{path}/metadata")


def bulk_nodes(nodes: DataFrame) -> DataFrame:
    """Columns in sorted order, lists as JSON text, booleans in lower case."""
    cols = []
    for c, t in sorted(nodes.dtypes):
        if c not in ("uid", "type"):
            cols.append((names.json_list(F.col(c)) if t.startswith("array") else F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c))
    return nodes.select(F.col("uid").alias("uid:ID"), F.col("type").alias(":LABEL"), *cols)


def bulk_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    e = upsert.detach(edges.where("src_uid <> '' and dst_uid <> ''"), nodes)
    return e.select(F.col("src_uid").alias(":START_ID"), F.col("dst_uid").alias(":END_ID"), F.col("rel_type").alias(":TYPE"), "included_file", "is_local", "position")


def write_csv(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    options = {"header": True, "quoteAll": True, "escape": '"'}
    bulk_nodes(nodes).write.mode("overwrite").options(**options).csv(f"{path}/nodes")
    bulk_edges(nodes, edges).write.mode("overwrite").options(**options).csv(f"{path}/relationships")
