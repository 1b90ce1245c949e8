"""Merging a parse into stored tables, without a lakehouse format: joins, then a swap of the source's partition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import names


def latest(rows: DataFrame, key: str = "uid", order: tuple[str, ...] = ("ord",)) -> DataFrame:
    """One row of each key: the last by ``order`` (columns that ``rows`` lacks don't count), then by a hash of all columns."""
    if not rows.columns or key not in rows.columns:
        raise ValueError(f"no column {key}")
    by = [F.col(c) for c in order if c in rows.columns]
    whole = F.struct(*(F.col(f"`{c}`") for c in rows.columns))
    one = rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(whole, F.struct(*by, F.xxhash64(*(F.col(f"`{c}`") for c in rows.columns)))).alias("_row"))
    return one.select("_row.*")


def merge(old: DataFrame, new: DataFrame, key: str = "uid", order: tuple[str, ...] = ("ord",)) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key ``new`` lacks.  Of repeated keys within ``new`` the `latest` counts."""
    return latest(new, key, order).unionByName(old.join(new.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def insert_only(old: DataFrame, new: DataFrame, key: str = "uid", order: tuple[str, ...] = ("ord",)) -> DataFrame:
    return old.unionByName(latest(new, key, order).join(old.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def stale(old: DataFrame, live: DataFrame, source: str, key: str = "uid") -> DataFrame:
    """Stored rows of the source that the new parse no longer has."""
    return old.where(F.col("source") == source).join(live.select(key).distinct(), key, "left_anti")


def without_source(rows: DataFrame, source: str) -> DataFrame:
    """All rows but those of the source; rows without a source stay."""
    return rows.where(~F.col("source").eqNullSafe(source))


def refresh(old: DataFrame, new: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """(all rows after the source is replaced, deleted counts by type).  Rows of other sources, and of none, stay."""
    gone = stale(old, new, source).groupBy("type").agg(F.count("*").alias("n"))
    return without_source(old, source).unionByName(latest(new), allowMissingColumns=True), gone


def refresh_graph(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, source: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, deleted counts by type) after a source was parsed again.

    Its edges are the new ones; edges of other sources to nodes that are gone go with them, edges to a name alone stay.
    """
    own, gone = refresh(nodes, new_nodes, source)
    lost = stale(nodes, new_nodes, source).select("uid").distinct()
    kept = without_source(edges, source).join(lost, F.col("src_uid") == F.col("uid"), "left_anti").join(lost, F.col("dst_uid") == F.col("uid"), "left_anti")
    return own, kept.unionByName(new_edges.dropDuplicates(), allowMissingColumns=True), gone


def clear_source(nodes: DataFrame, edges: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without the source and without edges at its nodes."""
    lost = nodes.where(F.col("source") == source).select("uid").distinct()
    kept = without_source(edges, source).join(lost, F.col("src_uid") == F.col("uid"), "left_anti").join(lost, F.col("dst_uid") == F.col("uid"), "left_anti")
    return without_source(nodes, source), kept


def clear_all(nodes: DataFrame, edges: DataFrame, keep: tuple[str, ...] = ("TestNode", "TestFixtureNode", "LiteralNode")) -> tuple[DataFrame, DataFrame]:
    """Both tables emptied, but for nodes of the types to ``keep`` (tests, fixtures and literals, as a store's clear-all leaves them)."""
    own = nodes.where(F.col("type").isin(*keep)) if keep else nodes.where("false")
    return own, edges.where("false")


def detach(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends exist."""
    ids = nodes.select("uid").distinct()
    have = edges.join(ids, edges.src_uid == ids.uid, "left_semi")
    return have.join(ids, have.dst_uid == ids.uid, "left_semi")


def keep_descriptions(new: DataFrame, old: DataFrame) -> DataFrame:
    """New rows whose description is a placeholder take the stored one of their qualified name."""
    rich = old.where(~names.is_placeholder(F.col("description"), strict=False)).groupBy("qualified_name").agg(F.min("description").alias("_rich"))
    both = new.join(rich, "qualified_name", "left")
    own = F.when(names.is_placeholder(F.col("description"), strict=False), F.coalesce("_rich", "description")).otherwise(F.col("description"))
    return both.withColumn("description", own).drop("_rich")


def replace_stubs(stubs: DataFrame, full: DataFrame) -> DataFrame:
    """Full rows stand for the stub of their base refid; a stub's brief stays where the full row has none."""
    base = F.substring_index("refid", "#", 1)
    s = stubs.groupBy(base.alias("_base")).agg(F.min("brief_description").alias("_brief"))
    f = full.withColumn("_base", base)
    own = f.join(s, "_base", "left").withColumn("brief_description", F.coalesce(F.nullif("brief_description", F.lit("")), "_brief")).drop("_brief", "_base")
    left = stubs.withColumn("_base", base).join(f.select("_base"), "_base", "left_anti").drop("_base")
    return own.unionByName(left, allowMissingColumns=True)


def write_source(df: DataFrame, path: str) -> None:
    """Replaces only the partitions of the sources in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(path)
