"""Scoped name resolution: one join plan behind inheritance, types, calls and imports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import names


def resolve(refs: DataFrame, symbols: DataFrame, sep: str = ".") -> DataFrame:
    """refs (ref_id, ref_name, scope) with the symbol (target) that each name means.

    An exact qualified name wins; else the first candidate of that short name in
    the same scope, in parse order; else the only candidate; else none (the row
    is left out).  symbols: (uid, qualified_name, ord).
    """
    s = symbols.select("uid", "qualified_name", "ord", names.short_name(F.col("qualified_name"), sep).alias("_short"), names.parent_name(F.col("qualified_name"), sep).alias("_scope"))
    first = s.groupBy("qualified_name").agg(F.min_by("uid", F.struct("ord", "uid")).alias("exact"))
    exact = refs.join(first, refs.ref_name == first.qualified_name, "left").drop("qualified_name")
    done = exact.where("exact is not null").select("ref_id", F.col("exact").alias("target"))
    open_ = exact.where("exact is null").withColumn("_short", names.short_name(F.col("ref_name"), sep))
    # candidates shrink to one row per (name, scope) and one per name before any join
    by_scope = s.groupBy("_short", "_scope").agg(F.min_by("uid", F.struct("ord", "uid")).alias("near"))
    by_name = s.groupBy("_short").agg(F.count("*").alias("n"), F.min("uid").alias("only"))
    near = open_.join(by_scope, (open_["_short"] == by_scope["_short"]) & (open_["scope"] == by_scope["_scope"]), "left").select("ref_id", open_["_short"], "near")
    rest = near.join(by_name, "_short", "left").select("ref_id", F.coalesce("near", F.when(F.col("n") == 1, F.col("only"))).alias("target"))
    return done.unionByName(rest.where("target is not null"))


def by_either_name(refs: DataFrame, symbols: DataFrame, key: str) -> DataFrame:
    """refs joined to symbols whose name OR qualified name is ``key``: two equi-joins, no nested loop."""
    a = refs.join(symbols.withColumn(key, F.col("name")), key)
    b = refs.join(symbols.withColumn(key, F.col("qualified_name")), key)
    return a.unionByName(b).dropDuplicates()


def longest_prefix(rows: DataFrame, key: str, table: DataFrame, prefix: str, sep: str = "::") -> DataFrame:
    """rows with the longest entry of table.prefix that is the key or one of its prefixes.

    Repeated rows stay; rows without an entry, or with a null key, are left out.
    """
    keys = rows.select(key).where(F.col(key).isNotNull()).distinct()
    tried = keys.withColumn(prefix, F.explode(F.concat(F.array(key), names.prefixes(F.col(key), sep))))
    entry = F.struct(*(F.col(c) for c in table.columns))
    best = tried.join(table, prefix).groupBy(key).agg(F.max_by(entry, F.struct(F.length(prefix), F.xxhash64(*table.columns))).alias("_best"))
    return rows.join(best, key).select(*(F.col(c) for c in rows.columns), *(F.col(f"_best.{c}").alias(c) for c in table.columns))


def within(points: DataFrame, spans: DataFrame, on: str, at: str, start: str, end: str, order: list[str], width: int = 64) -> DataFrame:
    """Each point with the first span of its group that contains it: spans are put into bins, so the join is an equi-join.

    Repeated points stay; points in no span, or with a null group or place, are left out.
    """
    p = points.select(on, at).where(F.col(on).isNotNull() & F.col(at).isNotNull()).distinct().withColumn("_bin", F.floor(F.col(at) / width))
    s = spans.where(F.col(end) >= F.col(start)).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    hit = p.join(s, [on, "_bin"]).where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end)))
    rest = [c for c in spans.columns if c != on]
    first = hit.groupBy(on, at).agg(F.min_by(F.struct(*rest), F.struct(*order, F.xxhash64(*rest).alias("_h"))).alias("_first"))
    return points.join(first, [on, at]).select(*points.columns, *(F.col(f"_first.{c}").alias(c) for c in rest))
