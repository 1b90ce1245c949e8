"""Qualified names that stand in texts, source tags, and cuts of a graph by source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom import schema
from codeloom.operators import resolve

NAME = r"\b(\w+(?:::\w+)+)\b"
FIELDS = ("type_signature", "definition", "argsstring", "brief_description", "description")
WIDE_FIELDS = ("type_signature", "definition", "brief_description", "detailed_description")


def mentions(nodes: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(src_uid, name): each qualified name that a node's texts hold, once."""
    text = F.concat_ws(" ", *(F.col(c) for c in fields if c in nodes.columns))
    return nodes.select(F.col("uid").alias("src_uid"), F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(NAME), 1))).alias("name"))


def _fresh(found: DataFrame, edges: DataFrame, source: str | None) -> DataFrame:
    """DEPENDS_ON edges that ``edges`` lacks, none from a node to itself."""
    new = found.where("src_uid <> dst_uid").select("src_uid", "dst_uid").distinct()
    new = new.join(edges.where("dst_uid is not null").select("src_uid", "dst_uid").distinct(), ["src_uid", "dst_uid"], "left_anti")
    return schema.conform(new.select("src_uid", "dst_uid", F.lit("DEPENDS_ON").alias("rel_type"), F.lit(source).cast("string").alias("source")), schema.EDGES)


def exact_references(nodes: DataFrame, edges: DataFrame, source: str) -> DataFrame:
    """DEPENDS_ON edges from the source's nodes to those whose qualified name their texts hold.

    No edge is given where the node has one to that target already, whatever its kind.  Of
    nodes that share a qualified name the last one counts.
    """
    known = nodes.where("qualified_name is not null").groupBy(F.col("qualified_name").alias("name")).agg(F.max_by("uid", F.struct("ord", "uid")).alias("dst_uid"))
    return _fresh(mentions(nodes.where(F.col("source") == source), FIELDS).join(known, "name"), edges, source)


def prefix_references(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """DEPENDS_ON edges from all nodes to the longest known prefix of each qualified name in their texts."""
    known = nodes.where("qualified_name is not null").groupBy(F.col("qualified_name").alias("known")).agg(F.max_by("uid", F.struct("ord", "uid")).alias("dst_uid"))
    own = nodes.where(F.col("type").isin(*schema.COMPOUNDS, *schema.MEMBERS))
    return _fresh(resolve.longest_prefix(mentions(own, WIDE_FIELDS), "name", known, "known"), edges.where("rel_type = 'DEPENDS_ON'"), None)


def tag_sources(nodes: DataFrame, folders: dict[str, str], project: str, project_dir: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """Nodes with their source and tags: by the folder their file lies in, else by namespace, else by refid, else the project's.

    folders: a dependency's name to its folder.  aliases: further namespaces (``testing`` of gtest).
    Dependencies are few; each rule is one expression over the node's own columns.
    """

    def first(rules: list) -> F.Column:
        return F.coalesce(*(F.when(c, F.lit(v)) for c, v in rules), F.lit(None))

    at, qn, refid = (F.coalesce(c, F.lit("")) for c in ("file_path", "qualified_name", "refid"))
    inside = lambda folder: (at == folder.rstrip("/")) | at.startswith(folder.rstrip("/") + "/")
    # a nested folder stands before the one around it
    by_folder = first([(inside(project_dir), project)] + [(inside(d), n) for n, d in sorted(folders.items(), key=lambda x: -len(x[1]))])
    spaces = {n: n for n in folders} | (aliases if aliases is not None else {"testing": "gtest"})
    by_space = first([((qn == s) | qn.startswith(s + "::"), n) for s, n in spaces.items()])
    by_refid = first([(refid.contains(n), n) for n in folders])
    source = F.coalesce(by_folder, by_space, by_refid, F.lit(project))
    return nodes.withColumn("source", source).withColumn("tags", F.array(F.when(F.col("source") == project, "as-built").otherwise("dependency")))


def split_by_source(nodes: DataFrame, edges: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """The source's nodes, and the edges that start at them; calls also where they end at one."""
    own = nodes.where(F.col("source") == source)
    ids = own.select("uid").distinct()
    starts = edges.join(ids, F.col("src_uid") == F.col("uid"), "left_semi")
    ends = edges.where("rel_type = 'INVOKES'").join(ids, F.col("dst_uid") == F.col("uid"), "left_semi").join(ids, F.col("src_uid") == F.col("uid"), "left_anti")
    return own, starts.unionByName(ends)


def concat(graphs: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """All rows of several parses; repeated ones stay."""
    add = lambda a, b: a.unionByName(b, allowMissingColumns=True)
    return reduce(add, (n for n, _ in graphs)), reduce(add, (e for _, e in graphs))


def live(*tables: DataFrame) -> DataFrame:
    """Distinct uids of all tables: what a new parse still has."""
    return reduce(lambda a, b: a.unionByName(b), (t.select("uid") for t in tables)).distinct()


def accumulate_sources(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row a refid, the last of the new rows where there is one, with the sorted list of all its sources, by commas."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    parts = both.select("refid", F.explode(F.split(F.coalesce("source", F.lit("")), ",")).alias("s")).where("s <> ''")
    listed = parts.groupBy("refid").agg(F.concat_ws(",", F.array_sort(F.collect_set("s"))).alias("source"))
    rest = [c for c in both.columns if c not in ("source", "_new")]
    row = both.groupBy(F.col("refid").alias("_r")).agg(F.max_by(F.struct(*rest), F.struct("_new", F.xxhash64(*rest))).alias("x")).select("x.*")
    return row.join(listed, "refid", "left")


def neighbourhood(nodes: DataFrame, edges: DataFrame, source: str, types: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The source's nodes (of these types, if given), what their edges lead to, and the namespaces around those; with the edges between."""
    own = nodes.where(F.col("source") == source)
    own = own.where(F.col("type").isin(*types)) if types else own
    near = edges.join(own.select("uid"), F.col("src_uid") == F.col("uid"), "left_semi").select(F.col("dst_uid").alias("uid"))
    ids = own.select("uid").unionByName(near.where("uid is not null")).distinct()
    around = edges.where("rel_type = 'COMPOSES'").join(ids, F.col("dst_uid") == F.col("uid"), "left_semi").select(F.col("src_uid").alias("uid"))
    around = around.join(nodes.where("type = 'NamespaceNode'").select("uid"), "uid", "left_semi")
    ids = ids.unionByName(around).distinct()
    kept = edges.join(ids, F.col("src_uid") == F.col("uid"), "left_semi").join(ids, F.col("dst_uid") == F.col("uid"), "left_semi")
    return nodes.join(ids, "uid", "left_semi"), kept
