"""Command line: index sources into stored tables, query them, export them, clear a source.

Tables are kept in a folder, ``nodes`` and ``edges`` partitioned by source; indexing a source again replaces its own
partition only.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom import schema
from codeloom.operators import upsert
from codeloom.sources import doxygen_xml, python_source, reference_pages, sinks
from codeloom.tools import TOOLS, GraphTools, call, schemas

#: Readers by name, each (spark, folder, source) to (nodes, edges); others are added with `register`.
READERS: dict[str, Callable[[SparkSession, str, str], tuple[DataFrame, DataFrame]]] = {"python": python_source.read, "xml": doxygen_xml.read, "pages": reference_pages.read}


def register(name: str, reader: Callable[[SparkSession, str, str], tuple[DataFrame, DataFrame]]) -> None:
    """Adds a reader for another language; a name that is taken is an error."""
    if name in READERS:
        raise ValueError(f"there is a reader {name!r} already")
    READERS[name] = reader


def stored(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a folder; empty tables where nothing is stored yet."""
    out = []
    for name, ddl in (("nodes", schema.NODES), ("edges", schema.EDGES)):
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
        out.append(schema.conform(spark.read.parquet(f"{path}/{name}"), ddl) if there else schema.empty(spark, ddl))
    return out[0], out[1]


def index(spark: SparkSession, path: str, kind: str, folder: str, source: str) -> dict[str, int]:
    """Parses a folder and replaces the source's rows; returns the number of nodes that are gone, by type."""
    old, _ = stored(spark, path)
    nodes, edges = READERS[kind](spark, folder, source)
    gone = {r.type: r.n for r in upsert.refresh(old, nodes, source)[1].collect()}
    # edges may stand without a source of their own: they are their parse's
    for name, rows in (("nodes", nodes), ("edges", edges)):
        upsert.write_source(rows.withColumn("source", F.coalesce("source", F.lit(source))), f"{path}/{name}")
    return gone


def clear(spark: SparkSession, path: str, source: str) -> int:
    """Removes the source's partitions; edges of others that lead to it are left out by `upsert.detach` when read."""
    nodes, _ = stored(spark, path)
    n = nodes.where(F.col("source") == source).count()
    for name in ("nodes", "edges"):
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/source={source}")
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    return n


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("codeloom")
    p.add_argument("--tables", required=True, help="folder of the stored tables")
    sub = p.add_subparsers(dest="command", required=True)
    one = sub.add_parser("index")
    one.add_argument("kind", choices=sorted(READERS))
    one.add_argument("folder")
    one.add_argument("--source", required=True)
    one = sub.add_parser("query")
    one.add_argument("tool", choices=TOOLS)
    one.add_argument("arguments", nargs="?", default="{}", help="JSON object")
    one = sub.add_parser("export")
    one.add_argument("form", choices=("csv", "json", "graph-json"))
    one.add_argument("to")
    one.add_argument("--source")
    one = sub.add_parser("clear")
    one.add_argument("--source", required=True)
    one.add_argument("--yes", action="store_true", help="don't ask")
    sub.add_parser("schemas")
    return p


def main(argv: list[str] | None = None, ask: Callable[[str], str] = input) -> int:
    args = _parser().parse_args(argv)
    if args.command == "schemas":
        print(json.dumps(schemas(), indent=1))
        return 0
    spark = SparkSession.builder.getOrCreate()
    if args.command == "index":
        print(json.dumps({"deleted": index(spark, args.tables, args.kind, args.folder, args.source)}))
    elif args.command == "query":
        print(json.dumps(call(GraphTools(*stored(spark, args.tables)), args.tool, json.loads(args.arguments)), default=str))
    elif args.command == "export":
        nodes, edges = stored(spark, args.tables)
        if args.source:
            nodes, edges = nodes.where(F.col("source") == args.source), edges.where(F.col("source") == args.source)
        if args.form == "json":
            sinks.write_flat_json(nodes, edges, args.to, args.source or "")
        else:
            (sinks.write_csv if args.form == "csv" else sinks.write_graph_json)(nodes, edges, args.to)
    elif args.command == "clear":
        if not args.yes and ask(f"Remove all rows of {args.source!r}? Type its name: ") != args.source:
            print("nothing was removed", file=sys.stderr)
            return 1
        print(json.dumps({"removed": clear(spark, args.tables, args.source)}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
