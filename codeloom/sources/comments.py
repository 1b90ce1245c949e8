"""Descriptions of tests as tagged comments in their sources: read from files, and written back above what they describe.

A block is a tag line ``# <tag> <qualified name>`` and the comment lines below it.  Lines of one paragraph are joined when
read and wrapped when written; an empty comment line ends a paragraph.
"""

from __future__ import annotations

import ast
import re
import textwrap
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import names

TAG = "codeloom:test-desc"
WIDTH = 88
_DESCRIBED = ("TestNode", "TestStepNode", "TestFixtureNode", "AssertionNode")


def _blocks(lines: list[str], tag: str) -> Iterator[tuple[int, int, str]]:
    """(first line, line after the last, qualified name) of each tagged block."""
    head = re.compile(rf"\s*#\s*{re.escape(tag)}\s+(\S+)\s*")
    k = 0
    while k < len(lines):
        found = head.fullmatch(lines[k])
        if not found:
            k += 1
            continue
        end = k + 1
        while end < len(lines) and lines[end].lstrip().startswith("#") and not head.fullmatch(lines[end]):
            end += 1
        yield k, end, found[1]
        k = end


def parse(text: str, tag: str = TAG) -> dict[str, str]:
    """Qualified name to description of each block; of two blocks of one name the later counts."""
    lines, out = text.splitlines(), {}
    for start, end, qn in _blocks(lines, tag):
        said = [re.sub(r"^\s*#\s?", "", x) for x in lines[start + 1 : end]]
        parts = re.split(r"\n{2,}", "\n".join(said).strip("\n"))
        out[qn] = "\n\n".join(p.replace("\n", " ") for p in parts if p).strip()
    return out


def block(qn: str, description: str, indent: str, width: int = WIDTH, tag: str = TAG) -> list[str]:
    """The lines of a block; a tag alone where there is nothing to say yet."""
    out = [f"{indent}# {tag} {qn}"]
    room = max(10, width - len(indent) - 2)
    for k, para in enumerate(p.strip() for p in re.split(r"\n+", description) if p.strip()):
        out += [f"{indent}#"] * (k > 0)
        out += [f"{indent}# {x}" for x in textwrap.wrap(para, room, break_long_words=False, break_on_hyphens=False)]
    return out


def read(files: DataFrame, tag: str = TAG) -> DataFrame:
    """(qualified_name, described) of all tagged blocks in (rel, content); the later file and block counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(rel, k, qn, said) for rel, c in zip(b.rel, b.content) for k, (qn, said) in enumerate(parse(bytes(c).decode("utf-8", "replace"), tag).items())]
            yield pd.DataFrame(rows, columns=["rel", "k", "qualified_name", "described"])

    got = files.select("rel", "content").mapInPandas(run, "rel string, k long, qualified_name string, described string")
    return got.groupBy("qualified_name").agg(F.max_by("described", F.struct("rel", "k")).alias("described"))


def apply(nodes: DataFrame, described: DataFrame) -> DataFrame:
    """Test nodes with what their comments say; an empty block says nothing."""
    own = nodes.join(described, "qualified_name", "left")
    take = F.col("type").isin(*_DESCRIBED) & (F.coalesce("described", F.lit("")) != "")
    return own.withColumn("description", F.when(take, F.col("described")).otherwise(F.col("description"))).drop("described").select(*nodes.columns)


def _anchors(text: str) -> dict[int, tuple[int, str]]:
    """Line of each def to the line a comment on it goes above (its first decorator), and its docstring's first line."""
    out = {}
    try:
        tree = ast.parse(text)
    except SyntaxError:
        return out
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out[node.lineno] = min([node.lineno, *(d.lineno for d in node.decorator_list)]), (ast.get_docstring(node) or "").split("\n")[0]
    return out


def rewrite(text: str, items: list[tuple[str, str, int, str]], scaffold: bool = False, width: int = WIDTH, tag: str = TAG) -> tuple[str, dict[str, int]]:
    """(new text, counts) of a file; items: (type, qualified name, line, description or '' for a placeholder)."""
    n = dict.fromkeys(("written", "scaffolded", "skipped_placeholder", "skipped_docstring"), 0)
    lines, anchors, above = text.splitlines(), _anchors(text), {}
    for kind, qn, line, said in items:
        at, brief = anchors.get(line, (line, None)) if kind == "TestNode" else (line, None)
        if said and said == brief:
            said = ""
            n["skipped_docstring"] += not scaffold
        elif not said:
            n["skipped_placeholder"] += not scaffold
        if not 1 <= at <= len(lines) or not (said or scaffold):
            continue
        n["written" if said else "scaffolded"] += 1
        indent = lines[at - 1][: len(lines[at - 1]) - len(lines[at - 1].lstrip())]
        above.setdefault(at, []).append((qn, said, indent))
    own = {qn for _, qn, _, _ in items}
    gone = {k for start, end, qn in _blocks(lines, tag) if qn in own for k in range(start, end)}
    out: list[str] = []
    for k, line in enumerate(lines):
        for qn, said, indent in sorted(above.get(k + 1, [])):
            out += block(qn, said, indent, width, tag)
        if k not in gone:
            out.append(line)
    return "\n".join(out) + "\n" * text.endswith("\n"), n


def write_back(nodes: DataFrame, files: DataFrame, scaffold: bool = False, width: int = WIDTH, tag: str = TAG) -> DataFrame:
    """(rel, text, changed, written, scaffolded, skipped_placeholder, skipped_docstring) of each file that holds tests.

    Nothing is written to disk here: the caller writes the texts that changed, or leaves it at
    a dry run.  Blocks of the nodes' names are replaced, so a second run changes nothing.
    """
    line = F.when(F.col("type") == "TestStepNode", F.col("body_start")).otherwise(F.col("line_number"))
    said = F.when(names.is_placeholder(F.col("description")), F.lit("")).otherwise(F.col("description"))
    own = nodes.where(F.col("type").isin(*_DESCRIBED) & F.col("file_path").isNotNull()).select(F.col("file_path").alias("rel"), "type", "qualified_name", line.alias("line"), said.alias("said"))

    def run(items: pd.DataFrame, source: pd.DataFrame) -> pd.DataFrame:
        columns = ["rel", "text", "changed", "written", "scaffolded", "skipped_placeholder", "skipped_docstring"]
        if not len(source) or not len(items):
            return pd.DataFrame([], columns=columns)
        old = bytes(source.content.iloc[0]).decode("utf-8", "replace")
        text, n = rewrite(old, [(t, q, int(k or 0), s or "") for t, q, k, s in zip(items.type, items.qualified_name, items.line.fillna(0), items.said)], scaffold, width, tag)
        return pd.DataFrame([(source.rel.iloc[0], text, text != old, *(n[c] for c in columns[3:]))], columns=columns)

    schema = "rel string, text string, changed boolean, written int, scaffolded int, skipped_placeholder int, skipped_docstring int"
    return own.groupBy("rel").cogroup(files.select("rel", "content").groupBy("rel")).applyInPandas(run, schema)
