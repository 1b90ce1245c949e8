"""Descriptions of test nodes by a completion callable: prompts from a test's parts, answers joined back by name."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import names

BATCH = 10
_KINDS = {"TestFixtureNode": "fixture", "TestStepNode": "step", "AssertionNode": "assertion"}
RESULT = "test string, qualified_name string, node_type string, old_description string, new_description string, status string, error string, prompt string"


def children(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(test, said: its description, covered: what it verifies, and each fixture, step and assertion that it composes)."""
    tests = nodes.where("type = 'TestNode'").select(F.col("uid").alias("src_uid"), F.col("qualified_name").alias("test"), F.col("description").alias("said"))
    seen = edges.where("rel_type = 'VERIFIES'").select("src_uid", F.col("dst_uid").alias("uid")).join(nodes.select("uid", "qualified_name"), "uid")
    seen = seen.groupBy("src_uid").agg(F.array_sort(F.collect_set("qualified_name")).alias("covered"))
    own = nodes.where(F.col("type").isin(*_KINDS)).select(F.col("uid").alias("dst_uid"), "type", "name", "qualified_name", "description", "operator", "type_signature", F.coalesce("position", F.lit(0)).alias("position"))
    return edges.where("rel_type = 'COMPOSES'").select("src_uid", "dst_uid").distinct().join(own, "dst_uid").join(tests, "src_uid").join(seen, "src_uid", "left").drop("src_uid", "dst_uid")


def prompt(element: dict, peers: list[dict], test: str, said: str, covered: list[str]) -> str:
    """What is asked of one element: its test, what that verifies, the element, and its neighbours."""
    label = lambda x: f"{_KINDS[x['type']]} {x['name']}" + "".join(f" ({c}: {x[c]})" for c in ("operator", "type_signature", "description") if x.get(c))
    lines = [f"Test {test}" + (f": {said}" if said else "")]
    lines += [f"Code under test: {', '.join(covered)}"] * bool(covered)
    return "\n".join([*lines, f"Describe {label(element)}", "Beside it: " + ("; ".join(label(p) for p in peers) or "nothing")])


def answers(response: str) -> dict[str, str]:
    """The JSON object in a response, with or without a fence and words around it."""
    fenced = re.search(r"```(?:json)?\s*(.*?)```", response, re.S)
    text = fenced[1] if fenced else response
    start, end = text.find("{"), text.rfind("}")
    if start < 0 or end < start:
        raise ValueError("no JSON object in the response")
    got = json.loads(text[start : end + 1])
    if not isinstance(got, dict):
        raise ValueError("the response is no JSON object")
    return {str(k): v if isinstance(v, str) else json.dumps(v) for k, v in got.items()}


def enrich(nodes: DataFrame, edges: DataFrame, complete: Callable[[str, str], str] | None, overwrite: bool = False, batch: int = BATCH, tests: list[str] | None = None) -> DataFrame:
    """A row for each fixture, step and assertion: its new description and status, enriched, skipped or error.

    complete(system, user) is called once for ``batch`` elements of one test, on the
    executors; with None nothing is called (a dry run) and prompts are returned.  Elements with a description of their own
    are skipped unless ``overwrite``.  A call that fails marks its batch alone; an
    element without an answer is skipped.  tests: only these.
    """
    own = children(nodes, edges)
    own = own.where(F.col("test").isin(tests)) if tests is not None else own
    own = own.withColumn("due", F.lit(overwrite) | names.is_placeholder(F.col("description")))
    system = "Describe each element of a test in one or two sentences. Answer with one JSON object: qualified name to description."

    def run(part: pd.DataFrame) -> pd.DataFrame:
        rank = {k: i for i, k in enumerate(_KINDS)}
        every = sorted(part.astype(object).where(part.notna(), None).to_dict("records"), key=lambda r: (rank[r["type"]], r["position"], r["qualified_name"]))
        out = []
        due = [r for r in every if r["due"]]
        asked = {r["qualified_name"]: prompt(r, [p for p in every if p is not r], r["test"], r["said"] or "", list(r["covered"]) if r["covered"] is not None else []) for r in due}
        for r in every:
            if not r["due"]:
                out.append((r["test"], r["qualified_name"], r["type"], r["description"], None, "skipped", "described already", None))
        for at in range(0, len(due), batch):
            some, got, error = due[at : at + batch], {}, None
            user = "\n\n".join(f"## {r['qualified_name']}\n{asked[r['qualified_name']]}" for r in some)
            if complete is not None:
                try:
                    got = answers(complete(system, user))
                except Exception as e:  # noqa: BLE001 - whatever the callable raises is the batch's error
                    error = str(e)
            for r in some:
                new = got.get(r["qualified_name"], "")
                status = "error" if error else "enriched" if new and new != r["description"] else "skipped"
                why = error or (None if status == "enriched" else "dry run" if complete is None else "no new answer")
                out.append((r["test"], r["qualified_name"], r["type"], r["description"], new or None, status, why, asked[r["qualified_name"]]))
        return pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])

    return own.groupBy("test").applyInPandas(run, RESULT)


def apply(nodes: DataFrame, results: DataFrame) -> DataFrame:
    """Nodes with the descriptions of the enriched results."""
    new = results.where("status = 'enriched'").groupBy("qualified_name", F.col("node_type").alias("type")).agg(F.max("new_description").alias("_new"))
    return nodes.join(new, ["qualified_name", "type"], "left").withColumn("description", F.coalesce("_new", "description")).select(*nodes.columns)


def summary(results: DataFrame) -> DataFrame:
    """(status, n) over all elements."""
    return results.groupBy("status").agg(F.count("*").alias("n"))


def write_log(results: DataFrame, path: str, model: str) -> None:
    """Appends what was asked and answered, a JSON line each."""
    results.where("prompt is not null").select(F.current_timestamp().alias("timestamp"), F.lit(model).alias("model"), "qualified_name", "prompt", "new_description", "error").write.mode("append").json(path)
