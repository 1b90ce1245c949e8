from pyspark.sql import functions as F

from codeloom import schema, tools
from codeloom.operators import references as R

NODES = "uid string, type string, source string, qualified_name string, name string, definition string, brief_description string, detailed_description string, file_path string, refid string, ord long"


def graph(spark):
    rows = [
        ("1", "ClassNode", "p", "p::A", "A", "class p::A : lib::Vec", "uses lib::Vec::push and q::none, std::string", None, "/w/p/a.h", "r1", 1),
        ("2", "ClassNode", "lib", "lib::Vec", "Vec", "see p::A", None, "lib::Vec again", "/w/deps/lib/v.h", "r2", 2),
        ("3", "ClassNode", "std", "std::string", "string", None, None, None, None, "r3", 3),
        ("4", "NamespaceNode", None, "lib", "lib", None, None, None, None, "r4", 4),
        ("5", "FunctionNode", "p", "f", "f", None, "calls std::string", None, "/w/p/b.cpp", "r5", 5),
        ("6", "NamespaceNode", None, "testing::internal", "internal", None, None, None, None, "r6", 6),
        ("7", "FunctionNode", None, "zip", "zip", None, None, None, None, "lib_zip", 7),
    ]
    nodes = schema.conform(spark.createDataFrame(rows, NODES), schema.NODES)
    edges = schema.conform(spark.createDataFrame([("1", "3", "DEPENDS_ON", "p"), ("4", "2", "COMPOSES", None), ("2", "5", "INVOKES", "lib"), ("5", "1", "INVOKES", "p")], "src_uid string, dst_uid string, rel_type string, source string"), schema.EDGES)
    return nodes, edges


def ends(edges):
    return sorted((r.src_uid, r.dst_uid) for r in edges.collect())


def test_text_references(spark):
    nodes, edges = graph(spark)
    assert ends(R.exact_references(nodes, edges, "p")) == [("1", "2"), ("5", "3")]
    assert ends(R.prefix_references(nodes, edges)) == [("1", "2"), ("2", "1"), ("5", "3")]


def test_source_tags(spark):
    nodes, _ = graph(spark)
    got = {r.uid: (r.source, r.tags) for r in R.tag_sources(nodes, {"lib": "/w/deps/lib"}, "p", "/w/p").collect()}
    assert {k: v[0] for k, v in got.items()} == {"1": "p", "2": "lib", "3": "p", "4": "lib", "5": "p", "6": "gtest", "7": "lib"}
    assert got["1"][1] == ["as-built"] and got["2"][1] == ["dependency"]


def test_cuts(spark):
    nodes, edges = graph(spark)
    own, kept = R.split_by_source(nodes, edges, "p")
    assert {r.uid for r in own.collect()} == {"1", "5"} and ends(kept) == [("1", "3"), ("2", "5"), ("5", "1")]
    near, kept = R.neighbourhood(nodes, edges, "lib")
    assert {r.uid for r in near.collect()} == {"2", "4", "5"} and ends(kept) == [("2", "5"), ("4", "2")]
    both = R.concat([(nodes, edges), (nodes, edges)])
    assert both[0].count() == 14 and R.live(*both[:1]).count() == 7
    acc = R.accumulate_sources(nodes, nodes.where("uid = '1'").withColumn("source", F.lit("a,p")))
    assert {r.refid: r.source for r in acc.collect()}["r1"] == "a,p" and acc.count() == 7


def test_browse_and_search(spark):
    t = tools.GraphTools(*graph(spark))
    got = {(r.namespace, r.node_type, r.qualified_name) for r in t.browse_namespace().collect()}
    assert got == {("lib", "compound", "lib::Vec"), ("testing::internal", "compound", None)}
    assert [r.name for r in t.search_symbols("string").collect()][0] == "string"
    assert [r.name for r in t.search_symbols("strin").collect()] == ["string"]  # no such word: names that contain it
    assert [r.name for r in t.search_documentation("gain").collect()] == ["Vec"]
    assert t.search_symbols("nowhere").count() == 0
    assert t.get_member("f").first().params[0].position is None


def test_schemas(spark):
    got = {s["name"]: s for s in tools.schemas()}
    assert len(got) == 8 and got["search_symbols"]["input_schema"]["required"] == ["query"] and got["browse_namespace"]["input_schema"]["properties"]["limit"] == {"type": "integer", "default": 50}
    t = tools.GraphTools(*graph(spark))
    assert tools.call(t, "get_compound", {"name": "Vec"})[0]["qualified_name"] == "lib::Vec"
    try:
        tools.call(t, "owners", {})
        raise AssertionError("a method without a schema was called")
    except ValueError:
        pass
