import pytest
from pyspark.sql import functions as F

from codeloom.functions import names
from codeloom.operators import fulltext, resolve, traverse, upsert
from codeloom.sources import python_source, sinks
from codeloom.tools import GraphTools

FILES = {
    "shop/__init__.py": "from .base import Item\n",
    "shop/base.py": 'from abc import ABC\nimport os\n\nclass Priced(ABC):\n    """Has a price."""\n    def price(self) -> float: ...\n\nclass Item:\n    """A thing on sale."""\n    stock: int = 0\n\n    def total(self, n: int = 1) -> float:\n        return self.unit() * n\n\n    def unit(self) -> float:\n        return helper(2.0)\n\ndef helper(x: float) -> float:\n    return x\n',
    "shop/more.py": "import enum\nfrom shop.base import Item, helper\n\nclass Colour(enum.Enum):\n    RED = 1\n\nclass Book(Item):\n    def unit(self):\n        return helper(1)\n\nclass Novel(Book):\n    pass\n\ndef buy(item: Item, *, fast=False):\n    item.total()\n    return helper(3)\n",
    "shop/broken.py": "def (:\n",
}


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("src")
    for name, text in FILES.items():
        p = root / name
        p.parent.mkdir(exist_ok=True)
        p.write_text(text)
    nodes, edges = python_source.read(spark, str(root), "shop")
    return nodes.cache(), edges.cache()


def _edges(graph, kind):
    nodes, edges = graph
    n = nodes.select("uid", "qualified_name")
    e = edges.where(F.col("rel_type") == kind).join(n.toDF("src_uid", "a"), "src_uid").join(n.toDF("dst_uid", "b"), "dst_uid")
    return {(r.a, r.b) for r in e.collect()}


def test_nodes(graph):
    got = {(r.type, r.qualified_name) for r in graph[0].collect()}
    assert {("InterfaceNode", "shop.base.Priced"), ("ClassNode", "shop.more.Book"), ("EnumNode", "shop.more.Colour"), ("EnumValueNode", "shop.more.Colour.RED"), ("FunctionNode", "shop.more.buy"), ("AttributeNode", "shop.base.Item.stock")} <= got
    assert not any("broken" in q for _, q in got)
    assert graph[0].count() == graph[0].select("uid").distinct().count()


def test_edges(graph):
    assert _edges(graph, "INHERITS_FROM") == {("shop.more.Book", "shop.base.Item"), ("shop.more.Novel", "shop.more.Book")}
    calls = _edges(graph, "INVOKES")
    assert ("shop.base.Item.total", "shop.base.Item.unit") in calls and ("shop.more.buy", "shop.base.helper") in calls and ("shop.more.buy", "shop.base.Item.total") in calls
    assert ("shop.more.buy", "shop.base.Item") in _edges(graph, "DEPENDS_ON")
    assert ("shop.more", "shop.base") in _edges(graph, "INCLUDES")
    assert ("shop.base", "shop.base.Item") in _edges(graph, "COMPOSES")


def test_tools(graph):
    t = GraphTools(*graph)
    assert {r.qualified_name: r.depth for r in t.find_inheritance("Novel", "up").collect()} == {"shop.more.Book": 1, "shop.base.Item": 2}
    assert {r.qualified_name for r in t.get_class_hierarchy("shop.base.Item").where("relation = 'derived'").collect()} == {"shop.more.Book", "shop.more.Novel"}
    assert [r.caller_name for r in t.get_callers("total").collect()] == ["buy"]
    assert {r.callee_name for r in t.get_callees("buy").collect()} == {"helper", "total"}
    assert t.find_class("Book").count() == 1 and t.find_function("unit", "Item").count() == 1
    assert t.search_symbols("sale").first().name == "Item"
    assert [p.name for p in t.get_function_parameters("buy").first().parameters] == ["item", "fast"]
    assert {r.member_name for r in t.get_compound("Item").collect()} == {"stock", "total", "unit"}
    assert t.get_compound("Novel").first().member_name is None
    for df in (t.list_sources(), t.get_statistics(), t.browse_namespace("shop.base"), t.get_file_symbols("more.py"), t.list_namespaces(), t.list_classes("shop"), t.get_class_members("Item"), t.get_includes("base.py"), t.find_callers_and_callees("helper"), t.get_member("total"), t.search_documentation("thing"), t.get_include_chain("base.py")):
        df.collect()


def test_sinks(graph, spark, tmp_path):
    sinks.write_csv(*graph, str(tmp_path / "csv"))
    sinks.write_graph_json(*graph, str(tmp_path / "g"))
    sinks.write_flat_json(*graph, str(tmp_path / "f"), "shop")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv/nodes")).count() == graph[0].count()
    assert spark.read.json(str(tmp_path / "g")).count() == graph[0].count()


def test_names(spark):
    df = spark.createDataFrame([("a::b::c", "(int x, const T & y = 3)", "Foo<Bar> ")], "q string, a string, t string")
    r = df.select(names.parent_name(F.col("q")).alias("p"), names.short_name(F.col("q")).alias("s"), names.prefixes(F.col("q")).alias("x"), names.normal_args(F.col("a")).alias("a"), names.primary_template(F.col("t")).alias("t"), names.normal_args(F.lit("(void)")).alias("v")).first()
    assert (r.p, r.s, r.x, r.t, r.v) == ("a::b", "c", ["a", "a::b"], None, "()") or r.t == "Foo"
    assert r.a.startswith("(int,")


def test_resolution_and_paths(spark):
    s = spark.createDataFrame([("1", "a.f", 0), ("2", "b.f", 1), ("3", "b.g", 2)], "uid string, qualified_name string, ord long")
    refs = spark.createDataFrame([("x", "f", "b"), ("y", "f", "c"), ("z", "g", "c"), ("w", "a.f", "b")], "ref_id string, ref_name string, scope string")
    assert {r.ref_id: r.target for r in resolve.resolve(refs, s).collect()} == {"x": "2", "z": "3", "w": "1"}
    e = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "root string")
    assert sorted((r.node, r.depth) for r in traverse.paths(e, start, 2).collect()) == [("b", 1), ("c", 1), ("d", 2), ("d", 2)]
    assert {r.node for r in traverse.reachable(e, start).collect()} == {"a", "b", "c", "d"}
    spans = spark.createDataFrame([("t", 1, 70, 1), ("t", 60, 90, 2)], "g string, a int, b int, k int")
    pts = spark.createDataFrame([("t", 65), ("t", 80), ("t", 99)], "g string, at int")
    assert sorted((r["at"], r.k) for r in resolve.within(pts, spans, "g", "at", "a", "b", ["k"]).collect()) == [(65, 1), (80, 2)]
    table = spark.createDataFrame([("a",), ("a::b",)], "p string")
    assert resolve.longest_prefix(spark.createDataFrame([("a::b::c",)], "q string"), "q", table, "p").first().p == "a::b"


def test_upsert(spark):
    ddl = "uid string, type string, source string, qualified_name string, description string"
    old = spark.createDataFrame([("1", "A", "s", "q1", "good words"), ("2", "A", "s", "q2", ""), ("3", "A", "o", "q3", "")], ddl)
    new = spark.createDataFrame([("1", "A", "s", "q1", "Setup block"), ("4", "A", "s", "q4", "")], ddl)
    assert {r.uid for r in upsert.merge(old, new).collect()} == {"1", "2", "3", "4"}
    both, gone = upsert.refresh(old, new, "s")
    assert {r.uid for r in both.collect()} == {"1", "3", "4"} and gone.first().n == 1
    assert {r.uid: r.description for r in upsert.keep_descriptions(new, old).collect()}["1"] == "good words"
    assert fulltext.search(old, "uid", "description", '"good words"').count() == 1


def test_fuzzy_search_takes_all_terms_and_joins_them(spark):
    from codeloom.operators import fulltext

    rows = [(k, f"word{chr(97 + k // 26)}{chr(97 + k % 26)} plain") for k in range(120)] + [(500, "plain only")]
    docs = spark.createDataFrame(rows, "id long, text string")
    assert {r.id for r in fulltext.search(docs, "id", "text", "word~2", 1000).collect()} == set(range(120))
    assert {r.id for r in fulltext.search(docs, "id", "text", "plain AND word~2", 1000).collect()} == set(range(120))
