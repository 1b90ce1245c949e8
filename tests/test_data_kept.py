"""Rows that earlier versions lost: repeated rows, null sources, second batches, empty files."""

import pytest
from pyspark.sql import functions as F

from codeloom.functions import names
from codeloom.operators import resolve, upsert
from codeloom.sources import python_source
from codeloom.streaming import refresh
from codeloom.tools import GraphTools

DDL = "uid string, type string, source string, file_path string, name string"


def test_repeated_rows_survive_resolution(spark):
    table = spark.createDataFrame([("a", 1), ("a::b", 2)], "p string, v int")
    rows = spark.createDataFrame([("a::b::c",), ("a::b::c",), ("x",), (None,)], "q string")
    assert [(r.q, r.p, r.v) for r in resolve.longest_prefix(rows, "q", table, "p").collect()] == [("a::b::c", "a::b", 2)] * 2
    spans = spark.createDataFrame([("t", 1, 70, 1), ("t", 60, 90, 2)], "g string, a int, b int, k int")
    points = spark.createDataFrame([("t", 65), ("t", 65), (None, 65), ("t", None), ("t", 99)], "g string, at int")
    assert [(r["at"], r.k) for r in resolve.within(points, spans, "g", "at", "a", "b", ["k"]).collect()] == [(65, 1)] * 2


def test_refresh_keeps_null_and_other_sources(spark):
    old = spark.createDataFrame([("1", "A", "s", "f", "x"), ("2", "A", None, "f", "x"), ("3", "A", "o", "f", "x")], DDL)
    new = spark.createDataFrame([("4", "A", "s", "f", "b"), ("4", "A", "s", "f", "a")], DDL)
    both, gone = upsert.refresh(old, new, "s")
    assert {r.uid for r in both.collect()} == {"2", "3", "4"} and both.count() == 3 and [(r.type, r.n) for r in gone.collect()] == [("A", 1)]
    edges = spark.createDataFrame([("3", "1", "o"), ("3", "2", "o"), ("1", "2", "s"), ("2", "3", None), ("3", None, "o")], "src_uid string, dst_uid string, source string")
    fresh = spark.createDataFrame([("4", "3", "s")], "src_uid string, dst_uid string, source string")
    nodes, kept, _ = upsert.refresh_graph(old, edges, new, fresh, "s")
    assert {(r.src_uid, r.dst_uid) for r in kept.collect()} == {("3", "2"), ("2", "3"), ("3", None), ("4", "3")}
    nodes, kept = upsert.clear_source(old, edges, "s")
    assert {r.uid for r in nodes.collect()} == {"2", "3"} and {(r.src_uid, r.dst_uid) for r in kept.collect()} == {("3", "2"), ("2", "3"), ("3", None)}
    nodes, kept = upsert.clear_all(old.withColumn("type", F.when(F.col("uid") == "1", "TestNode").otherwise("A")), edges)
    assert [r.uid for r in nodes.collect()] == ["1"] and kept.count() == 0


def test_latest_is_explicit(spark):
    rows = spark.createDataFrame([("1", 2, "new"), ("1", 1, "old"), ("2", 1, "only")], "uid string, ord int, v string")
    for part in (1, 5):
        assert {r.uid: r.v for r in upsert.latest(rows.repartition(part)).collect()} == {"1": "new", "2": "only"}


def test_two_batches_of_one_source_remain(spark, tmp_path):
    path = str(tmp_path / "log")
    one = spark.createDataFrame([("1", "A", "s", "f1", "x"), ("2", "A", "s", "f2", "x"), ("n", "NamespaceNode", "s", None, "ns")], DDL)
    two = spark.createDataFrame([("3", "A", "s", "f2", "y"), ("4", "A", "s", "f3", "y"), ("m", "NamespaceNode", "s", None, "ns2")], DDL)
    refresh.write_batch(one, path, 0)
    refresh.write_batch(two, path, 1)
    refresh.write_batch(two, path, 1)  # run again after a failure
    assert {r.uid for r in refresh.current(spark, path).collect()} == {"1", "3", "4", "n", "m"}
    refresh.write_batch(spark.createDataFrame([("g", "gone", "s", "f1", None)], DDL), path, 2)
    assert {r.uid for r in refresh.current(spark, path).collect()} == {"3", "4", "n", "m"}
    refresh.compact(spark, path, str(tmp_path / "small"))
    assert {r.uid for r in refresh.current(spark, str(tmp_path / "small")).collect()} == {"3", "4", "n", "m"}


def test_stream_of_files(spark, tmp_path):
    for name, uid in (("a", "1"), ("b", "2")):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{name}.csv").write_text(f"{uid},A,s,{name},x\n")
        stream = spark.readStream.schema(DDL).csv(str(tmp_path / "in"))
        refresh.refresh_on_arrival(stream, lambda df: df, str(tmp_path / "log"), str(tmp_path / "check")).awaitTermination()
    assert {r.uid for r in refresh.current(spark, str(tmp_path / "log")).collect()} == {"1", "2"}


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("empty tree")
    files = {
        "a/__init__.py": "", "a/b/__init__.py": "", "a/b/m.py": "from . import x\nfrom ..c import K\nclass Q:\n    def __init__(self, k: list[int]): self.get(); self.own()\n    def _hidden(self): pass\n    def own(self) -> 'Q': return len(self)\n",
        "a/c.py": "class K:\n    def get(self): pass\n    def len(self): pass\n    @classmethod\n    def make(cls): return cls.get()\n", "a/b/x.py": "def f(x=0, *, z: int = 3): get(); print(K())\n", "a/b/y.py": "def f(y=1, *, w: int = 4): pass\n",
    }
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    nodes, edges = python_source.read(spark, str(root), "s")
    return nodes.cache(), edges.cache()


def _pairs(tree, kind):
    nodes, edges = tree
    n = nodes.select("uid", "qualified_name")
    e = edges.where(F.col("rel_type") == kind).join(n.toDF("src_uid", "a"), "src_uid").join(n.toDF("dst_uid", "b"), "dst_uid")
    return {(r.a, r.b) for r in e.collect()}


def test_empty_files_are_namespaces(tree):
    assert {r.qualified_name for r in tree[0].where("type = 'NamespaceNode'").collect()} == {"a", "a.b", "a.b.m", "a.c", "a.b.x", "a.b.y"}
    assert {("a", "a.b"), ("a.b", "a.b.m"), ("a", "a.c")} <= _pairs(tree, "COMPOSES")


def test_builtins_are_no_callees(tree):
    assert _pairs(tree, "INVOKES") == {("a.b.m.Q.__init__", "a.c.K.get"), ("a.b.m.Q.__init__", "a.b.m.Q.own")}
    assert _pairs(tree, "DEPENDS_ON") == {("a.b.m.Q.own", "a.b.m.Q")}
    assert {("a.b.m", "a.b"), ("a.b.m", "a.c")} <= _pairs(tree, "INCLUDES")


def test_dunders_are_public(tree):
    t = GraphTools(*tree)
    assert {m.name for r in t.get_class_members("Q").collect() for m in r.members} == {"__init__", "own"}
    assert tree[0].where("name = '_hidden'").first().protection == "private"


def test_uid_ignores_names_and_defaults(spark, tree):
    rows = spark.createDataFrame([("(int x, const char* str)",), ("(int y = 3, const char* s)",), ("(int) const",), ("(int x)",), ("(void)",), ("()",), (None,), ("(const T & y)",), ("(unsigned long n, std::string)",)], "a string")
    assert [r.n for r in rows.select(names.normal_args(F.col("a")).alias("n")).collect()] == ["(int, const char*)", "(int, const char*)", "(int) const", "(int)", "()", "()", "()", "(const T &)", "(unsigned long, std::string)"]
    rows = spark.createDataFrame([("(x=0)",), ("(y=1)",), ("(a: int, *args, k: dict[str, int]={'a': 1, 'b': 2}, **kw)",), ("(self)",), ("()",)], "a string")
    assert [r.n for r in rows.select(names.python_args(F.col("a")).alias("n")).collect()] == ["(_)", "(_)", "(int, *_, dict[], **_)", "(_)", "()"]
    assert tree[0].count() == tree[0].select("uid").distinct().count()
