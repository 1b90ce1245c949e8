import pytest
from pyspark.sql import functions as F

from codeloom.sources import python_source, python_tests

FILES = {
    "a_test.py": '''
from calc import Calc, helper

def test_plain():
    """Adds two."""
    c = Calc(0)
    total = c.add(2)
    assert c.value == 2
    c.reset()
    helper(1)
    assert c.add(3) != LIMIT
    assert not c.value
    try:
        assert isinstance(c, Calc)
        assert total is None
    except AssertionError:
        raise
    c.add(9)

class TestCalc:
    def setup_method(self):
        self.x = 1

    def test_saved(self):
        d = Calc.make(1).save()
        assert d.other() == "text"
''',
    "calc.py": '''
LIMIT = 3

class Base:
    def add(self, n): return n
    def other(self): return "text"

class Calc:
    value: int = 0
    def add(self, n): return n
    def reset(self): pass
    @classmethod
    def make(cls, n): return cls()

def helper(n): return n
''',
}


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tested")
    for name, text in FILES.items():
        (root / name).write_text(text)
    nodes, edges = python_source.read(spark, str(root), "s")
    return nodes.cache(), edges.cache()


def pairs(graph, kind):
    nodes, edges = graph
    n = nodes.select("uid", "qualified_name")
    e = edges.where(F.col("rel_type") == kind).join(n.toDF("src_uid", "a"), "src_uid").join(n.toDF("dst_uid", "b"), "dst_uid")
    return {(r.a, r.b) for r in e.collect()}


P = "a_test.test_plain"


def test_segments(graph):
    got = {r.qualified_name: r for r in graph[0].where("type in ('TestNode', 'TestStepNode', 'AssertionNode', 'TestFixtureNode', 'LiteralNode')").collect()}
    assert set(got) == {P, "a_test.TestCalc.test_saved", f"{P}::step_0", f"{P}::step_1", f"{P}::step_2", f"{P}::c", *(f"{P}::post_{k}" for k in range(5)), "a_test.TestCalc.test_saved::step_0", "a_test.TestCalc.test_saved::post_0", "a_test.TestCalc.test_saved::d", "literal::2", "literal::text"}
    assert (got[P].description, got[P].test_module, got[f"{P}::step_0"].description, got[f"{P}::step_1"].description) == ("Adds two.", "a_test", "Setup block", "Action block 1")
    assert (got[f"{P}::post_0"].operator, got[f"{P}::post_0"].description) == ("==", "assert ==")
    assert got[f"{P}::post_2"].operator == got[f"{P}::post_2"].description == "assert not c.value"
    assert got["literal::2"].value_type == "int" and got["literal::text"].value_type == "string"
    assert not graph[0].where("qualified_name = 'a_test.TestCalc'").count() and graph[0].where("qualified_name = 'a_test.TestCalc.setup_method'").count() == 1
    assert graph[0].count() == graph[0].select("uid").distinct().count()


def test_fixtures_and_operands(graph):
    assert pairs(graph, "OF_TYPE") == {(f"{P}::c", "calc.Calc"), ("a_test.TestCalc.test_saved::d", "calc.Calc")}
    assert pairs(graph, "LEFT_OPERAND") == {(f"{P}::post_0", "calc.Calc.value"), ("a_test.TestCalc.test_saved::post_0", "calc.Base.other")}
    assert pairs(graph, "RIGHT_OPERAND") == {(f"{P}::post_0", "literal::2"), ("a_test.TestCalc.test_saved::post_0", "literal::text")}
    assert {(f"{P}::c", f"{P}::post_0"), (f"{P}::c", f"{P}::post_1"), (f"{P}::c", f"{P}::post_3")} <= pairs(graph, "CHECKED_BY")
    assert (f"{P}::c", f"{P}::step_0") in pairs(graph, "DEFINED_IN")
    assert {(P, f"{P}::c"), (P, f"{P}::post_0"), (P, f"{P}::step_1")} <= pairs(graph, "COMPOSES")


def test_callees(graph):
    assert {x for x in pairs(graph, "CALLEE") if x[0].startswith(P)} == {(f"{P}::step_0", "calc.Calc"), (f"{P}::step_0", "calc.Calc.add"), (f"{P}::step_1", "calc.Calc.reset"), (f"{P}::step_1", "calc.helper"), (f"{P}::step_2", "calc.Calc.add")}
    assert {x for x in pairs(graph, "VERIFIES") if x[0] == P} == {(P, "calc.Calc"), (P, "calc.Calc.add"), (P, "calc.Calc.reset"), (P, "calc.helper")}
    got = {r.qualified_name: r.implementation for r in graph[0].where("type = 'ImplementationNode'").collect()}
    assert got[f"{P}::step_1"] == "    c.reset()\n    helper(1)" and (f"{P}::step_1", f"{P}::step_1") in pairs(graph, "HAS_IMPLEMENTATION")


def test_literals():
    assert [python_tests.literal(x) for x in (True, 1, 1.5, "s", None, b"")] == [("true", "boolean"), ("1", "int"), ("1.5", "float"), ("s", "string"), None, None]
