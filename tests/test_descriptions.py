import json

import pytest

from codeloom.operators import enrich
from codeloom.sources import comments, python_source

TEXT = '''import calc

@mark
def test_sum():
    """Adds."""
    c = Calc()
    # codeloom:test-desc m.test_sum::post_0
    # first line
    # goes on
    #
    # second paragraph
    assert c.total == 1
    c.clear()

class Calc:
    total = 0
    def clear(self): pass
'''


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("described")
    (root / "m.py").write_text(TEXT)
    nodes, edges = python_source.read(spark, str(root), "s")
    return nodes.cache(), edges.cache(), python_source._files(spark, str(root)).cache()


def test_read_and_apply(graph):
    nodes, _, files = graph
    got = {r.qualified_name: r.described for r in comments.read(files).collect()}
    assert got == {"m.test_sum::post_0": "first line goes on\n\nsecond paragraph"}
    assert comments.apply(nodes, comments.read(files)).where("name = 'post_0'").first().description.startswith("first line")


def test_write_back_is_idempotent(graph, spark):
    nodes, _, files = graph
    own = comments.apply(nodes, comments.read(files))
    long = " ".join(["word"] * 40)
    own = own.withColumn("description", __import__("pyspark").sql.functions.expr(f"case when name = 'step_1' then '{long}' when name = 'test_sum' then 'Adds.' else description end"))
    one = comments.write_back(own, files).first()
    assert one.changed and one.written == 2 and one.skipped_docstring == 1 and one.skipped_placeholder == 2
    assert max(map(len, one.text.split("\n"))) <= comments.WIDTH and comments.parse(one.text) == {"m.test_sum::post_0": "first line goes on\n\nsecond paragraph", "m.test_sum::step_1": long}
    assert [x for x in one.text.split("\n") if "#" not in x] == [x for x in TEXT.split("\n") if "#" not in x]
    text, n = comments.rewrite(TEXT, [("TestNode", "m.test_sum", 4, "Sums up.")])
    assert text.split("\n")[2:4] == ["# codeloom:test-desc m.test_sum", "# Sums up."] and text.split("\n")[4] == "@mark"  # above the decorator
    again, _ = comments.rewrite(text, [("TestNode", "m.test_sum", 6, "Sums up.")])
    assert again == text
    empty = comments.write_back(nodes, files, scaffold=True).first()
    assert empty.scaffolded == 5 and "# codeloom:test-desc m.test_sum::step_0\n    c = Calc()" in empty.text


def test_enrich(graph):
    nodes, edges, _ = graph

    def complete(system, user):
        asked = [x[3:] for x in user.split("\n") if x.startswith("## ")]
        if any("step_1" in a for a in asked):
            raise RuntimeError("no line")
        return "Here:\n```json\n" + json.dumps({a: "says " + a for a in asked if not a.endswith("::c")}) + "\n```"

    got = {r.qualified_name: r for r in enrich.enrich(nodes, edges, complete, batch=1).collect()}
    assert {k.rsplit("::", 1)[1]: r.status for k, r in got.items()} == {"c": "skipped", "step_0": "enriched", "step_1": "error", "post_0": "enriched"}
    assert "Code under test: m.Calc" in got["m.test_sum::step_0"].prompt and got["m.test_sum::step_1"].error == "no line"
    after = enrich.apply(nodes, enrich.enrich(nodes, edges, complete, batch=1))
    assert after.where("name = 'step_0'").first().description == "says m.test_sum::step_0" and after.count() == nodes.count()
    again = {r.status: r.n for r in enrich.summary(enrich.enrich(after, edges, complete, batch=1)).collect()}
    assert again == {"skipped": 3, "error": 1}
    assert {r.status for r in enrich.enrich(nodes, edges, None).collect()} == {"skipped"} and enrich.enrich(nodes, edges, None, tests=["none"]).count() == 0


def test_answers():
    assert enrich.answers('x {"a": "b"} y') == {"a": "b"}
    for bad in ("none", "[1]", "{"):
        with pytest.raises(ValueError):
            enrich.answers(bad)
