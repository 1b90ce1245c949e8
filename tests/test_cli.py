import json

import pytest

from codeloom import cli


def test_index_query_clear(spark, tmp_path, capsys):
    tables, one, two = str(tmp_path / "t"), tmp_path / "one", tmp_path / "two"
    for folder, text in ((one, "class A:\n    def f(self): pass\n\ndef g(): pass\n"), (two, "class B: pass\n")):
        folder.mkdir()
        (folder / "m.py").write_text(text)
        cli.main(["--tables", tables, "index", "python", str(folder), "--source", folder.name])
    capsys.readouterr()
    cli.main(["--tables", tables, "query", "list_sources"])
    assert {(r["source"], r["node_type"]): r["count"] for r in json.loads(capsys.readouterr().out)}["one", "ClassNode"] == 1
    (one / "m.py").write_text("class A: pass\n")
    cli.main(["--tables", tables, "index", "python", str(one), "--source", "one"])
    assert json.loads(capsys.readouterr().out) == {"deleted": {"MethodNode": 1, "FunctionNode": 1}}
    assert cli.main(["--tables", tables, "clear", "--source", "one"], ask=lambda _: "no") == 1
    assert cli.main(["--tables", tables, "clear", "--source", "one"], ask=lambda _: "one") == 0
    nodes, edges = cli.stored(spark, tables)
    assert {r.source for r in nodes.select("source").distinct().collect()} == {"two"} and {r.source for r in edges.select("source").distinct().collect()} == {"two"}
    cli.main(["--tables", tables, "export", "csv", str(tmp_path / "out"), "--source", "two"])
    assert spark.read.option("header", True).csv(str(tmp_path / "out/nodes")).count() == nodes.count()


def test_schemas_and_readers(capsys):
    cli.main(["--tables", "none", "schemas"])
    assert len(json.loads(capsys.readouterr().out)) == 8
    with pytest.raises(ValueError):
        cli.register("python", None)
    cli.register("other", lambda spark, folder, source: None)
    assert cli.READERS.pop("other")
