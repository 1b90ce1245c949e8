"""Test functions: their steps, assertions, fixtures, operands and callees.

A body is cut at its assertions: what stands between is a step.  Names are only noted while a file is read; joins over
all files then find what they mean, so the result doesn't depend on the order of files.
"""

from __future__ import annotations

import ast

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom import schema

#: Rows of test references: what they belong to (qualified_name), their name, and the object that it hangs on.
_OPS = {ast.Eq: "==", ast.NotEq: "!=", ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">=", ast.Is: "is", ast.IsNot: "is not", ast.In: "in", ast.NotIn: "not in"}


def literal(value) -> tuple[str, str] | None:
    """(text, type) of a plain value; booleans are no integers, None is nothing."""
    if isinstance(value, bool):
        return str(value).lower(), "boolean"
    for kind, name in ((int, "int"), (float, "float"), (str, "string")):
        if isinstance(value, kind):
            return str(value), name
    return None


def _made(stmt: ast.Assign) -> tuple[str, str] | None:
    """(variable, class) of ``v = Cls(..)``, ``v = Cls.make(..)`` or ``v = a.b.Cls(..)``, with or without .save()."""
    if len(stmt.targets) != 1 or not isinstance(stmt.targets[0], ast.Name) or not isinstance(stmt.value, ast.Call):
        return None
    func = stmt.value.func
    if isinstance(func, ast.Attribute) and func.attr == "save" and isinstance(func.value, ast.Call):
        func = func.value.func
    if isinstance(func, ast.Name):
        return stmt.targets[0].id, func.id
    if isinstance(func, ast.Attribute) and isinstance(func.value, ast.Name):
        return stmt.targets[0].id, func.value.id
    if isinstance(func, ast.Attribute) and isinstance(func.value, ast.Attribute):
        return stmt.targets[0].id, func.attr
    return None


def _operand(node: ast.expr) -> dict | None:
    while isinstance(node, ast.Call):
        node = node.func
    if isinstance(node, ast.Attribute):
        return {"ref": node.attr, "how": "attribute", "obj": node.value.id if isinstance(node.value, ast.Name) else None}
    if isinstance(node, ast.Name):
        return {"ref": node.id, "how": "name", "obj": node.id}
    if isinstance(node, ast.Constant) and (got := literal(node.value)):
        return {"ref": got[0], "how": "literal", "obj": got[1]}
    return None


def read_test(reader, node: ast.FunctionDef | ast.AsyncFunctionDef, lines: list[str]) -> None:
    """Adds the rows of one test function to those of its module's reader."""
    test = f"{reader.scope[-1]}.{node.name}"
    said = (ast.get_docstring(node) or "").split("\n")[0]
    reader.add("TestNode", node.name, node, kind="test", test_name=node.name, test_module=reader.module, description=said, brief_description=said, body_start=None, body_end=None)

    def part(label: str, name: str, **more) -> str:
        reader.add(label, name, None, **({"qualified_name": f"{test}::{name}", "member_refid": test} | more))
        return f"{test}::{name}"

    def note(kind: str, owner: str, what: dict, line: int | None = None) -> None:
        reader.rows.append({"type": "ref", "ref_kind": kind, "qualified_name": owner, "member_refid": test, "file_path": reader.path, "line_number": line, "ord": len(reader.rows)} | what)

    for stmt in ast.walk(node):
        if isinstance(stmt, ast.Assign) and (made := _made(stmt)):
            note("FIXTURE", test, {"ref": made[1], "obj": made[0], "how": "name"}, stmt.lineno)
    body = node.body[1:] if ast.get_docstring(node) is not None else node.body
    block: list[ast.stmt] = []
    steps = asserts = 0

    def flush() -> None:
        nonlocal block, steps
        if block:
            start, end = block[0].lineno, max(s.end_lineno or s.lineno for s in block)
            text = "\n".join(lines[start - 1 : end]).rstrip("\n")
            step = part("TestStepNode", f"step_{steps}", kind="test_step", position=steps, description="Setup block" if not steps else f"Action block {steps}", body_start=start, body_end=end, implementation=text if text.strip() else None)
            for call in (c for s in block for c in ast.walk(s) if isinstance(c, ast.Call)):
                if isinstance(call.func, (ast.Attribute, ast.Name)):
                    note("CALLEE", step, _operand(call.func))
            block, steps = [], steps + 1

    for stmt in body:
        found = sorted((c for c in ast.walk(stmt) if isinstance(c, ast.Assert)), key=lambda c: c.lineno)
        if not found:
            block.append(stmt)
            continue
        flush()
        for one in found:
            left, right, operator = one.test, None, "truthy"
            if isinstance(left, ast.UnaryOp) and isinstance(left.op, ast.Not):
                left, operator = left.operand, "not_truthy"
            if isinstance(left, ast.Compare) and len(left.ops) == 1:
                left, right, operator = left.left, left.comparators[0], _OPS.get(type(left.ops[0]), "unknown")
            if isinstance(left, ast.Call) and isinstance(left.func, ast.Name) and left.func.id == "isinstance":
                left, operator = (left.args[0] if left.args else left), "isinstance"
            name = part("AssertionNode", f"post_{asserts}", kind="assertion", phase="post", position=asserts, operator=operator, description=ast.unparse(one), line_number=one.lineno)
            for side, expr in (("LEFT_OPERAND", left), ("RIGHT_OPERAND", right)):
                if expr is not None and (what := _operand(expr)):
                    note(side, name, what)
            asserts += 1
    flush()


def _first(nodes: DataFrame, label: str, name: str = "name") -> DataFrame:
    """(name, uid, qualified_name) of the first node of the label with each name, in parse order."""
    own = nodes.where(F.col("type") == label)
    return own.groupBy(F.col("name").alias(name)).agg(F.min_by(F.struct("uid", "qualified_name"), F.struct("ord", "uid")).alias("f")).select(name, "f.uid", "f.qualified_name")


def derive(nodes: DataFrame, refs: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """(all nodes with fixtures, literals and implementations, edges of tests).  nodes.ord must sort by parse order."""
    ids = nodes.groupBy("qualified_name").agg(F.min_by("uid", F.struct("ord", "uid")).alias("uid"))
    classes = _first(nodes, "ClassNode").select(F.col("name").alias("ref"), F.col("uid").alias("class_uid"), F.col("qualified_name").alias("class_qn"))
    # fixtures: a variable's last assignment in its test counts
    made = refs.where("ref_kind = 'FIXTURE'").select("qualified_name", "obj", "ref", "line_number", "file_path").join(classes, "ref")
    made = made.groupBy(F.col("qualified_name").alias("test"), "obj").agg(F.max_by(F.struct("ref", "class_uid", "class_qn", "line_number", "file_path"), "line_number").alias("m")).select("test", "obj", "m.*")
    made = made.withColumns({"qualified_name": F.concat_ws("::", "test", "obj"), "type": F.lit("TestFixtureNode"), "source": F.lit(source)})
    made = made.withColumn("fixture_uid", schema.uid("qualified_name"))
    fixtures = made.select(F.col("fixture_uid").alias("uid"), "type", "source", F.col("qualified_name").alias("refid"), F.col("obj").alias("name"), "qualified_name", F.lit("test_fixture").alias("kind"), F.col("ref").alias("type_signature"), "line_number", "file_path", F.lit("python").alias("language"))
    of = made.select("test", "obj", "class_qn", "fixture_uid")

    # what a name can mean: members of the fixture's class, then the first of that name anywhere
    noted = refs.where(F.col("ref_kind").isin("LEFT_OPERAND", "RIGHT_OPERAND", "CALLEE")).select("ref_kind", "qualified_name", F.col("member_refid").alias("test"), "ref", "how", "obj").distinct()
    noted = noted.join(of, ["test", "obj"], "left").withColumn("typed", F.concat_ws(".", "class_qn", "ref"))
    member = nodes.where("type in ('MethodNode', 'AttributeNode')").groupBy(F.col("qualified_name").alias("typed")).agg(F.max_by("uid", "type").alias("on_class"))
    noted = noted.join(member.withColumnRenamed("typed", "_t"), (F.col("typed") == F.col("_t")) & F.col("class_qn").isNotNull() & (F.col("how") == "attribute"), "left")
    for label in ("MethodNode", "AttributeNode", "FunctionNode", "ClassNode"):
        noted = noted.join(_first(nodes, label, "_n").select(F.col("_n").alias("ref"), F.col("uid").alias(label)), "ref", "left")
    literal_qn = F.concat(F.lit("literal::"), F.col("ref"))
    lit = noted.where("how = 'literal'").groupBy("ref").agg(F.min("obj").alias("value_type"))
    lit = lit.withColumns({"qualified_name": literal_qn, "type": F.lit("LiteralNode"), "source": F.lit(source)}).withColumn("uid", schema.uid("qualified_name"))
    literals = lit.select("uid", "type", "source", F.col("qualified_name").alias("refid"), F.col("ref").alias("name"), "qualified_name", F.lit("literal").alias("kind"), F.col("ref").alias("value"), "value_type")
    noted = noted.join(lit.select("ref", F.col("uid").alias("literal_uid")), "ref", "left")
    called = F.col("ref_kind") == "CALLEE"
    target = (
        F.when(F.col("how") == "literal", F.col("literal_uid"))
        .when(F.col("how") == "attribute", F.when(called, F.coalesce("on_class", "MethodNode")).otherwise(F.coalesce("on_class", "MethodNode", "AttributeNode")))
        .when(called, F.coalesce("FunctionNode", "ClassNode", "MethodNode"))
        .otherwise(F.when(F.col("fixture_uid").isNull(), F.coalesce("AttributeNode", "FunctionNode")))
    )
    noted = noted.withColumn("target", target).join(ids.withColumnRenamed("uid", "owner"), "qualified_name")

    def edge(df: DataFrame, src: str, dst: str, kind) -> DataFrame:
        return schema.conform(df.where(F.col(dst).isNotNull()).select(F.col(src).alias("src_uid"), F.col(dst).alias("dst_uid"), (F.lit(kind) if isinstance(kind, str) else kind).alias("rel_type")).distinct(), schema.EDGES)

    # an assertion has both operands or none
    sides = noted.where(~called & F.col("target").isNotNull()).groupBy("qualified_name").agg(F.countDistinct("ref_kind").alias("n")).where("n = 2").select("qualified_name")
    operands = edge(noted.where(~called).join(sides, "qualified_name", "left_semi"), "owner", "target", F.col("ref_kind"))
    tests = ids.toDF("test", "test_uid")
    callees = noted.where(called)
    parts = nodes.where("type in ('TestStepNode', 'AssertionNode')").select("uid", F.col("member_refid").alias("test"), "type", "body_start", "body_end", "position", "implementation", "qualified_name")
    inside = made.join(parts.where("type = 'TestStepNode'").withColumnRenamed("uid", "step"), "test").where("line_number between body_start and body_end")
    inside = inside.groupBy("fixture_uid").agg(F.min_by("step", "position").alias("step"))
    impl = parts.where("implementation is not null").select("uid", "qualified_name", "implementation", F.lit(source).alias("source"), F.lit("ImplementationNode").alias("type"), F.lit("implementation").alias("kind")).withColumn("impl", schema.uid("qualified_name"))
    edges = [
        operands, edge(callees, "owner", "target", "CALLEE"), edge(callees.join(tests, "test"), "test_uid", "target", "VERIFIES"), edge(made, "fixture_uid", "class_uid", "OF_TYPE"),
        edge(noted.where(~called & F.col("fixture_uid").isNotNull() & (F.col("how") != "literal")), "fixture_uid", "owner", "CHECKED_BY"), edge(inside, "fixture_uid", "step", "DEFINED_IN"),
        edge(made.join(tests, "test"), "test_uid", "fixture_uid", "COMPOSES"), edge(parts.join(tests, "test"), "test_uid", "uid", "COMPOSES"), edge(impl, "uid", "impl", "HAS_IMPLEMENTATION"),
    ]
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    whole = sides.withColumn("_both", F.lit(True))
    own = nodes.join(whole, "qualified_name", "left")
    text = (F.col("type") == "AssertionNode") & F.col("_both").isNull()
    short = (F.col("type") == "AssertionNode") & F.col("_both").isNotNull()
    # without both operands the whole text stands for them
    own = own.withColumn("operator", F.when(text, F.col("description")).otherwise(F.col("operator"))).withColumn("description", F.when(short, F.concat(F.lit("assert "), F.col("operator"))).otherwise(F.col("description")))
    own = schema.conform(own.withColumn("implementation", F.lit(None).cast("string")).withColumn("ord", F.col("ord.ord")), schema.NODES)
    for more in (fixtures, literals, impl.drop("uid").withColumnRenamed("impl", "uid").withColumn("impl_embedding", F.array().cast("array<float>"))):
        own = own.unionByName(schema.conform(more, schema.NODES))
    return own, out.withColumn("source", F.lit(source))
