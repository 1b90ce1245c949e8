"""Python source trees as nodes, edges and pending calls: files are parsed in parallel, names resolve by joins."""

from __future__ import annotations

import ast
import builtins
import io
import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom import schema
from codeloom.functions import names
from codeloom.operators import resolve, store
from codeloom.sources import python_tests

EXCLUDED = ("__pycache__", ".git", ".hg", ".svn", ".tox", ".nox", ".venv", "venv", "env", "build", "dist", "node_modules", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".eggs", "site-packages")
#: Calls by these bare names never mean a parsed symbol: builtins, methods of their types, logging, and common library names.
DENIED_CALLS = frozenset(
    {n for n in dir(builtins) if n[0].islower()}
    | {n for t in (str, bytes, list, dict, set, io.TextIOWrapper) for n in dir(t) if not n.startswith("_")}
    | set("Path critical datetime debug dump dumps error exception findall info json load loads log match np os pd re search sub sys time timedelta warning __import__".split())
)
#: Types that are defined in no parsed file.
DENIED_TYPES = frozenset(
    {n for n in dir(builtins) if isinstance(getattr(builtins, n), type) and (n[0].islower() or n in ("Exception", "BaseException"))}
    | set("Any Awaitable Callable Coroutine Dict Ellipsis FrozenSet Generator Iterable Iterator List Literal Mapping MutableMapping NamedTuple None NoneType NotImplemented Optional Protocol Self Sequence Set Tuple Type TypeVar TypedDict Union".split())
)
_ENUMS = {"Enum", "IntEnum", "StrEnum", "Flag", "IntFlag"}
_ROW = "type string, name string, qualified_name string, kind string, file_path string, line_number int, body_start int, body_end int, brief_description string, argsstring string, type_signature string, protection string, base_classes array<string>, is_static boolean, is_abstract boolean, member_refid string, position int, default_value string, description string, test_name string, test_module string, phase string, operator string, implementation string, ord long, ref string, ref_kind string, how string, obj string"


def _text(node: ast.AST | None) -> str:
    return ast.unparse(node) if node is not None else ""


def _protection(name: str) -> str:
    """Names with one leading underscore are private; dunder names are part of the public protocol."""
    return "private" if name[:1] == "_" and name[1:2] != "_" else "public"


class _Reader(ast.NodeVisitor):
    """Rows of one module; references to be resolved are rows of type 'ref'."""

    def __init__(self, path: str, module: str, text: str = ""):
        self.path, self.module, self.rows, self.scope, self.lines = path, module, [], [module], text.splitlines()

    def add(self, label: str, name: str, node: ast.AST | None = None, **more) -> None:
        line = getattr(node, "lineno", None)
        base = {"type": label, "name": name, "qualified_name": f"{self.scope[-1]}.{name}", "file_path": self.path, "line_number": line, "body_start": line, "body_end": getattr(node, "end_lineno", None)}
        self.rows.append(base | more | {"ord": len(self.rows)})

    def ref(self, owner: str, kind: str, text: str, line: int | None = None) -> None:
        if text:
            self.rows.append({"type": "ref", "qualified_name": owner, "ref": text, "ref_kind": kind, "line_number": line, "ord": len(self.rows)})

    def depends(self, owner: str, annotation: ast.AST | None) -> None:
        """The type that an annotation names; of a generic one its base."""
        base = _text(annotation).strip("'\"").split("[")[0].split("<")[0].strip()
        if base not in DENIED_TYPES and base.lower() not in DENIED_TYPES:
            self.ref(owner, "DEPENDS_ON", base)

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        bases = [_text(b) for b in node.bases]
        short = {b.split("[")[0].rsplit(".", 1)[-1] for b in bases}
        enum, face = bool(short & _ENUMS), bool(short & {"ABC", "Protocol"})
        if node.name.startswith("Test") and not enum and not face:  # no class of its own: its tests are what counts
            self.scope.append(f"{self.scope[-1]}.{node.name}")
            for child in node.body:
                if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    if child.name.startswith("test_"):
                        python_tests.read_test(self, child, self.lines)
                    else:
                        self.visit(child)
            self.scope.pop()
            return
        label = "EnumNode" if enum else "InterfaceNode" if face else "ClassNode"
        self.add(label, node.name, node, kind="enum" if enum else "interface" if face else "class", base_classes=bases, brief_description=(ast.get_docstring(node) or "").split("\n")[0], is_abstract=face, protection=_protection(node.name))
        qn = f"{self.scope[-1]}.{node.name}"
        for b in bases if label == "ClassNode" else []:
            self.ref(qn, "INHERITS_FROM", b.split("[")[0])
        self.scope.append(qn)
        for child in node.body:
            target = child.target if isinstance(child, ast.AnnAssign) else child.targets[0] if isinstance(child, ast.Assign) else None
            if isinstance(target, ast.Name):
                if enum:
                    self.add("EnumValueNode", target.id, child, kind="enumvalue", default_value=_text(child.value))
                elif isinstance(child, ast.AnnAssign) or not target.id.startswith("__"):
                    self.add("AttributeNode", target.id, child, kind="variable", type_signature=_text(getattr(child, "annotation", None)), protection=_protection(target.id))
            elif isinstance(child, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                self.visit(child)
        self.scope.pop()

    def visit_FunctionDef(self, node: ast.FunctionDef) -> None:
        inside = self.scope[-1] != self.module
        marks = {_text(d).rsplit(".", 1)[-1] for d in node.decorator_list}
        kind = next((k for k in ("property", "classmethod", "staticmethod") if k in marks), "method") if inside else "function"
        if not inside and node.name.startswith("test_"):
            python_tests.read_test(self, node, self.lines)
            return
        self.add("MethodNode" if inside else "FunctionNode", node.name, node, kind=kind, argsstring=f"({_text(node.args)})", type_signature=_text(node.returns), is_static="staticmethod" in marks, is_abstract="abstractmethod" in marks, brief_description=(ast.get_docstring(node) or "").split("\n")[0], protection=_protection(node.name))
        qn = f"{self.scope[-1]}.{node.name}"
        a = node.args
        plain = [*a.posonlyargs, *a.args]
        given = [None] * (len(plain) - len(a.defaults)) + a.defaults
        every = [*zip(plain, given), *([(a.vararg, None)] if a.vararg else []), *zip(a.kwonlyargs, a.kw_defaults), *([(a.kwarg, None)] if a.kwarg else [])]
        for k, (p, d) in enumerate(x for x in every if x[0].arg not in ("self", "cls")):
            self.add("ParameterNode", p.arg, p, member_refid=qn, position=k, type_signature=_text(p.annotation), default_value=_text(d), qualified_name=f"{qn}#{k}")
            self.depends(qn, p.annotation)
        self.depends(qn, node.returns)
        for call in (c for x in node.body for c in ast.walk(x) if isinstance(c, ast.Call)):
            if isinstance(call.func, (ast.Name, ast.Attribute)):
                self.ref(qn, "INVOKES", _text(call.func), call.lineno)

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.ref(self.module, "INCLUDES", a.name)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        # in a package's __init__ one dot is the package itself
        up = node.level - self.path.endswith("__init__.py")
        package = self.module.split(".")[: len(self.module.split(".")) - up] if node.level else []
        self.ref(self.module, "INCLUDES", ".".join([*package, *([node.module] if node.module else [])]))


def parse_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c for c, _ in schema.columns(_ROW)]
    for pdf in batches:
        rows: list[dict] = []
        for path, module, content in zip(pdf.rel, pdf.module, pdf.content):
            try:
                tree = ast.parse(bytes(content))
            except (SyntaxError, ValueError) as e:
                warnings.warn(f"{path}: {e}", stacklevel=1)
                continue
            r = _Reader(path, module, bytes(content).decode("utf-8", "replace"))
            r.rows.append({"type": "NamespaceNode", "name": module.rsplit(".", 1)[-1], "qualified_name": module, "kind": "namespace", "ord": 0})
            if not path.endswith("__init__.py"):
                r.rows.append({"type": "FileNode", "name": path.rsplit("/", 1)[-1], "qualified_name": path, "kind": "file", "file_path": path, "ord": 1})
            for child in tree.body:
                r.visit(child)
            rows += r.rows
        yield pd.DataFrame(rows, columns=columns).astype(object).where(lambda d: d.notna(), None)


def _files(spark: SparkSession, root: str) -> DataFrame:
    """(rel, content) of all Python files.  The reader leaves out files of no bytes, so their names come from a listing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.py").load(root)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    every, blank = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(folder, True), []
    while every.hasNext():
        one = every.next()
        if one.getLen() == 0 and one.getPath().getName().endswith(".py"):
            blank.append((one.getPath().toString(), bytearray()))
    own = files.select("path", "content").unionByName(spark.createDataFrame(blank, "path string, content binary"))
    own = own.withColumn("path", F.regexp_replace("path", r"^(file:)?/+", "/"))
    rel = F.regexp_replace("path", "^" + re.escape("/" + root.removeprefix("file:").strip("/")) + "/", "")
    return own.select(rel.alias("rel"), "content")


def read(spark: SparkSession, root: str, source: str, exclude: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all Python files below ``root``.  Files that don't parse are left out with a warning."""
    own = _files(spark, root).withColumn("module", names.module_path(F.col("rel")))
    parts = F.split("rel", "/")
    own = own.where(~F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(*map(F.lit, (*EXCLUDED, *exclude)))))
    raw = store.materialize(own.select("rel", "module", "content").mapInPandas(parse_files, _ROW), "python-rows")
    named = raw.where("type <> 'ref'").withColumn("source", F.lit(source)).withColumn("language", F.lit("python")).withColumn("refid", F.col("qualified_name"))
    nodes = schema.conform(named.withColumn("uid", schema.uid("qualified_name", names.python_args(F.col("argsstring")), "position")), schema.NODES)
    nodes, refs = store.materialize(nodes.dropDuplicates(["uid"]), "python-nodes"), raw.where("type = 'ref'")
    edges = derive(nodes, refs, source)
    more, link = python_tests.derive(nodes.withColumn("ord", F.struct("file_path", "ord")), refs, source)
    # written once: whatever reads the graph doesn't resolve it again
    return store.materialize(more, "python-graph"), store.materialize(edges.unionByName(link), "python-edges")


def derive(nodes: DataFrame, refs: DataFrame, source: str, sep: str = ".") -> DataFrame:
    """All edges: composition, parameters, files, and what resolving the references gives."""
    qn = nodes.where("type not in ('ParameterNode', 'FileNode', 'TestStepNode', 'AssertionNode')").groupBy("qualified_name").agg(F.min_by("uid", F.struct("ord", "uid")).alias("src_uid"))
    nodes = nodes.withColumn("ord", F.struct("file_path", "ord"))  # parse order: files by path, then places in them
    child = nodes.where("type not in ('ParameterNode', 'FileNode', 'TestStepNode', 'AssertionNode')").select(F.col("uid").alias("dst_uid"), names.parent_name(F.col("qualified_name"), sep).alias("qualified_name"))
    compose = child.join(qn, "qualified_name").select("src_uid", "dst_uid", F.lit("COMPOSES").alias("rel_type"))
    params = nodes.where("type = 'ParameterNode'").select(F.col("uid").alias("dst_uid"), "position", F.col("member_refid").alias("qualified_name"))
    params = params.join(qn, "qualified_name").select("src_uid", "dst_uid", F.lit("HAS_PARAMETER").alias("rel_type"), "position")
    files = nodes.where("type = 'FileNode'").select(F.col("uid").alias("dst_uid"), "file_path")
    within = nodes.where("type not in ('ParameterNode', 'FileNode', 'TestStepNode', 'AssertionNode')").select(F.col("uid").alias("src_uid"), "file_path").join(files, "file_path").select("src_uid", "dst_uid", F.lit("DEFINED_IN").alias("rel_type"))
    target = {"INHERITS_FROM": schema.COMPOUNDS, "DEPENDS_ON": schema.COMPOUNDS, "INVOKES": ("MethodNode", "FunctionNode"), "INCLUDES": ("NamespaceNode",)}
    out = schema.conform(compose, schema.EDGES).unionByName(schema.conform(params, schema.EDGES)).unionByName(schema.conform(within, schema.EDGES))
    for kind, types in target.items():
        own = refs.where(F.col("ref_kind") == kind).select("qualified_name", "ref").distinct()
        owner = names.parent_name(F.col("qualified_name"), sep)
        if kind == "INVOKES":  # self.x means a member of the owner's class; what hangs on cls or on self.x isn't followed
            own = own.where(~F.col("ref").isin(*sorted(DENIED_CALLS)) & ~F.col("ref").rlike(r"^cls\.|^self\..*\."))
            own = own.withColumn("ref", F.regexp_replace("ref", r"^self\.", "")).withColumn("scope", owner).where("ref <> ''")
        else:
            own = own.withColumn("scope", owner)
        own = own.select(F.concat_ws("\u0001", "qualified_name", "ref").alias("ref_id"), F.col("ref").alias("ref_name"), "scope", "qualified_name")
        found = resolve.resolve(own.drop("qualified_name"), nodes.where(F.col("type").isin(*types)), sep)
        e = own.join(found, "ref_id", "left" if kind == "INCLUDES" else "inner").join(qn, "qualified_name").select("src_uid", F.col("target").alias("dst_uid"), F.col("ref_name").alias("dst_name"), F.lit(kind).alias("rel_type"))
        out = out.unionByName(schema.conform(e.where("dst_uid is null or src_uid <> dst_uid"), schema.EDGES))
    return out.withColumn("source", F.lit(source)).dropDuplicates(["src_uid", "rel_type", "dst_uid", "position"] + ["dst_name"])
