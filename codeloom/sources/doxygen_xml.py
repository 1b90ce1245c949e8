"""C++ documentation dumps in XML as nodes and edges: files are decoded in parallel, references resolve by joins."""

from __future__ import annotations

import re
import warnings
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom import schema
from codeloom.functions import names
from codeloom.operators import store

_LABEL = {"class": "ClassNode", "struct": "ClassNode", "concept": "ConceptNode", "enum": "EnumNode", "union": "UnionNode", "interface": "InterfaceNode"}
_MEMBER = {"function": "MethodNode", "variable": "AttributeNode", "typedef": "AttributeNode", "enumvalue": "EnumValueNode", "define": "DefineNode"}
_OWN = "refid string, compound_refid string, member_refid string, type string, name string, qualified_name string, kind string, file_path string, language string, line_number int, body_start int, body_end int, brief_description string, detailed_description string, definition string, argsstring string, type_signature string, protection string, module string, base_classes array<string>, is_static boolean, is_const boolean, is_constexpr boolean, is_virtual boolean, is_inline boolean, is_explicit boolean, is_final boolean, is_abstract boolean, initializer string, position int, default_value string, tags array<string>, ord long"
#: A reference: from refid; to a refid, a name, or both; a template parameter has its constraint as name.
_REF = "ref_kind string, to_refid string, to_name string, included_file string, is_local boolean, declname string, defname string, defval string"
_ROW = f"{_OWN}, {_REF}"


def flat(node: ET.Element | None) -> str:
    """All text below an element, pieces set apart by single blanks."""
    return " ".join(" ".join(node.itertext()).split()) if node is not None else ""


def _line(place: ET.Element | None, name: str) -> int | None:
    """-1 and an absent attribute stand for no line."""
    got = place.get(name) if place is not None else None
    return int(got) if got and got != "-1" else None


class _Decoder:
    """Rows of one dump file; references are rows of type 'ref'."""

    def __init__(self, layer: str):
        self.rows, self.layer = [], layer

    def add(self, label: str, node: ET.Element, **more) -> None:
        place = node.find("location")
        base = {
            "type": label, "refid": node.get("id", ""), "kind": node.get("kind", ""), "file_path": (place.get("file") if place is not None else None) or "", "line_number": _line(place, "line"),
            "brief_description": flat(node.find("briefdescription")), "detailed_description": flat(node.find("detaileddescription")), "definition": node.findtext("definition", ""),
        }
        self.rows.append(base | more | {"ord": len(self.rows)})

    def ref(self, kind: str, refid: str, **more) -> None:
        self.rows.append({"type": "ref", "ref_kind": kind, "refid": refid, "ord": len(self.rows)} | more)

    def template(self, node: ET.Element, refid: str) -> None:
        for k, p in enumerate(node.findall("templateparamlist/param")):
            self.ref("TEMPLATE_PARAM", refid, position=k, to_name=flat(p.find("type")), **{c: p.findtext(c, "") or "" for c in ("declname", "defname", "defval")})

    def compound(self, node: ET.Element) -> None:
        refid, kind, qn = node.get("id", ""), node.get("kind", ""), node.findtext("compoundname", "")
        short = qn.rsplit("::", 1)[-1]
        if kind == "file":
            self.add("FileNode", node, name=qn, qualified_name=None, language=node.get("language", ""))
            for i in node.findall("includes"):
                self.ref("INCLUDES", refid, to_refid=i.get("refid") or "", included_file=i.text or "", is_local=i.get("local") == "yes")
        elif kind == "namespace":
            self.add("NamespaceNode", node, name=short, qualified_name=qn)
            return
        elif kind in _LABEL:
            bases = node.findall("basecompoundref") if _LABEL[kind] == "ClassNode" else []
            more = {"base_classes": [b.text or "" for b in bases], "is_final": node.get("final") == "yes", "is_abstract": node.get("abstract") == "yes", "tags": [self.layer]} if _LABEL[kind] == "ClassNode" else {}
            self.add(_LABEL[kind], node, name=short, qualified_name=qn, module=qn.rpartition("::")[0], initializer=flat(node.find("initializer")) if kind == "concept" else None, **more)
            self.template(node, refid)
            for b in bases:
                if b.text:
                    self.ref("INHERITS_FROM", refid, to_refid=b.get("refid", ""), to_name=b.text)
            if primary := primary_template(qn):
                self.ref("SPECIALIZES", refid, to_name=primary)
        else:
            warnings.warn(f"compound {refid} of kind {kind!r} left out", stacklevel=1)
            return
        for m in node.findall("sectiondef/memberdef"):
            self.member(m, refid, None if kind == "file" else qn)

    def member(self, node: ET.Element, owner: str, scope: str | None) -> None:
        """scope is None for what a file holds outside any type."""
        refid, kind, name = node.get("id", ""), node.get("kind", ""), node.findtext("name", "")
        if kind not in _MEMBER:
            warnings.warn(f"member {refid} of kind {kind!r} left out", stacklevel=1)
            return
        if scope is None and kind not in ("function", "variable", "typedef"):
            return
        yes, args, place = lambda a: node.get(a) == "yes", node.findtext("argsstring", ""), node.find("location")
        qn = name if scope is None or kind == "define" else f"{scope}::{name}"
        more = {"name": name, "body_start": _line(place, "bodystart") or 0, "body_end": _line(place, "bodyend") or 0}
        if kind in ("function", "variable", "typedef"):
            more |= {"type_signature": flat(node.find("type")), "protection": node.get("prot", "public"), "is_static": yes("static"), "is_const": yes("const")}
        if kind == "function":
            more |= {"argsstring": args, "tags": [self.layer], "is_constexpr": yes("constexpr"), "is_virtual": node.get("virt") in ("virtual", "pure-virtual"), "is_inline": yes("inline"), "is_explicit": yes("explicit")}
            qn += plain_args(args) if scope is not None else ""
        self.add("FunctionNode" if scope is None and kind == "function" else _MEMBER[kind], node, qualified_name=qn, compound_refid=None if scope is None and kind == "function" else owner, **more)
        for r in node.findall("type//ref"):
            if r.get("refid") and r.get("kindref"):
                self.ref("DEPENDS_ON", refid, to_refid=r.get("refid"))
        if scope is None:
            return
        self.template(node, refid)
        for k, p in enumerate(node.findall("param")):
            self.rows.append({"type": "ParameterNode", "member_refid": refid, "refid": f"{refid}#{k}", "position": k, "name": p.findtext("declname", "") or "", "type_signature": flat(p.find("type")), "default_value": p.findtext("defval") or "", "ord": len(self.rows)})
        for tag, kind_ in (("references", "INVOKES"), ("referencedby", "INVOKED_BY")):
            for r in node.findall(tag):
                self.ref(kind_, refid, to_refid=r.get("refid", ""), to_name=r.text or "")


def plain_args(args: str) -> str:
    """The argument types of a declaration, with the qualifiers after it; the same rule as `names.normal_args`."""
    found = re.fullmatch(r"\(?(.*?)(?:\)([^()]*))?", (args or "").strip(), re.S)
    inner, after = found[1].strip(), (found[2] or "").strip()
    out = []
    for words in (a.partition("=")[0].split() for a in inner.split(",")):
        out.append(" ".join(words[:-1] if len(words) > 1 and re.fullmatch(r"[A-Za-z_]\w*", words[-1]) else words))
    return f"({'' if inner in ('', 'void') else ', '.join(out)})" + (f" {after}" if after else "")


def primary_template(qn: str) -> str:
    """``a::Foo`` of ``a::Foo<b::Bar>``; '' for other names."""
    return qn.partition("<")[0].rstrip() if qn.endswith(">") else ""


def decode(batches: Iterator[pd.DataFrame], layer: str) -> Iterator[pd.DataFrame]:
    columns = [c for c, _ in schema.columns(_ROW)]
    for pdf in batches:
        d = _Decoder(layer)
        for path, content in zip(pdf.path, pdf.content):
            try:
                root = ET.fromstring(bytes(content))
            except ET.ParseError as e:
                warnings.warn(f"{path}: {e}", stacklevel=1)
                continue
            for node in root.iter("compounddef"):
                d.compound(node)
        yield pd.DataFrame(d.rows, columns=columns).astype(object).where(lambda x: x.notna(), None)


def index(spark: SparkSession, folder: str) -> DataFrame:
    """(refid, kind) of each compound that index.xml lists; a malformed index gives none."""
    own = spark.read.format("xml").option("rowTag", "compound").option("mode", "DROPMALFORMED").schema("_refid string, _kind string").load(f"{folder}/index.xml")
    return own.select(F.col("_refid").alias("refid"), F.col("_kind").alias("kind")).where("refid is not null")


def read(spark: SparkSession, folder: str, source: str, layer: str = "dependency", implementations: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the dump in ``folder``: the files that its index lists and that exist.

    A file that isn't well-formed is left out with a warning, as are compounds and members
    of unknown kinds.  implementations: base folder of the sources whose lines become ImplementationNodes.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/index.xml")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        raise FileNotFoundError(f"no index.xml in {folder}")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").load(folder)
    listed = index(spark, folder).select("refid").distinct()
    files = files.select("path", "content", F.regexp_extract("path", r"([^/]+)\.xml$", 1).alias("refid")).join(listed, "refid", "left_semi")
    rows = store.materialize(files.select("path", "content").mapInPandas(lambda b: decode(b, layer), _ROW), "xml-rows")
    own = rows.where("type <> 'ref'").withColumns({"source": F.lit(source), "layer": F.when(F.col("type") == "FileNode", F.lit(None)).otherwise(layer), "source_type": names.source_type(F.col("file_path"))})
    path_or_name = F.when(F.col("type") == "FileNode", F.col("file_path")).otherwise(F.col("qualified_name"))
    own = own.withColumn("uid", schema.uid(path_or_name, F.when(F.col("argsstring").isNotNull(), names.normal_args(F.col("argsstring"))), "member_refid", "position"))
    # one compound may stand in several files of a dump
    nodes = schema.conform(own, schema.NODES).dropDuplicates(["uid"])
    refs = rows.where("type = 'ref'")
    nodes, edges = derive(store.materialize(nodes, "xml-nodes"), refs, source)
    if implementations is not None:
        more, link = implement(spark, nodes, implementations)
        nodes, edges = nodes.unionByName(more), edges.unionByName(link)
    return nodes, edges


def concept_of(params: DataFrame, concepts: DataFrame) -> DataFrame:
    """params (.., to_name) with the qualified name of the concept that constrains each, or null.

    The whole name wins, else the first concept of that short name; 'typename X' is no constraint.
    """
    c = concepts.select("qualified_name", names.short_name(F.col("qualified_name")).alias("_s"), "ord")
    short = c.groupBy("_s").agg(F.min_by("qualified_name", F.struct("ord", "qualified_name")).alias("_short"))
    whole = c.select(F.col("qualified_name").alias("_whole")).distinct()
    own = params.join(whole, F.col("to_name") == F.col("_whole"), "left").join(short, F.col("to_name") == F.col("_s"), "left")
    found = F.when(~F.col("to_name").startswith("typename ") & (F.col("to_name") != ""), F.coalesce("_whole", "_short"))
    return own.withColumn("concept", found).drop("_whole", "_s", "_short")


def template_parameters(nodes: DataFrame, refs: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """Nodes of kind type_parameter, and the edges TEMPLATE_PARAM and ENFORCES_CONCEPT."""
    owner = nodes.where(F.col("type").isin(*schema.COMPOUNDS, "MethodNode", "AttributeNode", "FunctionNode")).select("refid", F.col("uid").alias("src_uid"), F.col("qualified_name").alias("_owner"))
    own = concept_of(refs.where("ref_kind = 'TEMPLATE_PARAM'"), nodes.where("type = 'ConceptNode'"))
    own = own.select("refid", "position", "declname", "defname", "defval", "concept").join(owner, "refid")
    name = F.coalesce(F.nullif("declname", F.lit("")), F.nullif("defname", F.lit("")), F.lit("T"))
    note = F.concat(F.lit("position="), F.col("position").cast("string"), F.when(F.col("defval") != "", F.concat(F.lit(" defval="), F.col("defval"))).otherwise(""))
    own = own.withColumns({"qualified_name": F.concat_ws(":", F.lit("type_param"), "_owner", "position"), "type": F.lit("ClassNode"), "source": F.lit(source), "kind": F.lit("type_parameter"), "name": name, "definition": note})
    own = own.withColumn("dst_uid", schema.uid("qualified_name"))
    fresh = schema.conform(own.select(F.col("dst_uid").alias("uid"), "type", "source", "kind", "name", "qualified_name", "definition").dropDuplicates(["uid"]), schema.NODES)
    link = own.select("src_uid", "dst_uid", F.lit("TEMPLATE_PARAM").alias("rel_type"))
    c = nodes.where("type = 'ConceptNode'").groupBy(F.col("qualified_name").alias("concept")).agg(F.min("uid").alias("_c"))
    enforce = own.join(c, "concept").select(F.col("dst_uid").alias("src_uid"), F.col("_c").alias("dst_uid"), F.lit("ENFORCES_CONCEPT").alias("rel_type"))
    return fresh, schema.conform(link.unionByName(enforce), schema.EDGES)


def compose_namespaces(nodes: DataFrame, sep: str = "::") -> DataFrame:
    """COMPOSES edges from each namespace to its immediate children of the same source."""
    ns = nodes.where("type = 'NamespaceNode'").groupBy("qualified_name", "source").agg(F.min("uid").alias("src_uid"))
    child = nodes.where(F.col("type").isin("NamespaceNode", *schema.COMPOUNDS, "FunctionNode")).where("coalesce(kind, '') <> 'type_parameter'")
    child = child.select(F.col("uid").alias("dst_uid"), "source", names.parent_name(F.col("qualified_name"), sep).alias("qualified_name")).where("qualified_name <> ''")
    return child.join(ns, ["qualified_name", "source"]).where("src_uid <> dst_uid").select("src_uid", "dst_uid", F.lit("COMPOSES").alias("rel_type"))


def derive(nodes: DataFrame, refs: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """All nodes, with those of template parameters, and all edges."""
    ids = nodes.where("refid <> '' and type <> 'ParameterNode'").groupBy("refid").agg(F.min("uid").alias("id"))
    from_, to = ids.toDF("refid", "src_uid"), ids.toDF("to_refid", "dst_uid")
    by_name = nodes.where(F.col("type").isin(*schema.COMPOUNDS)).groupBy(F.col("qualified_name").alias("to_name")).agg(F.min_by("uid", F.struct("ord", "uid")).alias("named"))
    parts = []

    def emit(df: DataFrame, kind: str) -> None:
        parts.append(schema.conform(df.withColumn("rel_type", F.lit(kind)), schema.EDGES))

    owned = nodes.where("type not in ('ParameterNode', 'FileNode')")
    emit(owned.where("compound_refid is not null").select("compound_refid", F.col("uid").alias("dst_uid")).join(ids.toDF("compound_refid", "src_uid"), "compound_refid").join(nodes.where(F.col("type").isin(*schema.COMPOUNDS)).select(F.col("uid").alias("src_uid")), "src_uid", "left_semi"), "COMPOSES")
    emit(compose_namespaces(nodes), "COMPOSES")
    emit(nodes.where("type = 'ParameterNode'").select("position", F.col("uid").alias("dst_uid"), F.col("member_refid").alias("refid")).join(from_, "refid"), "HAS_PARAMETER")
    files = nodes.where("type = 'FileNode' and file_path <> ''").groupBy("file_path").agg(F.min("uid").alias("dst_uid"))
    emit(owned.where("file_path <> ''").select(F.col("uid").alias("src_uid"), "file_path").join(files, "file_path"), "DEFINED_IN")
    of = lambda kind: refs.where(F.col("ref_kind") == kind)
    emit(of("INCLUDES").select("refid", "to_refid", "included_file", "is_local").join(from_, "refid").join(to, "to_refid", "left").withColumn("dst_name", F.col("included_file")), "INCLUDES")
    bases = of("INHERITS_FROM").select("refid", "to_refid", "to_name").join(from_, "refid").join(to, "to_refid", "left").join(by_name, "to_name", "left")
    emit(bases.withColumn("dst_uid", F.coalesce("dst_uid", "named")).withColumn("dst_name", F.col("to_name")).where("dst_uid is not null"), "INHERITS_FROM")
    calls = of("INVOKES").select("refid", "to_refid", F.col("to_name").alias("dst_name")).join(from_, "refid").join(to, "to_refid").select("src_uid", "dst_uid", "dst_name")
    back = of("INVOKED_BY").select(F.col("refid").alias("to_refid"), F.col("to_refid").alias("refid")).join(from_, "refid").join(to, "to_refid").select("src_uid", "dst_uid", F.lit(None).cast("string").alias("dst_name"))
    emit(calls.unionByName(back).groupBy("src_uid", "dst_uid").agg(F.max("dst_name").alias("dst_name")), "INVOKES")
    emit(of("DEPENDS_ON").select("refid", "to_refid").distinct().join(from_, "refid").join(to, "to_refid").where("src_uid <> dst_uid"), "DEPENDS_ON")
    emit(of("SPECIALIZES").select("refid", "to_name").join(from_, "refid").join(by_name, "to_name").select("src_uid", F.col("named").alias("dst_uid")), "SPECIALIZES")
    fresh, link = template_parameters(nodes, refs, source)
    edges = link
    for p in parts:
        edges = edges.unionByName(p)
    edges = edges.withColumn("source", F.lit(source)).dropDuplicates(["src_uid", "rel_type", "dst_uid", "dst_name", "position"])
    return nodes.unionByName(fresh), store.materialize(edges, "xml-edges")


def implement(spark: SparkSession, nodes: DataFrame, base: str) -> tuple[DataFrame, DataFrame]:
    """ImplementationNodes with the source lines of callables and macros that have a body, and HAS_IMPLEMENTATION edges.

    Each source file is read once and joined to its members; bounds outside the file, and blank bodies, give none.
    """
    prefix = base.rstrip("/") + "/"
    own = nodes.where(F.col("type").isin("MethodNode", "FunctionNode", "DefineNode") & (F.col("body_start") > 0) & (F.col("body_end") > 0) & (F.col("file_path") != ""))
    own = own.withColumn("_path", F.when(F.col("file_path").startswith("/"), F.col("file_path")).otherwise(F.concat(F.lit(prefix), "file_path")))
    text = spark.read.option("recursiveFileLookup", "true").text(base, wholetext=True).select(F.regexp_replace(F.col("_metadata.file_path"), r"^(file:)?/+", "/").alias("_path"), F.col("value").alias("_text"))
    body = F.regexp_replace(names.implementation(F.regexp_replace("_text", "\n$", ""), F.col("body_start"), F.col("body_end")), r"\n+$", "")
    got = own.join(text, "_path").withColumn("implementation", body).where("implementation is not null")
    got = got.select(F.col("uid").alias("src_uid"), "source", "layer", "qualified_name", "implementation", F.lit("ImplementationNode").alias("type"), F.lit("implementation").alias("kind"), F.array().cast("array<float>").alias("impl_embedding"))
    got = got.withColumn("uid", schema.uid("qualified_name"))
    link = got.select("src_uid", F.col("uid").alias("dst_uid"), F.lit("HAS_IMPLEMENTATION").alias("rel_type"), "source")
    return schema.conform(got.drop("src_uid").dropDuplicates(["uid"]), schema.NODES), schema.conform(link, schema.EDGES)
