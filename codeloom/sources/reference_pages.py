"""Pages of an HTML reference of the C++ library as nodes and edges: pages are classed by their paths with joins, then read in parallel."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom import schema
from codeloom.functions import names
from codeloom.operators import store, upsert
from codeloom.sources import doxygen_xml

SKIPPED_DIRS = tuple("comment experimental keyword language links preprocessor regex symbol_index types".split())
#: Pages at the top that are overviews, not symbols.
SKIPPED_PAGES = tuple("types text symbol_index standard_library preprocessor meta links language keywords keyword index headers freestanding feature_test experimental execution current_status coroutine concepts compiler_support comments comment 26 23 20 17 14 11".split())
#: Namespaces of the folders that aren't plain std.
SPACES = {"chrono": "std::chrono", "filesystem": "std::filesystem", "ranges": "std::ranges", "header": "", "named_req": ""}
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Node:
    """An element: tag, attributes, and children, which are elements or texts."""

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def walk(self) -> Iterator[Node]:
        yield self
        for c in self.children:
            if isinstance(c, Node):
                yield from c.walk()

    def find(self, tag: str, cls: str | None = None) -> list[Node]:
        return [n for n in self.walk() if n.tag == tag and (cls is None or cls in n.classes())]

    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()

    def text(self) -> str:
        parts, todo = [], [self]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                parts.append(n)
            elif n.tag not in ("script", "style"):
                todo += reversed(n.children)
        return " ".join(" ".join(parts).split())


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__()
        self.root = Node("root", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs})
        if tag in ("td", "tr", "p", "li"):  # their end tags may be left out
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k].tag == tag:
                    del self.open[k:]
                    break
                if self.open[k].tag in ("table", "ul", "ol", "div"):
                    break
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def tree(html: str) -> Node:
    t = _Tree()
    t.feed(html)
    t.close()
    return t.root


def title(page: Node) -> str:
    for own in (page.find("span", "mw-page-title-main"), page.find("h1"), page.find("title")):
        if own:
            return re.sub(r"\s+[-–—]\s+\S+\.com.*$", "", own[0].text())
    return ""


def description(page: Node) -> tuple[str, str]:
    """(first paragraph, the others) before the first heading, table of symbols or contents."""
    body = (page.find("div", "mw-parser-output") or [n for n in page.find("div") if n.attrs.get("id") == "mw-content-text"] or page.find("body") or [page])[0]
    said = []
    for c in body.children:
        if not isinstance(c, Node):
            continue
        if c.tag in ("h2", "h3", "h4") or c.attrs.get("id") == "toc" or (c.tag == "table" and {"t-dcl-begin", "t-dsc-begin"} & set(c.classes())):
            break
        if c.tag == "p" and c.text():
            said.append(c.text())
    return (said[0] if said else ""), " ".join(said[1:])


def _rows(page: Node, kind: str) -> list[tuple[Node, list[Node]]]:
    return [(r, r.find("td")) for t in page.find("table", f"t-{kind}-begin") for r in t.find("tr", f"t-{kind}")]


def declarations(page: Node) -> list[tuple[str, str, str]]:
    """(text, since, until) of each declaration row."""
    out = []
    for row, cells in _rows(page, "dcl"):
        if cells and cells[0].text():
            marks = dict(re.findall(r"t-(since|until)-cxx(\d+)", " ".join(row.classes())))
            out.append((cells[0].text(), *(f"C++{marks[k]}" if k in marks else "" for k in ("since", "until"))))
    return out


def members(page: Node) -> list[tuple[str, str, str]]:
    """(name, link, brief) of each row of a member table."""
    out = []
    for _, cells in _rows(page, "dsc"):
        if len(cells) >= 2:
            link = cells[0].find("a")
            name = (link[0].text() if link else "") or cells[0].text()
            if name:
                out.append((name, link[0].attrs.get("href", "") if link else "", cells[1].text()))
    return out


def parameters(page: Node) -> list[tuple[str, str]]:
    return [(c[0].text(), c[2].text()) for _, c in _rows(page, "par") if len(c) >= 3 and c[0].text()]


def bases(page: Node) -> list[str]:
    found = [a.attrs.get("title", "").rsplit("/", 1)[-1] for d in page.find("div", "t-inheritance-diagram")[:1] for a in d.find("area")]
    if not any(found):
        found = [r.find("a")[0].text() for r, _ in _rows(page, "dsc") if re.search("(inherits|derived) from", r.text(), re.I) and r.find("a")]
    return [x for x in found if x]


def signature(text: str) -> tuple[str, str, str, list[tuple[str, str, str]]]:
    """(return type, name, arguments, [(type, name, default)]) of a declaration; empty where it is no function's."""
    text = re.sub(r"\s*;\s*$", "", " ".join(text.split()))
    text = re.sub(r"\s*\((?:\d+|(?:since|until|deprecated in) C\+\+\d+)\)\s*$", "", re.sub(r"\s*\(\d+\)\s*$", "", text))
    found = re.match(r"(?:template\s*<[^>]*>\s*)?(.*?)\b(\w+(?:::\w+)*)\s*(\([^)]*\))", text, re.S)
    if not found:
        return "", "", "", []
    out, inner = [], found[3][1:-1].strip()
    for part in re.split(r",(?![^<>]*>)", inner) if inner not in ("", "void") else []:
        if part.strip():
            one = re.match(r"(.*?)\s+(\w+)\s*(?:=\s*(.*))?$", part.strip())
            out.append((one[1].strip(), one[2], one[3] or "") if one else (part.strip(), "", ""))
    return found[1].strip(), found[2], found[3], out


def qualified(name: str, relative: str) -> str:
    name = re.sub(r"\s*::\s*", "::", name).strip()
    space = SPACES.get(relative.split("/")[2] if relative.count("/") >= 2 else "", "std")
    return name if "::" in name or not space else f"{space}::{name}"


def _page_rows(kind: str, relative: str, refid: str, parent: str, prefix: str, page: Node) -> list[dict]:
    brief, detail = description(page)
    common = {"brief_description": brief, "detailed_description": detail}
    if kind == "HEADER":
        name = posixpath.basename(relative).removesuffix(".html")
        rows = [{"type": "FileNode", "refid": refid, "name": f"<{name}>", "file_path": relative, "language": "C++"}]
        for _, link, _ in members(page):
            if link:
                to = posixpath.normpath(f"{posixpath.dirname(relative)}/{link}").removeprefix("en/").removesuffix(".html")
                rows.append({"type": "ref", "ref_kind": "DECLARES", "refid": refid, "to_refid": prefix + to, "included_file": relative})
        return rows
    if kind == "CLASS":
        qn = qualified(title(page), relative)
        rows = [{"type": "ClassNode", "kind": "class", "refid": refid, "name": qn.rsplit("::", 1)[-1], "qualified_name": qn, "module": qn.rpartition("::")[0], "base_classes": bases(page), "is_final": False, "is_abstract": False, **common}]
        rows += [{"type": "ref", "ref_kind": "INHERITS_FROM", "refid": refid, "to_refid": "", "to_name": b if "::" in b else f"{qn.rpartition('::')[0]}::{b}"} for b in bases(page)]
        for name, link, said in members(page):
            name = re.sub(r"^\((.+)\)$", r"\1", name)
            at = f"{refid}/{link.rstrip('/').removesuffix('.html').rsplit('/', 1)[-1]}" if link else f"{refid}/{name}"
            rows.append({"type": "MethodNode", "kind": "stub", "refid": at, "compound_refid": refid, "name": name, "qualified_name": f"{qn}::{name}", "brief_description": said, "argsstring": ""})
        return rows
    label, rows, listed = "MethodNode" if kind == "MEMBER" else "FunctionNode", [], parameters(page)
    owner = qualified(parent.rsplit("/", 1)[-1], "en/" + parent.removeprefix(prefix)) if kind == "MEMBER" else ""
    for k, text in enumerate([d[0] for d in declarations(page)] or [""]):
        gives, name, args, params = signature(text)
        whole = qualified(title(page), relative)
        if name:
            whole = name if "::" in name else f"{owner}::{name}" if owner else qualified(name, relative)
        short = name or whole.rsplit("::", 1)[-1]
        args_ = doxygen_xml.plain_args(args) if name or kind == "FREE_FUNCTION" else ""
        own = f"{refid}#{k}"
        rows.append({"type": label, "kind": "function", "refid": own, "compound_refid": parent or None, "name": short, "qualified_name": f"::{short}{args_}" if kind == "FREE_FUNCTION" else whole + args_, "type_signature": gives, "definition": text.rstrip("; "), "argsstring": args, "protection": "public", **common})
        for i, (t, n, d) in enumerate(params or ([("", n, "") for n, _ in listed] if name else [])):
            rows.append({"type": "ParameterNode", "refid": f"{own}#{i}", "member_refid": own, "position": i, "name": n, "type_signature": t, "default_value": d})
    return rows


def classify(pages: DataFrame, prefix: str) -> DataFrame:
    """pages (relative, content) that stand for symbols, with page_type, refid and parent_refid."""
    rel = F.regexp_replace("relative", r"^en/cpp/", "")
    parts, stem = F.split("_rel", "/"), F.regexp_replace("_rel", r"\.html$", "")
    own = pages.withColumn("_rel", rel).withColumns({"_stem": stem, "_first": F.element_at(parts, 1), "_n": F.size(parts), "_dir": F.regexp_replace("_rel", r"/?[^/]*$", "")})
    dirs = own.select(F.explode(F.transform(F.sequence(F.lit(1), F.col("_n")), lambda i: F.array_join(F.slice(F.split("_rel", "/"), F.lit(1), i - 1), "/"))).alias("_stem")).where("_stem <> ''").distinct()
    exist = own.select(F.col("_stem").alias("_dir")).distinct()
    own = own.where(~F.col("_first").isin(*SKIPPED_DIRS) & ~F.regexp_extract("_stem", r"([^/]*)$", 1).isin("index", "cpp") & ~((F.col("_n") == 1) & F.col("_stem").isin(*SKIPPED_PAGES)))
    own = own.join(dirs.withColumn("_has_dir", F.lit(True)), "_stem", "left").join(exist.withColumn("_has_parent", F.lit(True)), "_dir", "left")
    # a page whose first declaration says class or struct is one, though it has no pages below it
    first = F.regexp_extract(F.decode("content", "utf-8"), r'(?s)<tr\s[^>]*\bclass="t-dcl.*?(?:(?=<tr)|$)', 0).substr(5, 5000)
    inline = first.rlike(r'<span[^>]*\bclass="kw1"[^>]*>\s*(class|struct)\s*<')
    kind = (
        F.when((F.col("_first") == "header") & (F.col("_n") == 2), "HEADER").when(F.col("_has_dir").isNotNull(), "CLASS").when(F.col("_n") < 2, "FREE_FUNCTION")
        .when(F.col("_has_parent").isNotNull(), F.when(inline, "CLASS").otherwise("MEMBER")).otherwise("FREE_FUNCTION")
    )
    out = own.withColumns({"page_type": kind, "refid": F.concat(F.lit(prefix + "cpp/"), "_stem")})
    return out.select("relative", "content", "page_type", "refid", F.when(F.col("page_type") == "MEMBER", F.concat(F.lit(prefix + "cpp/"), "_dir")).otherwise("").alias("parent_refid"))


def namespaces_of(qn: Column) -> Column:
    """All names that stand before a separator, arguments and a leading separator left out."""
    return F.filter(names.prefixes(qn), lambda x: x != "")


def read(spark: SparkSession, root: str, source: str = "stdlib", prefix: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the pages below en/cpp of ``root``.  A page that can't be read gives nothing."""
    prefix = prefix if prefix is not None else f"{source}:"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.html").load(root)
    pages = files.select(F.regexp_extract("path", r"(en/cpp/.*)$", 1).alias("relative"), "content").where("relative <> ''")
    columns = [c for c, _ in schema.columns(doxygen_xml._ROW)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[dict] = []
            for rel, content, kind, refid, parent in zip(b.relative, b.content, b.page_type, b.refid, b.parent_refid):
                got = _page_rows(kind, rel, refid, parent, prefix, tree(bytes(content).decode("utf-8", "replace")))
                rows += [r | {"ord": k, "language": r.get("language", "C++")} for k, r in enumerate(got)]
            yield pd.DataFrame(rows, columns=columns).astype(object).where(lambda x: x.notna(), None)

    rows = store.materialize(classify(pages, prefix).mapInPandas(run, doxygen_xml._ROW), "page-rows")
    refs, own = rows.where("type = 'ref'"), rows.where("type <> 'ref'")
    methods = upsert.replace_stubs(own.where("type = 'MethodNode' and kind = 'stub'"), own.where("type = 'MethodNode' and kind <> 'stub'")).withColumn("kind", F.lit("function"))
    own = own.where("type <> 'MethodNode'").unionByName(methods)
    # a symbol's header is the last one that lists it
    header = refs.where("ref_kind = 'DECLARES'").groupBy(F.col("to_refid").alias("_base")).agg(F.max("included_file").alias("_header"))
    base = F.when(F.col("type").isin("ClassNode", "MethodNode", "FunctionNode"), F.substring_index("refid", "#", 1))
    own = own.withColumn("_base", base).join(header, "_base", "left").withColumn("file_path", F.coalesce("_header", "file_path")).drop("_base", "_header")
    spaces = own.where("qualified_name is not null").select(F.explode(namespaces_of(F.col("qualified_name"))).alias("qualified_name")).distinct()
    spaces = spaces.join(own.where("type = 'ClassNode'").select("qualified_name"), "qualified_name", "left_anti")
    spaces = spaces.select(F.lit("NamespaceNode").alias("type"), names.short_name(F.col("qualified_name")).alias("name"), "qualified_name", F.concat(F.lit(prefix + "ns/"), F.regexp_replace("qualified_name", "::", "/")).alias("refid"))
    own = own.unionByName(spaces, allowMissingColumns=True).withColumns({"source": F.lit(source), "layer": F.when(F.col("type") != "FileNode", "dependency"), "tags": F.when(F.col("type") != "FileNode", F.array(F.lit("dependency"))), "source_type": F.when(F.col("type") == "ClassNode", "header")})
    path_or_name = F.when(F.col("type") == "FileNode", F.col("file_path")).otherwise(F.col("qualified_name"))
    own = own.withColumn("uid", schema.uid(path_or_name, F.when(F.col("argsstring").isNotNull(), names.normal_args(F.col("argsstring"))), "member_refid", "position"))
    nodes = store.materialize(schema.conform(own, schema.NODES).dropDuplicates(["uid"]), "page-nodes")
    return doxygen_xml.derive(nodes, refs.where("ref_kind <> 'DECLARES'"), source)
