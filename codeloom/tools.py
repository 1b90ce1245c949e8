"""Navigation of a code graph.  Every method returns a lazily planned DataFrame over (nodes, edges)."""

from __future__ import annotations

import inspect

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom import schema
from codeloom.functions import names
from codeloom.operators import fulltext, traverse


def _brief():
    return F.col("brief_description").alias("brief")


class GraphTools:
    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self.nodes, self.edges = nodes, edges

    # parts
    def compounds(self) -> DataFrame:
        return self.nodes.where(F.col("type").isin(*schema.COMPOUNDS))

    def members(self) -> DataFrame:
        return self.nodes.where(F.col("type").isin(*schema.MEMBERS))

    def rel(self, kind: str) -> DataFrame:
        return self.edges.where(F.col("rel_type") == schema.ALIASES.get(kind, kind))

    def owners(self) -> DataFrame:
        """(member uid, compound_name, compound_qualified_name)"""
        c = self.compounds().select(F.col("uid").alias("src_uid"), F.col("name").alias("compound_name"), F.col("qualified_name").alias("compound_qualified_name"))
        return self.rel("COMPOSES").join(c, "src_uid").select(F.col("dst_uid").alias("uid"), "compound_name", "compound_qualified_name")

    @staticmethod
    def _named(df: DataFrame, name: str | None, exact: bool = True, both: bool = True) -> DataFrame:
        """Rows of that name or qualified name; all rows if no name is given."""
        if name is None:
            return df
        if exact:
            return df.where((F.col("name") == name) | (F.col("qualified_name") == name))
        hit = F.col("name").contains(name)
        return df.where(hit | F.col("qualified_name").contains(name) if both else hit)

    @staticmethod
    def _equal(df: DataFrame, **given) -> DataFrame:
        for c, v in given.items():
            if v is not None:
                df = df.where(F.col(c) == v)
        return df

    # sources and statistics
    def list_sources(self) -> DataFrame:
        return self.nodes.where("source is not null").groupBy("source", F.col("type").alias("node_type")).agg(F.count("*").alias("count")).orderBy("source", "node_type")

    def get_statistics(self) -> DataFrame:
        """(section, key, count)"""

        def by(df: DataFrame, section: str, key: str) -> DataFrame:
            return df.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("count")).select(F.lit(section).alias("section"), "key", "count")

        parts = [(self.nodes, "nodes", "type"), (self.edges, "relationships", "rel_type"), (self.compounds(), "compounds_by_kind", "kind"), (self.members(), "members_by_kind", "kind")]
        out = by(*parts[0])
        for p in parts[1:]:
            out = out.unionByName(by(*p))
        return out.orderBy("section", F.desc("count"), F.asc_nulls_last("key"))

    # search
    def _ranked(self, query: str, limit: int) -> DataFrame:
        text = F.concat_ws(" ", "name", "qualified_name", "brief_description", "detailed_description")
        own = self.nodes.where(F.col("type").isin(*schema.COMPOUNDS, *schema.MEMBERS)).select("*", text.alias("_text"))
        return own.join(fulltext.search(own, "uid", "_text", query, limit), "uid")

    def _containing(self, query: str, columns: tuple[str, ...], limit: int) -> DataFrame:
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.coalesce(F.lower(c).contains(query.lower()), F.lit(False))
        own = self.nodes.where(F.col("type").isin(*schema.COMPOUNDS, *schema.MEMBERS)).where(hit)
        return own.orderBy("qualified_name", "uid").limit(limit).withColumn("score", F.lit(0.0))

    @staticmethod
    def _or_else(first: DataFrame, second: DataFrame) -> DataFrame:
        """The first rows, or the second if there are none; one row of a count decides, within the plan."""
        none = first.agg((F.count("*") == 0).alias("_none"))
        return first.drop("_text").unionByName(second.crossJoin(F.broadcast(none)).where("_none").drop("_none"), allowMissingColumns=True)

    def search_symbols(self, query: str, source: str | None = None, kind: str | None = None, limit: int = 20) -> DataFrame:
        """Ranked by full text; where nothing matches, symbols whose name contains the query."""
        own = GraphTools(self._equal(self.nodes, source=source, kind=kind), self.edges)
        return self._or_else(own._ranked(query, limit), own._containing(query, ("name", "qualified_name"), limit)).select(F.col("type").alias("node_type"), "name", "qualified_name", "kind", _brief(), "source", "score").orderBy(F.desc("score"), "qualified_name")

    def search_documentation(self, query: str, limit: int = 20) -> DataFrame:
        """Ranked by full text; where nothing matches, symbols whose descriptions contain the query."""
        return self._or_else(self._ranked(query, limit), self._containing(query, ("detailed_description", "brief_description"), limit)).select("name", "qualified_name", F.coalesce("detailed_description", "brief_description").alias("description"), "score").orderBy(F.desc("score"), "qualified_name")

    def find_class(self, name: str | None = None, exact: bool = True) -> DataFrame:
        return self._named(self.compounds(), name, exact).select("name", "qualified_name", "kind", "brief_description", "detailed_description", "base_classes", "is_final", "is_abstract", "file_path", "line_number").orderBy("qualified_name")

    def find_function(self, name: str | None = None, class_name: str | None = None, exact: bool = True) -> DataFrame:
        own = self._named(self.members().where(F.col("type").isin("MethodNode", "FunctionNode")), name, exact, both=class_name is None)
        out = own.join(self.owners(), "uid", "left")
        if class_name is not None:
            out = out.where((F.col("compound_name") == class_name) | (F.col("compound_qualified_name") == class_name))
        return out.select(
            "name", "qualified_name", F.col("type_signature").alias("type"), "definition", "argsstring", "brief_description", "protection", "is_static", "is_const", "is_virtual", "is_constexpr", "file_path", "line_number", F.col("compound_name").alias("class_name")
        ).orderBy("qualified_name")

    # detail
    def _linked(self, kind: str, from_: str, to: str, name: str) -> DataFrame:
        other = self.nodes.select(F.col("uid").alias(to), F.col("qualified_name").alias("_q"))
        return self.rel(kind).join(other, to).groupBy(F.col(from_).alias("uid")).agg(F.array_sort(F.collect_set("_q")).alias(name))

    def get_compound(self, name: str | None = None, source: str | None = None) -> DataFrame:
        """A row for each member, one with null members where there is none."""
        own = self._equal(self._named(self.compounds(), name), source=source)
        out = own.join(self._linked("INHERITS_FROM", "src_uid", "dst_uid", "bases"), "uid", "left").join(self._linked("INHERITS_FROM", "dst_uid", "src_uid", "derived"), "uid", "left")
        m = self.members().select(
            F.col("uid").alias("dst_uid"), F.col("name").alias("member_name"), F.col("kind").alias("member_kind"), F.col("definition").alias("member_definition"), F.col("argsstring").alias("member_args"), F.col("protection").alias("member_protection"), F.col("brief_description").alias("member_brief"), F.col("refid").alias("member_refid")
        )
        rows = self.rel("COMPOSES").select(F.col("src_uid").alias("uid"), "dst_uid").join(m, "dst_uid").drop("dst_uid")
        none = F.array().cast("array<string>")
        return out.drop("member_refid").join(rows, "uid", "left").select(
            "name", "qualified_name", "kind", _brief(), F.col("detailed_description").alias("detailed"), "source", "is_abstract", "is_final", F.coalesce("bases", none).alias("base_classes"), F.coalesce("derived", none).alias("derived_classes"), *[c for c in rows.columns if c != "uid"]
        ).orderBy(F.asc_nulls_last("member_kind"), F.asc_nulls_last("member_name"))

    def parameters(self) -> DataFrame:
        p = self.nodes.where("type = 'ParameterNode'").select(F.col("uid").alias("dst_uid"), F.struct("position", "name", F.col("type_signature").alias("type"), "default_value").alias("p"))
        return self.rel("HAS_PARAMETER").select(F.col("src_uid").alias("uid"), "dst_uid").join(p, "dst_uid").groupBy("uid").agg(F.array_sort(F.collect_list("p")).alias("params"))

    def get_member(self, name: str | None = None, source: str | None = None, fuzzy: bool = False) -> DataFrame:
        """A row for each member; params holds one entry of nulls where it has none."""
        own = self._equal(self._named(self.members(), name, not fuzzy), source=source)
        out = own.join(self.owners(), "uid", "left").join(self.parameters(), "uid", "left")
        return out.select(
            "name", "qualified_name", "kind", F.col("type_signature").alias("return_type"), "definition", "argsstring", _brief(), F.col("detailed_description").alias("detailed"), "protection", "is_static", "is_const", "is_virtual", "source", "compound_name", "compound_qualified_name", F.coalesce("params", F.array(F.struct(*(F.lit(None).cast(t).alias(c) for c, t in (("position", "int"), ("name", "string"), ("type", "string"), ("default_value", "string")))))).alias("params"),
        )

    def get_function_parameters(self, name: str | None = None, class_name: str | None = None) -> DataFrame:
        own = self._named(self.members().where(F.col("type").isin("MethodNode", "FunctionNode")), name)
        out = own.join(self.owners(), "uid", "left").join(self.parameters(), "uid", "left")
        if class_name is not None:
            out = out.where((F.col("compound_name") == class_name) | (F.col("compound_qualified_name") == class_name))
        return out.select("name", "qualified_name", "definition", "argsstring", F.col("compound_name").alias("class_name"), F.col("params").alias("parameters"))

    def get_class_members(self, class_name: str | None = None, include_private: bool = False, kind: str | None = None) -> DataFrame:
        """(class, category, members), members by line."""
        own = self._named(self.compounds(), class_name).select(F.col("uid").alias("src_uid"), F.col("name").alias("class"))
        m = self._equal(self.members(), kind=kind)
        if not include_private:
            m = m.where(F.col("protection").isin("public", "protected"))
        both = self.rel("COMPOSES").join(own, "src_uid").select("class", F.col("dst_uid").alias("uid")).join(m, "uid")
        static, k = F.coalesce("is_static", F.lit(False)), F.col("kind")
        group = (
            F.when(F.col("name") == F.col("class"), "constructors").when(F.col("name") == F.concat(F.lit("~"), "class"), "destructor")
            .when((k == "function") & static | (k == "staticmethod"), "static_methods").when(k.isin("function", "method", "classmethod", "property"), "methods").when((k == "variable") & static, "static_variables")
            .when(k == "variable", "variables").when(k == "typedef", "typedefs").when(k.isin("enum", "enumvalue"), "enums")
        )
        row = F.struct("line_number", "name", "qualified_name", "kind", "definition", "argsstring", "protection")
        return both.withColumn("category", group).where("category is not null").groupBy("class", "category").agg(F.array_sort(F.collect_list(row)).alias("members"))

    # namespaces and files
    def list_namespaces(self) -> DataFrame:
        return self.nodes.where("type = 'NamespaceNode'").select("name", "qualified_name").orderBy("qualified_name")

    def list_classes(self, namespace: str | None = None) -> DataFrame:
        own = self.compounds()
        if namespace:
            own = own.where(F.col("qualified_name").startswith(namespace + "::") | F.col("qualified_name").startswith(namespace + "."))
        return own.select("name", "qualified_name", "kind", "brief_description", "file_path", "line_number").orderBy("qualified_name")

    def browse_namespace(self, name: str | None = None, source: str | None = None, limit: int = 50) -> DataFrame:
        """All compounds and all members whose names stand below a namespace, nested ones too.

        Each half is limited by itself; a namespace without compounds gives one row of nulls.
        """
        ns = self._named(self.nodes.where("type = 'NamespaceNode'"), name)
        ns = (ns.where(F.col("source").contains(source)) if source is not None else ns).select(F.col("qualified_name").alias("namespace")).distinct()

        def half(df: DataFrame, label: str, how: str) -> DataFrame:
            above = F.array_distinct(F.concat(names.prefixes(F.col("qualified_name")), names.prefixes(F.col("qualified_name"), ".")))
            below = df.select("name", "qualified_name", "kind", "brief_description", "source", F.explode(above).alias("namespace"))
            rows = ns.join(below, "namespace", how).orderBy(F.asc_nulls_last("kind"), F.asc_nulls_last("name"), F.asc_nulls_last("qualified_name"), "namespace").limit(limit)
            return rows.select("namespace", F.lit(label).alias("node_type"), "name", "qualified_name", "kind", _brief(), "source")

        return half(self.compounds(), "compound", "left").unionByName(half(self.members(), "member", "inner"))

    def get_file_symbols(self, path: str) -> DataFrame:
        """(file, category, name, qualified_name, kind, line_number)"""
        k, t = F.col("kind"), F.col("type")
        group = F.when(t.isin(*schema.COMPOUNDS), "classes").when(t.isin("MethodNode", "FunctionNode"), "functions").when(k == "variable", "variables").when(k == "typedef", "typedefs")
        own = self.nodes.where(F.col("file_path").contains(path)).withColumn("category", group).where("category is not null")
        return own.select(F.col("file_path").alias("file"), "category", "name", "qualified_name", "kind", "line_number").orderBy("category", "line_number", "qualified_name")

    def get_includes(self, path: str) -> DataFrame:
        """(file, direction, included_file, other_refid, is_local)"""
        f = self.nodes.where("type = 'FileNode'")
        own = f.where((F.col("file_path") == path) | (F.col("name") == path)).select("uid", F.col("name").alias("file"))
        e, n = self.rel("INCLUDES"), f.select(F.col("uid").alias("o"), F.col("name").alias("other"), F.col("refid").alias("other_refid"))
        out = own.join(e, own.uid == e.src_uid).join(n, F.col("dst_uid") == n.o, "left").select("file", F.lit("includes").alias("direction"), F.coalesce("included_file", "other").alias("included_file"), "other_refid", "is_local")
        back = own.join(e, own.uid == e.dst_uid).join(n, F.col("src_uid") == n.o).select("file", F.lit("included_by").alias("direction"), F.col("other").alias("included_file"), "other_refid", "is_local")
        return out.unionByName(back)

    def get_include_chain(self, header: str) -> DataFrame:
        f = self.nodes.where("type = 'FileNode'")
        own = f.where((F.col("name") == header) | F.col("file_path").endswith(header))
        listed = self.rel("INCLUDES").groupBy(F.col("src_uid").alias("uid")).agg(F.array_sort(F.collect_list("included_file")).alias("includes"))
        return own.join(listed, "uid", "left").select(F.col("name").alias("file"), F.col("file_path").alias("path"), "source", F.coalesce("includes", F.array().cast("array<string>")).alias("includes"))

    # calls and inheritance
    def _calls(self, name: str | None, direction: str, class_name: str | None) -> DataFrame:
        here, there = ("dst_uid", "src_uid") if direction == "caller" else ("src_uid", "dst_uid")
        own = self._named(self.members(), name)
        if class_name is not None:
            own = own.join(self.owners().where((F.col("compound_name") == class_name) | (F.col("compound_qualified_name") == class_name)), "uid", "left_semi")
        ids = self.rel("INVOKES").join(own.select(F.col("uid").alias(here)), here).select(F.col(there).alias("uid")).distinct()
        return self.members().join(ids, "uid").join(self.owners(), "uid", "left")

    def get_callers(self, name: str | None = None, class_name: str | None = None) -> DataFrame:
        c = self._calls(name, "caller", class_name)
        return c.select(F.col("name").alias("caller_name"), F.col("qualified_name").alias("caller_qualified_name"), "definition", "file_path", "line_number", F.col("compound_name").alias("class_name")).distinct()

    def get_callees(self, name: str | None = None, class_name: str | None = None) -> DataFrame:
        c = self._calls(name, "callee", class_name)
        return c.select(F.col("name").alias("callee_name"), F.col("qualified_name").alias("callee_qualified_name"), "definition", "file_path", "line_number").distinct()

    def find_callers_and_callees(self, name: str | None = None, direction: str = "both", limit: int = 30) -> DataFrame:
        parts = [
            self._calls(name, d, None).select(F.lit(d).alias("direction"), "name", "qualified_name", "definition", "compound_name").orderBy("qualified_name", "name", "compound_name").limit(limit)
            for d in ("callee", "caller") if direction in ("both", d, d + "s")
        ]
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def _inheritance(self, up: bool) -> DataFrame:
        e = self.rel("INHERITS_FROM")
        return e.select(F.col("src_uid" if up else "dst_uid").alias("src"), F.col("dst_uid" if up else "src_uid").alias("dst"))

    def find_inheritance(self, name: str | None = None, direction: str = "both", max_depth: int = 5) -> DataFrame:
        start = self._named(self.compounds(), name).select(F.col("uid").alias("root"))
        out = None
        for label, up in (("base", True), ("derived", False)):
            if direction in ("both", "up" if up else "down"):
                p = traverse.paths(self._inheritance(up), start, max_depth).join(self.nodes.select(F.col("uid").alias("node"), "name", "qualified_name", "kind"), "node")
                p = p.select(F.lit(label).alias("direction"), "name", "qualified_name", "kind", "depth")
                out = p if out is None else out.unionByName(p)
        return out.orderBy("direction", "depth", "qualified_name")

    def get_class_hierarchy(self, name: str | None = None) -> DataFrame:
        """(class, relation, name, qualified_name, kind, file_path, line_number), walked from the class itself, not from its name."""
        own = self._named(self.compounds(), name)
        start = own.select(F.col("uid").alias("root"))
        out = None
        for label, up in (("base", True), ("derived", False)):
            r = traverse.reachable(self._inheritance(up), start).join(self.nodes.withColumnRenamed("uid", "node"), "node")
            r = r.join(own.select(F.col("uid").alias("root"), F.col("qualified_name").alias("class")), "root").select("class", F.lit(label).alias("relation"), "name", "qualified_name", "kind", "file_path", "line_number")
            out = r if out is None else out.unionByName(r)
        return out


#: The tools that a language model may call, and the JSON types of their arguments.
TOOLS = ("list_sources", "search_symbols", "get_compound", "get_member", "browse_namespace", "find_inheritance", "find_callers_and_callees", "get_statistics")
_JSON = {"str": "string", "int": "integer", "bool": "boolean"}


def schemas(tools: tuple[str, ...] = TOOLS) -> list[dict]:
    """A schema for each tool, from its signature and docstring: name, description, input_schema."""
    out = []
    for name in tools:
        method = getattr(GraphTools, name)
        given = [p for p in inspect.signature(method).parameters.values() if p.name != "self"]
        fields = {p.name: {"type": _JSON[str(p.annotation).split(" ")[0]]} | ({} if p.default in (None, p.empty) else {"default": p.default}) for p in given}
        needed = [p.name for p in given if p.default is p.empty]
        words = inspect.getdoc(method) or name.replace("_", " ").capitalize() + "."
        out.append({"name": name, "description": words, "input_schema": {"type": "object", "properties": fields, "required": needed}})
    return out


def call(tools: GraphTools, name: str, arguments: dict, limit: int = 1000) -> list[dict]:
    """Rows of one tool call as dictionaries, at most ``limit``; only the tools that have a schema can be called."""
    if name not in TOOLS:
        raise ValueError(f"no tool {name!r}")
    return [r.asDict(recursive=True) for r in getattr(tools, name)(**arguments).limit(limit).collect()]
