"""The engine's operators on the driver's tables, over whole tables, with the same query in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom import schema
from codeloom.functions import names
from codeloom.operators import fulltext, references, resolve, traverse, upsert
from codeloom.sources import doxygen_xml
from codeloom.tools import GraphTools


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def business_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The star schema as a code graph: regions are namespaces, nations classes, suppliers and parts members, supply a call.

    Nation n inherits from nation n // 2.
    """
    r, n, s, p, li = (_t(spark, d, x) for x in ("region", "nation", "supplier", "part", "lineitem"))
    rid, nid = F.concat(F.lit("r"), F.col("r_regionkey").cast("string")), F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))
    sid, pid = F.concat(F.lit("s"), F.col("s_suppkey").cast("string")), F.concat(F.lit("p"), F.col("p_partkey").cast("string"))
    rows = [
        r.select(rid.alias("uid"), F.lit("NamespaceNode").alias("type"), F.lit("region").alias("source"), F.col("r_name").alias("name"), F.col("r_name").alias("qualified_name"), F.lit("namespace").alias("kind")),
        n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(nid.alias("uid"), F.lit("ClassNode").alias("type"), F.lit("nation").alias("source"), F.col("n_name").alias("name"), F.concat_ws("::", "r_name", "n_name").alias("qualified_name"), F.lit("class").alias("kind")),
        s.select(sid.alias("uid"), F.lit("MethodNode").alias("type"), F.lit("supplier").alias("source"), F.col("s_name").alias("name"), F.col("s_name").alias("qualified_name"), F.lit("function").alias("kind")),
        p.select(pid.alias("uid"), F.lit("FunctionNode").alias("type"), F.lit("part").alias("source"), F.col("p_name").alias("name"), F.concat_ws("::", "p_brand", "p_name").alias("qualified_name"), F.col("p_type").alias("kind")),
    ]
    links = [
        n.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("src_uid"), nid.alias("dst_uid"), F.lit("COMPOSES").alias("rel_type")),
        s.select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("src_uid"), sid.alias("dst_uid"), F.lit("COMPOSES").alias("rel_type")),
        n.where("n_nationkey > 0").select(nid.alias("src_uid"), F.concat(F.lit("n"), F.floor(F.col("n_nationkey") / 2).cast("string")).alias("dst_uid"), F.lit("INHERITS_FROM").alias("rel_type")),
        li.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src_uid"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst_uid"), F.lit("INVOKES").alias("rel_type")).distinct(),
    ]
    nodes, edges = (schema.conform(x[0], ddl) for x, ddl in ((rows, schema.NODES), (links, schema.EDGES)))
    for x in rows[1:]:
        nodes = nodes.unionByName(schema.conform(x, schema.NODES))
    for x in links[1:]:
        edges = edges.unionByName(schema.conform(x, schema.EDGES))
    return nodes, edges


def _tools(spark: SparkSession, d: str) -> GraphTools:
    return GraphTools(*business_graph(spark, d))


def gr10_list_sources(spark, d):
    return _tools(spark, d).list_sources()


def gr18_statistics(spark, d):
    return _tools(spark, d).get_statistics()


def gr13_find_class(spark, d):
    return _tools(spark, d).find_class("1", exact=False).select("name", "qualified_name", "kind")


def gr14_find_function(spark, d):
    return _tools(spark, d).find_function("Supplier", exact=False).select("name", "qualified_name", "class_name")


def parameter_graph(spark: SparkSession, d: str) -> GraphTools:
    """Orders as functions, and their lines as parameters."""
    o, li = _t(spark, d, "orders"), _t(spark, d, "lineitem")
    oid = lambda c: F.concat(F.lit("o"), F.col(c).cast("string"))
    rows = schema.conform(o.select(oid("o_orderkey").alias("uid"), F.lit("FunctionNode").alias("type"), oid("o_orderkey").alias("name"), oid("o_orderkey").alias("qualified_name"), F.col("o_orderstatus").alias("kind")), schema.NODES)
    pid = F.concat_ws("#", oid("l_orderkey"), "l_linenumber", "l_partkey")
    lines = li.select(pid.alias("uid"), F.lit("ParameterNode").alias("type"), F.col("l_linenumber").cast("int").alias("position"), F.col("l_partkey").cast("string").alias("name"), oid("l_orderkey").alias("src")).dropDuplicates(["uid"])
    links = schema.conform(lines.select(F.col("src").alias("src_uid"), F.col("uid").alias("dst_uid"), F.lit("HAS_PARAMETER").alias("rel_type")), schema.EDGES)
    return GraphTools(rows.unionByName(schema.conform(lines.drop("src"), schema.NODES)), links)


def gr7_compound(spark, d):
    return _tools(spark, d).get_compound().select("qualified_name", "member_name")


def ag4_bases_and_derived(spark, d):
    one = _tools(spark, d).get_compound().select("qualified_name", F.array_join("base_classes", ",").alias("bases"), F.array_join("derived_classes", ",").alias("derived"))
    return one.distinct()


def gr8_member(spark, d):
    text = F.array_join(F.transform("params", lambda p: F.concat_ws(":", p["position"].cast("string"), p["name"])), ",")
    return parameter_graph(spark, d).get_member().select("qualified_name", text.alias("params"))


def gr15_parameters(spark, d):
    text = F.array_join(F.transform("parameters", lambda p: p["name"]), ",")
    return parameter_graph(spark, d).get_function_parameters(None).select("name", text.alias("parts"))


def gr3_callers(spark, d):
    return _tools(spark, d).get_callers().select("caller_name", "class_name")


def gr4_callees_of_class(spark, d):
    return _tools(spark, d).get_callees(None, "NATION_7").select("callee_name", "callee_qualified_name")


def gr6_calls_both_ways(spark, d):
    return _tools(spark, d).find_callers_and_callees(limit=40).select("direction", "qualified_name", "compound_name")


def gr5_inheritance(spark, d):
    return _tools(spark, d).find_inheritance(max_depth=3).select("direction", "qualified_name", "depth")


def gr17_hierarchy(spark, d):
    return _tools(spark, d).get_class_hierarchy().select("class", "relation", "qualified_name")


def gr16_class_members(spark, d):
    nodes, edges = business_graph(spark, d)
    kind = F.when(F.col("type") == "MethodNode", F.element_at(F.array(F.lit("function"), F.lit("variable"), F.lit("typedef"), F.lit("other")), (F.regexp_extract("uid", "([0-9]+)", 1).cast("int") % 4 + 1)))
    nodes = nodes.withColumns({"kind": F.coalesce(kind, "kind"), "protection": F.when(F.col("type") == "MethodNode", F.when(F.regexp_extract("uid", "([0-9]+)", 1).cast("int") % 3 == 0, "private").otherwise("public"))})
    got = GraphTools(nodes, edges).get_class_members()
    return got.select("class", "category", F.array_join(F.array_sort(F.transform("members", lambda m: m["name"])), ",").alias("members"))


def gr19_namespaces(spark, d):
    return _tools(spark, d).list_classes("ASIA").select("name", "qualified_name")


def gr9_browse(spark, d):
    return _tools(spark, d).browse_namespace("EUROPE").select("namespace", "node_type", "name", "qualified_name")


def tk5_browse_all(spark, d):
    return _tools(spark, d).browse_namespace(limit=12).select("namespace", "node_type", "qualified_name")


def gr1_reachable(spark, d):
    c = _t(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("src"), F.concat_ws("-", "conv_id", (F.col("turn") + 1)).alias("dst"), "turn")
    have = c.select(F.col("src").alias("dst"))
    start = c.where("turn = 0").select(F.col("src").alias("root"))
    return traverse.reachable(c.join(have, "dst", "left_semi").select("src", "dst"), start)


def gr2_paths(spark, d):
    """A graph with cycles: nation n leads to 2n and 2n + 1, modulo 25."""
    n = _t(spark, d, "nation").select("n_nationkey")
    e = n.select(F.col("n_nationkey").cast("string").alias("src"), F.explode(F.array(F.col("n_nationkey") * 2 % 25, (F.col("n_nationkey") * 2 + 1) % 25).cast("array<string>")).alias("dst"))
    return traverse.paths(e, n.select(F.col("n_nationkey").cast("string").alias("root")), 5)


def page_files(spark, d) -> GraphTools:
    """Pages as files, their links as includes."""
    p = _t(spark, d, "pages")
    uid = F.concat(F.lit("f"), F.col("page_id").cast("string"))
    rows = p.select(uid.alias("uid"), F.lit("FileNode").alias("type"), F.regexp_extract("url", r"([^/]*)$", 1).alias("name"), F.col("url").alias("file_path"), uid.alias("refid"))
    links = p.select(uid.alias("src_uid"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1))).alias("included_file"), F.lit("INCLUDES").alias("rel_type"))
    return GraphTools(schema.conform(rows, schema.NODES), schema.conform(links, schema.EDGES))


def pf5_include_chain(spark, d):
    return page_files(spark, d).get_include_chain(".html").select("path", F.size("includes").alias("n_includes"))


def jn2_members_outer(spark, d):
    return _tools(spark, d).get_member().select("qualified_name", "compound_name")


def pf7_predicates(spark, d):
    t = _tools(spark, d)
    found = t.find_function("g", exact=False).select(F.lit("contains").alias("rule"), "name").unionByName(t.find_class("NATION_3").select(F.lit("equals").alias("rule"), "name"))
    return found.unionByName(t.get_member("Supplier", fuzzy=True).select(F.lit("fuzzy").alias("rule"), "name"))


def sc1_args(spark, d):
    p = _t(spark, d, "part")
    args = F.concat(F.lit("("), F.regexp_replace("p_type", " ", "_"), F.lit(" first, const "), F.regexp_replace("p_brand", "#", "_"), F.lit("* second = "), F.col("p_size").cast("string"), F.lit(", unsigned long) const"))
    return p.select("p_partkey", names.normal_args(args).alias("args"))


def sc20_uid(spark, d):
    p = _t(spark, d, "part").select("p_partkey", F.lit("part").alias("source"), F.lit("MethodNode").alias("type"), F.col("p_name").alias("qualified_name"), "p_size")
    args = F.concat(F.lit("(int "), F.concat(F.lit("n"), F.col("p_size").cast("string")), F.lit(" = "), F.col("p_size").cast("string"), F.lit(")"))
    return p.select("p_partkey", schema.uid("qualified_name", names.normal_args(args)).alias("uid"))


def sc16_prefixes(spark, d):
    u = _t(spark, d, "pages").select(F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://([^?#]+)", 1), "/", "::").alias("q"))
    return u.select(F.explode(names.prefixes(F.col("q"))).alias("prefix")).groupBy("prefix").agg(F.count("*").alias("n"))


def jn18_longest_prefix(spark, d):
    u = _t(spark, d, "pages").select("page_id", F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://([^?#]+)", 1), "/", "::").alias("q"))
    table = u.select(F.element_at(F.split("q", "::"), 1).alias("p")).unionByName(u.where("q like '%::en::%'").select(F.concat(F.element_at(F.split("q", "::"), 1), F.lit("::en")).alias("p"))).distinct()
    return resolve.longest_prefix(u.unionByName(u.where("page_id % 5 = 0")), "q", table, "p").select("page_id", "p")  # repeated rows stay


def jn5_either_name(spark, d):
    p = _t(spark, d, "part").select("p_partkey", F.col("p_brand").alias("name"), F.col("p_type").alias("qualified_name"))
    tags = p.select(F.col("name").alias("tag")).unionByName(p.select(F.col("qualified_name").alias("tag"))).distinct()
    return resolve.by_either_name(tags, p, "tag").select("tag", "p_partkey").groupBy("tag").agg(F.countDistinct("p_partkey").alias("n"))


def jn15_resolve(spark, d):
    n, r, c = _t(spark, d, "nation"), _t(spark, d, "region"), _t(spark, d, "customer")
    s = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("string").alias("uid"), F.concat_ws("::", "r_name", "n_name").alias("qualified_name"), F.col("n_nationkey").cast("long").alias("ord"))
    refs = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").cast("string").alias("ref_id"), F.col("n_name").alias("ref_name"), F.lit("ASIA").alias("scope"))
    return resolve.resolve(refs, s, "::")


def jn19_within(spark, d):
    e = _t(spark, d, "events").select("event_id", "user_id", F.unix_timestamp("ts").alias("at"))
    spans = e.groupBy("user_id", F.floor(F.col("at") / 86400).alias("day")).agg(F.min("at").alias("a"), F.max("at").alias("b"))
    return resolve.within(e.unionByName(e.where("event_id % 7 = 0")), spans, "user_id", "at", "a", "b", ["a", "b"], width=86400).select("event_id", "a", "b")


def ups_snapshots(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("uid"), "o_orderstatus", F.lit("s").alias("source"), F.col("o_orderpriority").alias("type"))
    old, new = o.where("o_orderstatus <> 'O'"), o.where("o_orderstatus <> 'F'")
    both = upsert.merge(old, new).groupBy("type").agg(F.count("*").alias("n")).select(F.lit("merged").alias("what"), "type", "n")
    return both.unionByName(upsert.refresh(old, new, "s")[1].select(F.lit("deleted").alias("what"), "type", "n"))


def jn21_descriptions(spark, d):
    doc, lab = _t(spark, d, "documents"), _t(spark, d, "labels")
    new = doc.select(F.col("doc_id").cast("string").alias("qualified_name"), F.when(F.col("lang") == "en", "Setup block").otherwise(F.col("source")).alias("description"))
    old = lab.select(F.col("doc_id").cast("string").alias("qualified_name"), F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("description"))
    return upsert.keep_descriptions(new, old).select("qualified_name", "description")


def ft1_search(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "text")
    return fulltext.search(docs, "doc_id", "text", "stupid OR clown").select("doc_id", F.round("score", 6).alias("score"))


def text_graph(spark, d):
    """Customers as nodes whose text names others in the manner of qualified names."""
    c = _t(spark, d, "customer").join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    qn = F.concat_ws("::", "n_name", F.concat(F.lit("c"), F.col("c_custkey").cast("string")))
    ref = F.concat(F.lit("see "), F.col("n_name"), F.lit("::c"), ((F.col("c_custkey") * 7 + 1) % 500).cast("string"), F.lit("::more, and "), qn, F.lit(" of "), F.col("n_name"), F.lit("::none"))
    rows = c.select(F.col("c_custkey").cast("string").alias("uid"), F.lit("ClassNode").alias("type"), F.when(F.col("c_custkey") % 2 == 0, "even").otherwise("odd").alias("source"), qn.alias("qualified_name"), ref.alias("definition"), ref.alias("brief_description"), F.col("c_custkey").cast("long").alias("ord"))
    return schema.conform(rows, schema.NODES), schema.conform(rows.where("uid % 11 = 0").select(F.col("uid").alias("src_uid"), F.lit("0").alias("dst_uid"), F.lit("DEPENDS_ON").alias("rel_type")), schema.EDGES)


def dv10_exact_references(spark, d):
    nodes, edges = text_graph(spark, d)
    nodes = nodes.withColumn("definition", F.regexp_replace("definition", "::more", ""))
    return references.exact_references(nodes, edges, "even").select("src_uid", "dst_uid")


def dv11_prefix_references(spark, d):
    return references.prefix_references(*text_graph(spark, d)).select("src_uid", "dst_uid")


def dv12_source_tags(spark, d):
    p = _t(spark, d, "pages")
    path = F.when(F.col("page_id") % 3 > 0, F.concat(F.lit("/w/"), F.regexp_extract("url", r"://([^?#]*)", 1)))
    rows = p.select(F.col("page_id").cast("string").alias("uid"), path.alias("file_path"), F.concat(F.lit("lib"), (F.col("page_id") % 4).cast("string"), F.lit("::x")).alias("qualified_name"))
    folders = {"com": "/w/www.ththhe.example.com", "lib1": "/w/blog.ththan.example.net", "lib3": "/w/none"}
    return references.tag_sources(schema.conform(rows, schema.NODES), folders, "own", "/w/thther.example.org").select("uid", "source", F.array_join("tags", ",").alias("tags"))


def so5_split(spark, d):
    nodes, edges = business_graph(spark, d)
    kept = references.split_by_source(nodes, edges, "supplier")[1]
    return kept.groupBy("rel_type").agg(F.count("*").alias("n"), F.countDistinct("src_uid").alias("sources"))


def so4_stale(spark, d):
    doc = _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("uid"), "source")
    return upsert.stale(doc.withColumn("source", F.lit("s")), _t(spark, d, "labels").select(F.col("doc_id").cast("string").alias("uid")), "s").select("uid")


def ups4_refresh_rows(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("uid"), F.col("o_orderstatus").alias("type"), F.when(F.col("o_orderkey") % 5 == 0, F.lit(None)).when(F.col("o_orderkey") % 2 == 0, "even").otherwise("odd").alias("source"), F.col("o_custkey").cast("long").alias("ord"))
    new = o.where("source = 'even' and type <> 'O'").withColumn("ord", F.col("ord") + 1)
    return upsert.refresh(o, new.unionByName(new.withColumn("ord", F.col("ord") - 5)), "even")[0].select("uid", "type", "source", "ord")


def dv1_composition(spark, d):
    """Hosts and paths as nested namespaces, pages as classes in them."""
    u = _t(spark, d, "pages").select(F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://([^?#]+)", 1), "/", "::").alias("q"))
    spaces = u.select(F.explode(names.prefixes(F.col("q"))).alias("qualified_name")).distinct().withColumn("type", F.lit("NamespaceNode"))
    rows = spaces.unionByName(u.distinct().select(F.col("q").alias("qualified_name"), F.lit("ClassNode").alias("type")))
    nodes = schema.conform(rows.withColumns({"source": F.lit("web"), "uid": F.concat_ws("|", "type", "qualified_name")}), schema.NODES)
    return doxygen_xml.compose_namespaces(nodes).select("src_uid", "dst_uid")


def jn13_concepts(spark, d):
    n, r, c = _t(spark, d, "nation"), _t(spark, d, "region"), _t(spark, d, "customer")
    concepts = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat_ws("::", "r_name", "n_name").alias("qualified_name"), F.col("n_nationkey").cast("long").alias("ord"))
    own = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("typename "), F.col("n_name"))).when(F.col("c_custkey") % 3 == 1, F.col("n_name")).otherwise(F.concat(F.lit("ASIA::"), F.col("n_name"))).alias("to_name"))
    return doxygen_xml.concept_of(own, concepts).select("c_custkey", "concept")


def snk13_sources(spark, d):
    doc = _t(spark, d, "documents")
    old = doc.select((F.col("doc_id") % 100).cast("string").alias("refid"), "source", "lang")
    return references.accumulate_sources(old.where("lang <> 'de'"), old.where("lang = 'de'")).select("refid", "source")


def pf19_neighbourhood(spark, d):
    nodes, edges = references.neighbourhood(*business_graph(spark, d), "nation")
    a = nodes.groupBy(F.col("type").alias("what")).agg(F.count("*").alias("n"))
    return a.unionByName(edges.groupBy(F.col("rel_type").alias("what")).agg(F.count("*").alias("n")))


_ALL = (
    gr10_list_sources, gr18_statistics, gr13_find_class, gr14_find_function, gr7_compound, ag4_bases_and_derived, gr8_member, gr15_parameters, gr3_callers, gr4_callees_of_class, gr6_calls_both_ways, gr5_inheritance, gr17_hierarchy, gr16_class_members, gr19_namespaces, gr9_browse, tk5_browse_all, gr1_reachable, gr2_paths, pf5_include_chain, jn2_members_outer, pf7_predicates, sc1_args, sc20_uid, sc16_prefixes, jn18_longest_prefix, jn5_either_name, jn15_resolve, jn19_within, ups_snapshots, jn21_descriptions, ft1_search, dv10_exact_references, dv11_prefix_references, dv12_source_tags, so5_split, so4_stale, ups4_refresh_rows, dv1_composition, jn13_concepts, snk13_sources, pf19_neighbourhood,
)
QUERIES = {f.__name__: f for f in _ALL}

_Q = "SELECT page_id, replace(regexp_extract(url, '^[a-z]+://([^?#]+)', 1), '/', '::') AS q FROM pages"
_NATION = "SELECT n_nationkey, n_name, r_name, r_name || '::' || n_name AS q FROM nation JOIN region ON n_regionkey = r_regionkey"
_TEXT = "SELECT c_custkey, n_name, n_name || '::c' || c_custkey AS q FROM customer JOIN nation ON c_nationkey = n_nationkey"
_UP = "SELECT o_orderkey, o_orderpriority AS type, o_orderstatus AS st FROM orders"
SQL = {
    "gr10_list_sources": "SELECT 'region' AS source, 'NamespaceNode' AS node_type, count(*) AS count FROM region UNION ALL SELECT 'nation', 'ClassNode', count(*) FROM nation UNION ALL SELECT 'supplier', 'MethodNode', count(*) FROM supplier UNION ALL SELECT 'part', 'FunctionNode', count(*) FROM part",
    "gr13_find_class": "SELECT n_name AS name, r_name || '::' || n_name AS qualified_name, 'class' AS kind FROM nation JOIN region ON n_regionkey = r_regionkey WHERE contains(n_name, '1') OR contains(r_name || '::' || n_name, '1')",
    "gr14_find_function": "SELECT s_name AS name, s_name AS qualified_name, n_name AS class_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey WHERE contains(s_name, 'Supplier') UNION ALL SELECT p_name, p_brand || '::' || p_name, NULL FROM part WHERE contains(p_name, 'Supplier') OR contains(p_brand || '::' || p_name, 'Supplier')",
    "gr19_namespaces": "SELECT n_name AS name, r_name || '::' || n_name AS qualified_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'",
    "gr1_reachable": """WITH RECURSIVE e AS (SELECT conv_id || '-' || turn AS src, conv_id || '-' || (turn + 1) AS dst FROM conversations WHERE conv_id || '-' || (turn + 1) IN (SELECT conv_id || '-' || turn FROM conversations)),
 w AS (SELECT DISTINCT a.conv_id || '-0' AS root, dst AS node FROM conversations a JOIN e ON src = a.conv_id || '-' || a.turn WHERE a.turn = 0 UNION SELECT root, dst FROM w JOIN e ON src = node) SELECT root, node FROM w""",
    "sc16_prefixes": f"WITH u AS ({_Q}), p AS (SELECT string_split(q, '::') AS p FROM u), x AS (SELECT p, unnest(range(1, len(p))) AS i FROM p) SELECT array_to_string(p[1:i], '::') AS prefix, count(*) AS n FROM x GROUP BY 1",
    "jn5_either_name": "WITH t AS (SELECT p_brand AS tag FROM part UNION SELECT p_type FROM part) SELECT tag, count(DISTINCT p_partkey) AS n FROM t JOIN part ON p_brand = tag OR p_type = tag GROUP BY 1",
    "jn15_resolve": """WITH s AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
 k AS (SELECT c_custkey, b.n_nationkey, row_number() OVER (PARTITION BY c_custkey ORDER BY (b.r_name = 'ASIA') DESC, b.n_nationkey) AS rn, b.r_name = 'ASIA' AS near, count(*) OVER (PARTITION BY c_custkey) AS n
 FROM customer JOIN nation a ON c_nationkey = a.n_nationkey JOIN s b ON b.n_name = a.n_name) SELECT c_custkey::VARCHAR AS ref_id, n_nationkey::VARCHAR AS target FROM k WHERE rn = 1 AND (near OR n = 1)""",
    "ups_snapshots": f"WITH o AS ({_UP}) SELECT 'merged' AS what, type, count(*) AS n FROM o GROUP BY 2 UNION ALL SELECT 'deleted', type, count(*) FROM o WHERE st = 'F' GROUP BY 2",
    "jn21_descriptions": "SELECT d.doc_id::VARCHAR AS qualified_name, CASE WHEN lang = 'en' AND l.doc_id IS NOT NULL THEN 'quality ' || l.quality WHEN lang = 'en' THEN 'Setup block' ELSE source END AS description FROM documents d LEFT JOIN labels l USING (doc_id)",
    "ft1_search": r"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS w FROM documents),
 st AS (SELECT count(*) AS n, avg(len(w)) AS m FROM t), p AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM t), f AS (SELECT doc_id, dl, term, count(*) AS tf FROM p WHERE term IN ('stupid', 'clown') GROUP BY ALL),
 d AS (SELECT term, count(*) AS df FROM f GROUP BY 1), s AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / m))) AS score FROM f JOIN d USING (term), st GROUP BY 1)
 SELECT doc_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, doc_id LIMIT 20""",
    "gr18_statistics": """SELECT 'nodes' AS section, 'NamespaceNode' AS key, count(*) AS count FROM region UNION ALL SELECT 'nodes', 'ClassNode', count(*) FROM nation UNION ALL SELECT 'nodes', 'MethodNode', count(*) FROM supplier
 UNION ALL SELECT 'nodes', 'FunctionNode', count(*) FROM part UNION ALL SELECT 'relationships', 'COMPOSES', (SELECT count(*) FROM nation) + (SELECT count(*) FROM supplier) UNION ALL SELECT 'relationships', 'INHERITS_FROM', count(*) FROM nation WHERE n_nationkey > 0
 UNION ALL SELECT 'relationships', 'INVOKES', count(*) FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) UNION ALL SELECT 'compounds_by_kind', 'class', count(*) FROM nation
 UNION ALL SELECT 'members_by_kind', k, count(*) FROM (SELECT 'function' AS k FROM supplier UNION ALL SELECT p_type FROM part) GROUP BY k""",
    "gr7_compound": f"SELECT q AS qualified_name, s_name AS member_name FROM ({_NATION}) LEFT JOIN supplier ON s_nationkey = n_nationkey",
    "ag4_bases_and_derived": f"WITH n AS ({_NATION}) SELECT a.q AS qualified_name, coalesce((SELECT b.q FROM n b WHERE b.n_nationkey = a.n_nationkey // 2 AND a.n_nationkey > 0), '') AS bases, coalesce((SELECT string_agg(b.q, ',' ORDER BY b.q) FROM n b WHERE b.n_nationkey // 2 = a.n_nationkey AND b.n_nationkey > 0), '') AS derived FROM n a",
    "gr8_member": "SELECT 'o' || o_orderkey AS qualified_name, coalesce(string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey::VARCHAR), '') AS params FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem) ON l_orderkey = o_orderkey GROUP BY 1",
    "gr15_parameters": "SELECT 'o' || o_orderkey AS name, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey::VARCHAR) AS parts FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem) ON l_orderkey = o_orderkey GROUP BY 1",
    "gr3_callers": "SELECT DISTINCT s_name AS caller_name, n_name AS class_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey",
    "gr4_callees_of_class": "SELECT DISTINCT p_name AS callee_name, p_brand || '::' || p_name AS callee_qualified_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey WHERE n_name = 'NATION_7'",
    "gr6_calls_both_ways": """WITH c AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), p AS (SELECT p_brand || '::' || p_name AS q, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM c) ORDER BY q, p_name LIMIT 40),
 s AS (SELECT s_name AS q, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey IN (SELECT l_suppkey FROM c) ORDER BY q, n_name LIMIT 40) SELECT 'callee' AS direction, q AS qualified_name, NULL AS compound_name FROM p UNION ALL SELECT 'caller', q, n_name FROM s""",
    "gr5_inheritance": f"""WITH RECURSIVE n AS ({_NATION}), e AS (SELECT n_nationkey AS a, n_nationkey // 2 AS b FROM n WHERE n_nationkey > 0), w AS (SELECT a AS root, b AS node, 1 AS depth FROM e UNION ALL SELECT root, b, depth + 1 FROM w JOIN e ON node = a WHERE depth < 3)
 SELECT 'base' AS direction, q AS qualified_name, depth FROM w JOIN n ON node = n_nationkey UNION ALL SELECT 'derived', q, depth FROM w JOIN n ON root = n_nationkey""",
    "gr17_hierarchy": f"""WITH RECURSIVE n AS ({_NATION}), e AS (SELECT n_nationkey AS a, n_nationkey // 2 AS b FROM n WHERE n_nationkey > 0), w AS (SELECT a AS root, b AS node FROM e UNION SELECT root, b FROM w JOIN e ON node = a)
 SELECT a.q AS class, 'base' AS relation, b.q AS qualified_name FROM w JOIN n a ON root = a.n_nationkey JOIN n b ON node = b.n_nationkey UNION ALL SELECT b.q, 'derived', a.q FROM w JOIN n a ON root = a.n_nationkey JOIN n b ON node = b.n_nationkey""",
    "gr16_class_members": """SELECT n_name AS class, CASE s_suppkey % 4 WHEN 0 THEN 'methods' WHEN 1 THEN 'variables' ELSE 'typedefs' END AS category, string_agg(s_name, ',' ORDER BY s_name) AS members
 FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 4 < 3 AND s_suppkey % 3 > 0 GROUP BY 1, 2""",
    "gr9_browse": f"SELECT 'EUROPE' AS namespace, 'compound' AS node_type, n_name AS name, q AS qualified_name FROM ({_NATION}) WHERE r_name = 'EUROPE' ORDER BY n_name LIMIT 50",
    "tk5_browse_all": f"(SELECT r_name AS namespace, 'compound' AS node_type, q AS qualified_name FROM ({_NATION}) ORDER BY n_name, q LIMIT 12)",
    "gr2_paths": """WITH RECURSIVE e AS (SELECT n_nationkey AS src, n_nationkey * 2 % 25 AS dst FROM nation UNION SELECT n_nationkey, (n_nationkey * 2 + 1) % 25 FROM nation),
 w AS (SELECT src AS root, dst AS node, 1 AS depth, [src || '-' || dst] AS via FROM e UNION ALL SELECT root, dst, depth + 1, list_append(via, src || '-' || dst) FROM w JOIN e ON src = node WHERE depth < 5 AND NOT list_contains(via, src || '-' || dst)) SELECT root::VARCHAR AS root, node::VARCHAR AS node, depth FROM w""",
    "pf5_include_chain": "SELECT url AS path, len(list_distinct(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)))::INTEGER AS n_includes FROM pages WHERE ends_with(url, '.html')",
    "jn2_members_outer": "SELECT s_name AS qualified_name, n_name AS compound_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT p_brand || '::' || p_name, NULL FROM part",
    "pf7_predicates": "SELECT 'contains' AS rule, p_name AS name FROM part WHERE contains(p_name, 'g') OR contains(p_brand || '::' || p_name, 'g') UNION ALL SELECT 'equals', n_name FROM nation WHERE n_name = 'NATION_3' UNION ALL SELECT 'fuzzy', s_name FROM supplier WHERE contains(s_name, 'Supplier') UNION ALL SELECT 'fuzzy', p_name FROM part WHERE contains(p_brand || '::' || p_name, 'Supplier')",
    "sc1_args": "SELECT p_partkey, '(' || replace(p_type, ' ', '_') || ', const ' || replace(p_brand, '#', '_') || '*, unsigned) const' AS args FROM part",
    "sc20_uid": "SELECT p_partkey, sha256('part' || chr(1) || 'MethodNode' || chr(1) || p_name || chr(1) || '(int)') AS uid FROM part",
    "jn18_longest_prefix": f"""WITH u AS ({_Q}), k AS (SELECT page_id, CASE WHEN string_split(q, '::')[2] = 'en' AND string_split(q, '::')[1] || '::en' IN (SELECT string_split(q, '::')[1] || '::en' FROM u WHERE contains(q, '::en::')) THEN string_split(q, '::')[1] || '::en' ELSE string_split(q, '::')[1] END AS p FROM u)
 SELECT * FROM k UNION ALL SELECT * FROM k WHERE page_id % 5 = 0""",
    "jn19_within": "WITH g AS (SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS t0 FROM events), s AS (SELECT user_id, t0 // 86400 AS day, min(t0) AS a, max(t0) AS b FROM g GROUP BY 1, 2), k AS (SELECT event_id, a, b FROM g JOIN s ON g.user_id = s.user_id AND t0 BETWEEN a AND b) SELECT * FROM k UNION ALL SELECT * FROM k WHERE event_id % 7 = 0",
    "dv10_exact_references": f"""WITH c AS ({_TEXT}) SELECT a.c_custkey::VARCHAR AS src_uid, b.c_custkey::VARCHAR AS dst_uid FROM c a JOIN c b ON b.q = a.n_name || '::c' || ((a.c_custkey * 7 + 1) % 500) WHERE a.c_custkey % 2 = 0 AND a.c_custkey <> b.c_custkey AND NOT (a.c_custkey % 11 = 0 AND b.c_custkey = 0)""",
    "dv11_prefix_references": f"""WITH c AS ({_TEXT}) SELECT a.c_custkey::VARCHAR AS src_uid, b.c_custkey::VARCHAR AS dst_uid FROM c a JOIN c b ON b.q = a.n_name || '::c' || ((a.c_custkey * 7 + 1) % 500) WHERE a.c_custkey <> b.c_custkey AND NOT (a.c_custkey % 11 = 0 AND b.c_custkey = 0)""",
    "dv12_source_tags": """WITH p AS (SELECT page_id, CASE WHEN page_id % 3 > 0 THEN '/w/' || regexp_extract(url, '://([^?#]*)', 1) ELSE '' END AS f FROM pages),
 t AS (SELECT page_id::VARCHAR AS uid, CASE WHEN starts_with(f, '/w/thther.example.org/') THEN 'own' WHEN starts_with(f, '/w/blog.ththan.example.net/') THEN 'lib1' WHEN starts_with(f, '/w/www.ththhe.example.com/') THEN 'com' WHEN page_id % 4 = 1 THEN 'lib1' WHEN page_id % 4 = 3 THEN 'lib3' ELSE 'own' END AS source FROM p)
 SELECT uid, source, CASE WHEN source = 'own' THEN 'as-built' ELSE 'dependency' END AS tags FROM t""",
    "so5_split": "SELECT 'INVOKES' AS rel_type, count(*) AS n, count(DISTINCT l_suppkey) AS sources FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier))",
    "so4_stale": "SELECT doc_id::VARCHAR AS uid FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)",
    "ups4_refresh_rows": """WITH o AS (SELECT o_orderkey::VARCHAR AS uid, o_orderstatus AS type, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS source, o_custkey::BIGINT AS ord FROM orders)
 SELECT * FROM o WHERE source IS DISTINCT FROM 'even' UNION ALL SELECT uid, type, source, ord + 1 FROM o WHERE source = 'even' AND type <> 'O'""",
    "dv1_composition": f"""WITH u AS ({_Q}), s AS (SELECT DISTINCT string_split(q, '::') AS x FROM u), p AS (SELECT DISTINCT array_to_string(x[1:i], '::') AS q, i FROM (SELECT x, unnest(range(1, len(x))) AS i FROM s)),
 k AS (SELECT 'NamespaceNode|' || q AS uid, array_to_string(string_split(q, '::')[1:-2], '::') AS parent FROM p UNION ALL SELECT 'ClassNode|' || array_to_string(x, '::'), array_to_string(x[1:-2], '::') FROM s)
 SELECT 'NamespaceNode|' || parent AS src_uid, uid AS dst_uid FROM k WHERE parent <> '' AND parent IN (SELECT q FROM p)""",
    "jn13_concepts": f"""WITH n AS ({_NATION}) SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN a.q WHEN a.r_name = 'ASIA' THEN a.q END AS concept FROM customer JOIN n a ON c_nationkey = a.n_nationkey""",
    "snk13_sources": "SELECT (doc_id % 100)::VARCHAR AS refid, string_agg(DISTINCT source, ',' ORDER BY source) AS source FROM documents GROUP BY 1",
    "pf19_neighbourhood": """SELECT 'ClassNode' AS what, count(*) AS n FROM nation UNION ALL SELECT 'NamespaceNode', count(DISTINCT n_regionkey) FROM nation UNION ALL SELECT 'MethodNode', count(*) FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation)
 UNION ALL SELECT 'COMPOSES', (SELECT count(*) FROM nation) + (SELECT count(*) FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation)) UNION ALL SELECT 'INHERITS_FROM', count(*) FROM nation WHERE n_nationkey > 0""",
}
