import pytest
from pyspark.sql import functions as F

from codeloom.sources import reference_pages as P


def page(title, body):
    return f"<html><head><title>{title} - site.com</title></head><body><h1>{title}</h1>{body}</body></html>"


DCL = '<table class="t-dcl-begin">{}</table>'
ROW = '<tr class="t-dcl {}"><td>{}</td><td>(1)</td></tr>'
DSC = '<table class="t-dsc-begin">{}</table>'
ITEM = '<tr class="t-dsc"><td><a href="{}">{}</a></td><td>{}</td></tr>'
FILES = {
    "container/vector.html": page("std::vector", "<p>A sequence.</p><p>Grows <b>by itself</b>.</p>" + DSC.format(ITEM.format("vector/push_back.html", "push_back", "adds an element") + ITEM.format("vector/size.html", "size", "counts") + '<tr class="t-dsc"><td>(destructor)</td><td>ends it</td></tr>')),
    "container/vector/push_back.html": page("std::vector<T>::push_back", DCL.format(ROW.format("t-since-cxx11", "void push_back( const T&amp; value );") + ROW.format("", "void push_back( T&amp;&amp; value, int n = 3 );"))),
    "container/vector/helper.html": page("std::vector::helper", DCL.format('<tr class="t-dcl"><td><span class="kw1">struct</span> helper;</td></tr>')),
    "algorithm/sort.html": page("std::sort", "<p>Sorts.</p>" + DCL.format(ROW.format("", "template&lt; class It &gt; void sort( It first, It last );")) + '<table class="t-par-begin"><tr class="t-par"><td>first</td><td>-</td><td>begin</td></tr></table>'),
    "error/failure.html": page("std::failure", '<div class="t-inheritance-diagram"><map><area title="cpp/error/exception"></map></div>'), "error/failure/what.html": page("std::failure::what", ""),
    "error/exception.html": page("std::exception", ""), "error/exception/what.html": page("what", DCL.format(ROW.format("", "virtual const char* what() const noexcept;"))),
    "header/vector.html": page("Standard library header", DSC.format(ITEM.format("../container/vector.html", "vector", "") + ITEM.format("../algorithm/sort.html", "sort", ""))),
    "language/skip.html": page("x", ""), "index.html": page("x", ""), "meta.html": page("x", ""), "container/index.html": page("x", ""),
}


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("pages")
    for name, text in FILES.items():
        (root / "en/cpp" / name).parent.mkdir(parents=True, exist_ok=True)
        (root / "en/cpp" / name).write_text(text)
    nodes, edges = P.read(spark, str(root))
    kinds = {r.relative: r.page_type for r in P.classify(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(root)).select(F.regexp_extract("path", "(en/cpp/.*)$", 1).alias("relative"), "content"), "stdlib:").collect()}
    return nodes.cache(), edges.cache(), kinds


def test_pages_are_classed_by_path(graph):
    assert {k.removeprefix("en/cpp/"): v for k, v in graph[2].items()} == {
        "container/vector.html": "CLASS", "container/vector/push_back.html": "MEMBER", "container/vector/helper.html": "CLASS", "algorithm/sort.html": "FREE_FUNCTION", "error/failure.html": "CLASS",
        "error/failure/what.html": "MEMBER", "error/exception.html": "CLASS", "error/exception/what.html": "MEMBER", "header/vector.html": "HEADER",
    }


def test_nodes(graph):
    got = {r.qualified_name: r for r in graph[0].where("type not in ('ParameterNode', 'FileNode')").collect()}
    assert set(got) == {"std", "std::vector", "std::vector::helper", "std::vector::push_back(const T&)", "std::vector::push_back(T&&, int)", "std::vector::size", "std::vector::destructor", "::sort(It, It)", "std::failure", "std::failure::what", "std::exception", "std::exception::what()"}
    v = got["std::vector"]
    assert (v.brief_description, v.detailed_description, v.file_path) == ("A sequence.", "Grows by itself .", "en/cpp/header/vector.html")
    assert got["std::vector::push_back(const T&)"].brief_description == "adds an element" and got["::sort(It, It)"].file_path == "en/cpp/header/vector.html"
    p = graph[0].where("type = 'ParameterNode' and name = 'n'").first()
    assert (p.position, p.type_signature, p.default_value) == (1, "int", "3")


def test_edges(graph):
    nodes, edges, _ = graph
    n = nodes.select("uid", F.coalesce("qualified_name", "name").alias("q"))
    e = edges.join(n.toDF("src_uid", "a"), "src_uid").join(n.toDF("dst_uid", "b"), "dst_uid")
    got = {(r.rel_type, r.a, r.b) for r in e.collect()}
    assert {("INHERITS_FROM", "std::failure", "std::exception"), ("COMPOSES", "std", "std::vector"), ("COMPOSES", "std::vector", "std::vector::size"), ("COMPOSES", "std::vector", "std::vector::push_back(T&&, int)"), ("DEFINED_IN", "std::vector", "<vector>"), ("DEFINED_IN", "::sort(It, It)", "<vector>")} <= got


def test_signatures_and_markers():
    assert P.signature("template< class T > const T& max( const T& a, const std::map<int, T>& b = {} ) (since C++14)") == ("const T&", "max", "( const T& a, const std::map<int, T>& b = {} )", [("const T&", "a", ""), ("const std::map<int, T>&", "b", "{}")])
    assert P.signature("void f(void);") == ("void", "f", "(void)", []) and P.signature("using value_type = T;") == ("", "", "", [])
    assert P.declarations(P.tree(DCL.format(ROW.format("t-since-cxx11 t-until-cxx20", "int f();")))) == [("int f();", "C++11", "C++20")]
    assert P.qualified("path", "en/cpp/filesystem/path.html") == "std::filesystem::path" and P.qualified("a :: b", "en/cpp/io/b.html") == "a::b"
