import pytest
from pyspark.sql import functions as F

from codeloom.sources import doxygen_xml
from codeloom.tools import GraphTools

DUMP = {
    "index": "<doxygenindex><compound refid='c_shape' kind='class'><name>geo::Shape</name></compound><compound refid='c_disc' kind='struct'/><compound refid='ns' kind='namespace'/><compound refid='f_h' kind='file'/><compound refid='f_x' kind='file'/><compound refid='k' kind='concept'/><compound refid='v' kind='class'/><compound refid='vi' kind='class'/><compound refid='gone' kind='class'/><compound refid='bad' kind='class'/><compound refid='odd' kind='group'/><compound refid='e' kind='enum'/></doxygenindex>",
    "ns": "<doxygen><compounddef id='ns' kind='namespace'><compoundname>geo</compoundname></compounddef></doxygen>",
    "k": "<doxygen><compounddef id='k' kind='concept'><compoundname>geo::Area</compoundname><initializer>template&lt;T&gt; <ref refid='z'>requires</ref> x</initializer></compounddef></doxygen>",
    "c_shape": """<doxygen><compounddef id='c_shape' kind='class' abstract='yes'><compoundname>geo::Shape</compoundname><briefdescription><para>A <bold>plane</bold>  shape.</para></briefdescription><location file='geo.h' line='4'/>
 <sectiondef><memberdef id='m_area' kind='function' prot='public' const='yes' virt='pure-virtual'><type>double</type><definition>double geo::Shape::area</definition><argsstring>(int n, const char* unit) const</argsstring><name>area</name><param><type>int</type><declname>n</declname><defval>1</defval></param><param><type>const char*</type><declname>unit</declname></param><location file='geo.h' line='6' bodystart='2' bodyend='3'/><references refid='m_scale'>scale</references></memberdef>
 <memberdef id='m_scale' kind='function' prot='private' static='yes'><type>void</type><argsstring>(void)</argsstring><name>scale</name><location file='geo.h' line='7' bodystart='-1' bodyend='-1'/><referencedby refid='m_area'>area</referencedby></memberdef>
 <memberdef id='m_next' kind='variable' prot='protected'><type><ref refid='c_disc' kindref='compound'>Disc</ref> *</type><name>next</name><location file='geo.h' line='8'/></memberdef>
 <memberdef id='m_sig' kind='signal'><name>sig</name></memberdef></sectiondef></compounddef></doxygen>""",
    "c_disc": "<doxygen><compounddef id='c_disc' kind='struct' final='yes'><compoundname>geo::Disc</compoundname><basecompoundref refid='c_shape'>geo::Shape</basecompoundref><basecompoundref>geo::Vec</basecompoundref><basecompoundref>other::Gone</basecompoundref><location file='geo.h' line='20'/></compounddef></doxygen>",
    "v": "<doxygen><compounddef id='v' kind='class'><compoundname>geo::Vec</compoundname><templateparamlist><param><type>Area</type><declname>A</declname><defval>Disc</defval></param><param><type>typename Area</type></param></templateparamlist></compounddef></doxygen>",
    "vi": "<doxygen><compounddef id='vi' kind='class'><compoundname>geo::Vec&lt; std::vector&lt;int&gt; &gt;</compoundname></compounddef></doxygen>",
    "f_h": "<doxygen><compounddef id='f_h' kind='file' language='C++'><compoundname>geo.h</compoundname><includes refid='f_x' local='yes'>x.h</includes><includes>vector</includes><sectiondef><memberdef id='g' kind='function'><type>int</type><name>free_fn</name><argsstring>(long k)</argsstring><location file='geo.h' line='30' bodystart='4' bodyend='4'/></memberdef><memberdef id='t' kind='typedef'><name>Alias</name></memberdef><memberdef id='d' kind='define'><name>MAX</name></memberdef></sectiondef><location file='geo.h'/></compounddef></doxygen>",
    "f_x": "<doxygen><compounddef id='f_x' kind='file'><compoundname>x.h</compoundname><location file='x.h'/></compounddef></doxygen>",
    "e": "<doxygen><compounddef id='e' kind='enum'><compoundname>geo::Kind</compoundname><sectiondef><memberdef id='ev' kind='enumvalue'><name>ROUND</name></memberdef><memberdef id='df' kind='define'><name>LIMIT</name><location file='geo.h' line='1' bodystart='1' bodyend='1'/></memberdef></sectiondef></compounddef></doxygen>",
    "bad": "<doxygen><compounddef id='bad'",
    "odd": "<doxygen><compounddef id='odd' kind='group'><compoundname>grp</compoundname></compounddef></doxygen>",
    "unlisted": "<doxygen><compounddef id='u' kind='class'><compoundname>Unlisted</compoundname></compounddef></doxygen>",
}


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    dump, src = tmp_path_factory.mktemp("xml"), tmp_path_factory.mktemp("cpp")
    for name, text in DUMP.items():
        (dump / f"{name}.xml").write_text(text)
    (src / "geo.h").write_text("#define LIMIT 3\nreturn 1\n  + 2;\nint free_fn(long k) { return k; }\n")
    nodes, edges = doxygen_xml.read(spark, str(dump), "geo", implementations=str(src))
    return nodes.cache(), edges.cache()


def pairs(graph, kind):
    nodes, edges = graph
    n = nodes.select("uid", F.coalesce("qualified_name", "name").alias("q"))
    e = edges.where(F.col("rel_type") == kind).join(n.toDF("src_uid", "a"), "src_uid").join(n.toDF("dst_uid", "b"), "dst_uid")
    return {(r.a, r.b) for r in e.collect()}


def test_nodes(graph):
    got = {(r.type, r.qualified_name) for r in graph[0].collect() if r.type not in ("ParameterNode", "FileNode", "ImplementationNode")}
    assert got == {
        ("NamespaceNode", "geo"), ("ClassNode", "geo::Shape"), ("ClassNode", "geo::Disc"), ("ClassNode", "geo::Vec"), ("ClassNode", "geo::Vec< std::vector<int> >"), ("ConceptNode", "geo::Area"), ("EnumNode", "geo::Kind"), ("EnumValueNode", "geo::Kind::ROUND"), ("DefineNode", "LIMIT"),
        ("MethodNode", "geo::Shape::area(int, const char*) const"), ("MethodNode", "geo::Shape::scale()"), ("AttributeNode", "geo::Shape::next"), ("FunctionNode", "free_fn"), ("AttributeNode", "Alias"), ("ClassNode", "type_param:geo::Vec:0"), ("ClassNode", "type_param:geo::Vec:1"),
    }
    area = graph[0].where("name = 'area'").first()
    assert area.is_const and area.is_virtual and not area.is_static and (area.body_start, area.body_end, area.line_number) == (2, 3, 6) and area.type_signature == "double"
    assert graph[0].where("name = 'scale'").first().body_start == 0
    shape = graph[0].where("name = 'Shape'").first()
    assert shape.brief_description == "A plane shape." and shape.is_abstract and shape.source_type == "header" and shape.module == "geo" and shape.tags == ["dependency"]
    assert graph[0].where("name = 'Area'").first().initializer == "template<T> requires x"
    t = graph[0].where("kind = 'type_parameter'").orderBy("qualified_name").collect()
    assert [(r.name, r.definition) for r in t] == [("A", "position=0 defval=Disc"), ("T", "position=1")]
    assert graph[0].count() == graph[0].select("uid").distinct().count()


def test_edges(graph):
    assert pairs(graph, "INHERITS_FROM") == {("geo::Disc", "geo::Shape"), ("geo::Disc", "geo::Vec")}
    assert pairs(graph, "INVOKES") == {("geo::Shape::area(int, const char*) const", "geo::Shape::scale()")}
    assert pairs(graph, "DEPENDS_ON") == {("geo::Shape::next", "geo::Disc")}
    assert pairs(graph, "SPECIALIZES") == {("geo::Vec< std::vector<int> >", "geo::Vec")}
    assert pairs(graph, "TEMPLATE_PARAM") == {("geo::Vec", "type_param:geo::Vec:0"), ("geo::Vec", "type_param:geo::Vec:1")}
    assert pairs(graph, "ENFORCES_CONCEPT") == {("type_param:geo::Vec:0", "geo::Area")}
    assert {("geo", "geo::Shape"), ("geo", "geo::Disc"), ("geo", "geo::Area"), ("geo", "geo::Kind"), ("geo::Shape", "geo::Shape::next"), ("geo::Kind", "geo::Kind::ROUND")} <= pairs(graph, "COMPOSES")
    assert ("geo::Shape", "geo.h") in pairs(graph, "DEFINED_IN") and pairs(graph, "INCLUDES") == {("geo.h", "x.h")}
    includes = {(r.included_file, r.is_local, r.dst_uid is None) for r in graph[1].where("rel_type = 'INCLUDES'").collect()}
    assert includes == {("x.h", True, False), ("vector", False, True)}
    assert graph[1].where("rel_type = 'HAS_PARAMETER'").count() == 2


def test_implementations(graph):
    got = {r.qualified_name: r.implementation for r in graph[0].where("type = 'ImplementationNode'").collect()}
    assert got == {"geo::Shape::area(int, const char*) const": "return 1\n  + 2;", "free_fn": "int free_fn(long k) { return k; }", "LIMIT": "#define LIMIT 3"}
    assert graph[1].where("rel_type = 'HAS_IMPLEMENTATION'").count() == 3


def test_tools_read_it(graph):
    t = GraphTools(*graph)
    assert [p.name for p in t.get_function_parameters("area").first().parameters] == ["n", "unit"]
    assert {r.qualified_name for r in t.get_class_hierarchy("geo::Shape").where("relation = 'derived'").collect()} == {"geo::Disc"}


def test_two_forms_of_argument_types(spark):
    from codeloom.functions import names

    args = ["(int x, const char* s = 0) const", "(void)", "()", "", "(T &&... t)", "(std::map<int, long> m, unsigned long)", "(void (*f)(int), int k=f(2))"]
    got = spark.createDataFrame([(a,) for a in args], "a string").select(names.normal_args(F.col("a")).alias("n")).collect()
    assert [r.n for r in got] == [doxygen_xml.plain_args(a) for a in args]


def test_index_is_needed(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        doxygen_xml.read(spark, str(tmp_path), "x")
    (tmp_path / "index.xml").write_text("<doxygenindex><compound")
    (tmp_path / "c.xml").write_text("<doxygen/>")
    nodes, edges = doxygen_xml.read(spark, str(tmp_path), "x")
    assert nodes.count() == 0 and edges.count() == 0
