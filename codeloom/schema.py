"""The two tables of a code graph, and what the engine knows of their vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = """uid string, type string, source string, layer string, tags array<string>, refid string, name string, qualified_name string,
 kind string, file_path string, language string, line_number int, body_start int, body_end int, brief_description string,
 detailed_description string, definition string, argsstring string, type_signature string, protection string, module string,
 base_classes array<string>, is_static boolean, is_const boolean, is_constexpr boolean, is_virtual boolean, is_final boolean,
 is_abstract boolean, member_refid string, position int, default_value string, description string, compound_refid string, source_type string,
 is_inline boolean, is_explicit boolean, initializer string, implementation string, impl_embedding array<float>, value string,
 value_type string, test_name string, test_module string, phase string, operator string, ord long"""
EDGES = "src_uid string, dst_uid string, dst_name string, rel_type string, source string, included_file string, is_local boolean, position int"
COMPOUNDS = ("ClassNode", "InterfaceNode", "EnumNode", "UnionNode", "ConceptNode")
MEMBERS = ("MethodNode", "AttributeNode", "EnumValueNode", "DefineNode", "FunctionNode")
ALIASES = {"CONTAINS": "COMPOSES", "CALLS": "INVOKES"}


def columns(ddl: str) -> list[tuple[str, str]]:
    return [tuple(c.split(maxsplit=1)) for c in ddl.replace("\n", " ").split(", ")]


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """``df`` with exactly the columns of ``ddl``; absent ones are null."""
    return df.select(*((F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in columns(ddl)))


def empty(spark: SparkSession, ddl: str) -> DataFrame:
    return spark.createDataFrame([], ddl)


def uid(*identity):
    """Deterministic id of a node within its source, of columns or their names.

    Overloads differ by their arguments' types; callers pass those normalised (`names.normal_args`,
    `names.python_args`), so that parameter names and defaults have no part in it.
    """
    parts = [F.col(c) if isinstance(c, str) else c for c in ("source", "type", *identity)]
    return F.sha2(F.concat_ws("\u0001", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)
