"""Column functions on symbol names, signatures and paths.  All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parent_name(qn: Column, sep: str = "::") -> Column:
    """What stands before the last separator; '' without one."""
    cut = F.length(qn) - F.length(F.substring_index(qn, sep, -1)) - len(sep)
    return F.when(F.instr(qn, sep) > 0, F.substring(qn, F.lit(1), cut)).otherwise("")


def short_name(qn: Column, sep: str = "::") -> Column:
    return F.substring_index(qn, sep, -1)


def prefixes(qn: Column, sep: str = "::") -> Column:
    """All proper prefixes that end before a separator, arguments cut off first."""
    parts = F.split(F.substring_index(qn, "(", 1), sep.replace(".", r"\."))
    some = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), sep))
    return F.when(F.size(parts) > 1, some).otherwise(F.array().cast("array<string>"))


def normal_args(args: Column) -> Column:
    """Types of an argument list: ``(int x, const char* s = 0) const`` is ``(int, const char*) const``.

    A default goes with all that follows '='; a last word that is a plain name goes where a type stands before it.
    """
    text = F.trim(F.coalesce(args, F.lit("")))
    body, after = F.regexp_extract(text, r"^\(?(.*?)(?:\)([^()]*))?$", 1), F.trim(F.regexp_extract(text, r"\)([^()]*)$", 1))

    def bare(a: Column) -> Column:
        words = F.split(F.trim(F.substring_index(a, "=", 1)), r"\s+")
        named = (F.size(words) > 1) & F.element_at(words, -1).rlike(r"^[A-Za-z_]\w*$")
        return F.array_join(F.when(named, F.slice(words, F.lit(1), F.size(words) - 1)).otherwise(words), " ")

    types = F.when(F.trim(body).isin("", "void"), "").otherwise(F.array_join(F.transform(F.split(body, ","), bare), ", "))
    return F.concat(F.lit("("), types, F.lit(")"), F.when(after != "", F.concat(F.lit(" "), after)).otherwise(""))


def python_args(args: Column) -> Column:
    """Annotations of a Python argument list in order, ``_`` where there is none; stars stay, names and defaults go."""
    inner = F.regexp_replace(F.trim(F.coalesce(args, F.lit(""))), r"^\(|\)$", "")
    # commas within brackets or quotes belong to their argument
    flat = F.regexp_replace(inner, r"\[[^\[\]]*\]", "[]")
    flat = F.regexp_replace(F.regexp_replace(flat, r"\([^()]*\)|\{[^{}]*\}|'[^']*'|\"[^\"]*\"", ""), r"\[[^\[\]]*\]", "[]")

    def kind(a: Column) -> Column:
        own = F.trim(F.substring_index(a, "=", 1))
        star = F.regexp_extract(own, r"^(\**)", 1)
        return F.when(own.isin("*", "/"), own).otherwise(F.concat(star, F.when(F.instr(own, ":") > 0, F.trim(F.regexp_extract(own, r":(.*)$", 1))).otherwise("_")))

    each = F.filter(F.split(flat, ","), lambda a: F.trim(a) != "")
    return F.concat(F.lit("("), F.array_join(F.transform(each, kind), ", "), F.lit(")"))


def source_type(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z+]+)$", 1))
    return F.when(ext.isin("h", "hh", "hpp", "hxx", "h++"), "header").when(ext.isin("c", "cc", "cpp", "cxx", "c++"), "source").otherwise("")


def without_generics(name: Column) -> Column:
    return F.trim(F.regexp_extract(name, r"^([^\[<]*)", 1))


def primary_template(name: Column) -> Column:
    """``Foo`` of ``Foo<Bar>``; null for other names."""
    return F.when(name.rlike(r"^[^<]+<.*>$"), F.rtrim(F.regexp_extract(name, r"^([^<]+)<", 1)))


def is_private(name: Column) -> Column:
    return name.rlike(r"^_([^_]|$)")


def flat_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def present_line(n: Column) -> Column:
    """-1 stands for an absent line."""
    return F.when(n != -1, n.cast("int"))


def module_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"(/__init__)?\.py$", ""), "/", ".")


def is_placeholder(text: Column, strict: bool = True) -> Column:
    """Descriptions that no one wrote: empty, or the parser's own words."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return (t == "") | t.rlike(r"^Setup block$|^Action block \d+$|^assert .+$" if strict else r"(?i)^assert\s|^setup block$|^action block\s")


def json_list(items: Column) -> Column:
    return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, F.to_json(items)).otherwise("")


def implementation(text: Column, start: Column, end: Column) -> Column:
    """Lines start to end of a source text; null where the bounds don't hold or all is blank."""
    lines = F.split(text, "\n", -1)
    own = F.array_join(F.slice(lines, start, end - start + 1), "\n")
    return F.when((start > 0) & (end >= start) & (end <= F.size(lines)), F.when(F.trim(own) != "", own))
