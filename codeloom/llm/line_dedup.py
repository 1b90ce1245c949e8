"""Site-relative line dedup: lines that too large a share of a host's pages hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm import _store

RATIO = 0.05
#: Pages of a host that must hold a line before it can go: two may share one by chance.
LEAST_HOLDING = 3
#: Pages of one host that a task gets at most.
HOT = 2_000
#: What ends a line in HTML, once scripts, styles and comments are gone.
DROP = r"(?is)<script.*?(?:</script>|\z)|<style.*?(?:</style>|\z)|<!--.*?(?:-->|\z)"
BREAK = r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)(?:\s[^>]*)?/?>"
TAG = r"<[^>]*>"


def host_of(url: Column) -> Column:
    """Lower-case host without port; '' where the URL is null or has none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1))


def html_lines(html: Column) -> Column:
    """Trimmed, non-empty text lines of a page."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), DROP, " "), r"[\n\r]", " ")
    lines = F.split(F.regexp_replace(F.regexp_replace(text, BREAK, "\n"), TAG, ""), "\n", -1)
    return F.filter(F.transform(lines, lambda x: F.btrim(x, F.lit(" \t"))), lambda x: x != "")


def drop_boilerplate(pages: DataFrame, ratio: float = RATIO, least_holding: int = LEAST_HOLDING, hot: int = HOT) -> DataFrame:
    """(page_id, host, text, n_lines, n_dropped) of each row of (page_id, url, html).

    A line goes when more than ``ratio`` of its host's pages hold it and at least
    ``least_holding`` do, whatever the number of the host's pages; a line at the ratio stays.  A line repeated within a
    page counts once for that page, and all its occurrences go or stay.  Null or
    host-less URLs share the host ''.  Null and empty pages give an empty text
    and count as pages of their host; a script, style or comment that isn't
    closed goes on to the page's end and is no text.  Repeated rows count as pages each; an empty
    table gives none; other columns are not looked at.

    Pages meet their host's list of lines by a join.  A host of over ``hot``
    pages is divided by a hash of the page, and its list is copied to each part, so no
    task gets more pages of one host than that.
    """
    cut = pages.select("page_id", host_of(F.col("url")).alias("host"), html_lines(F.col("html")).alias("lines"))
    cut = _store.materialize(cut, "page-lines")
    totals = cut.groupBy("host").agg(F.count("*").alias("total"))
    each = cut.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: F.xxhash64(x)))).alias("line"))
    often = each.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= least_holding)
    # at most (lines a page / ratio) lines of a host can pass, so this list is short
    bad = often.join(totals, "host").where(F.col("n") > F.col("total") * ratio).groupBy("host").agg(F.collect_set("line").alias("bad"))
    # hosts of over `hot` pages: at most (all pages / hot) rows
    large = F.broadcast(totals.where(F.col("total") > hot).select("host", F.ceil(F.col("total") / hot).cast("int").alias("parts")))
    part = F.coalesce(F.pmod(F.xxhash64("page_id", "lines"), F.col("parts")), F.lit(0)).cast("int")
    split = cut.join(large, "host", "left").withColumn("part", part).drop("parts")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
    bad = bad.join(large, "host", "left").select("host", "bad", copies.alias("part"))
    joined = split.join(bad, ["host", "part"], "left")
    kept = F.filter("lines", lambda x: ~F.array_contains(F.coalesce("bad", F.array().cast("array<bigint>")), F.xxhash64(x)))
    out = joined.select("page_id", "host", kept.alias("kept"), F.size("lines").alias("n_lines"))
    return out.select("page_id", "host", F.array_join("kept", "\n").alias("text"), F.col("n_lines").cast("long").alias("n_lines"), (F.col("n_lines") - F.size("kept")).cast("long").alias("n_dropped"))
