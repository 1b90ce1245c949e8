"""Ranked full text: postings and BM25 as DataFrames; AND, OR, phrases and fuzzy terms."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(term, key, tf, doc_len) for each distinct term of each row; terms are lower-case letters and digits."""
    terms = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda t: t != "")
    own = docs.select(key, terms.alias("_t"))
    return own.select(key, F.size("_t").alias("doc_len"), F.explode("_t").alias("term")).groupBy("term", key, "doc_len").agg(F.count("*").alias("tf"))


def bm25(posts: DataFrame, key: str, terms: list[str] | Column, n_docs: int, mean_len: float) -> DataFrame:
    """(key, score, n_terms).  The term filter comes first, so only matching postings are joined."""
    own = posts.where(terms if isinstance(terms, Column) else F.col("term").isin(terms))
    df = own.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.lit(mean_len)))
    return own.join(df, "term").groupBy(key).agg(F.sum(part).alias("score"), F.count("*").alias("n_terms"))


def search(docs: DataFrame, key: str, text: str, query: str, limit: int = 20) -> DataFrame:
    """(key, score) of the best rows.

    Terms may match any unless AND joins them all, each by any term that it matches; "a phrase" must occur; a~ or
    a~2 matches terms within that edit distance.
    """
    phrases = re.findall(r'"([^"]+)"', query)
    words = [w for w in re.sub(r'"[^"]+"', " ", query).split() if w not in ("AND", "OR")]
    fuzzy = {m[0].lower(): int(m[1] or 2) for w in words if (m := re.match(r"(\w+)~(\d?)$", w) and re.match(r"(\w+)~(\d?)$", w).groups())}
    plain = [w.lower() for w in words if "~" not in w] + [w for p in phrases for w in re.findall(r"\w+", p.lower())]
    posts = postings(docs, key, text)
    stats = docs.select(F.size(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda t: t != "")).alias("n")).agg(F.count("*").alias("c"), F.avg("n").alias("m")).first()
    each = [F.col("term") == w for w in sorted(set(plain))] + [F.levenshtein("term", F.lit(t), k) >= 0 for t, k in fuzzy.items()]
    found = bm25(posts, key, reduce(lambda a, b: a | b, each, F.lit(False)), stats.c, stats.m or 1.0)
    if re.search(r"\bAND\b", query):
        for one in each:
            found = found.join(posts.where(one).select(key), key, "left_semi")
    for p in phrases:
        found = found.join(docs.where(F.lower(text).contains(p.lower())).select(key), key, "left_semi")
    return found.select(key, "score").orderBy(F.desc("score"), key).limit(limit)
