"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import decontam, html_text, line_dedup, mixing, simhash, token_count, token_output, toxicity, url_filter, vector_search


#: A search takes as queries every row whose id this divides, against all rows.
QUERY_EVERY = 100


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _read(spark, sf_dir, "labels")))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(_read(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(_read(spark, sf_dir, "documents"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_read(spark, sf_dir, "pages"))


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.encode(_read(spark, sf_dir, "documents"))


def op7_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.neighbours(_read(spark, sf_dir, "embeddings"), queries=F.col("vec_id") % QUERY_EVERY == 0)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_boilerplate(_read(spark, sf_dir, "pages"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.blocks(_read(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.score(_read(spark, sf_dir, "pages"))


QUERIES = {
    f.__name__: f
    for f in (op1_toxicity, op2_token_counts, op3_decontamination, op4_simhash, op5_html, op6_token_output, op7_vector_search, op8_line_dedup, op9_mixing, op10_url_filter)
}

_LINES = rf"""
cut AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)) AS host,
         list_filter(list_transform(string_split(regexp_replace(regexp_replace(
           regexp_replace(regexp_replace(coalesce(html, ''), '{line_dedup.DROP}', ' ', 'g'), '[\n\r]', ' ', 'g'),
           '{line_dedup.BREAK}', chr(10), 'g'), '{line_dedup.TAG}', '', 'g'), chr(10)), lambda x: trim(x, ' ' || chr(9))), lambda x: x <> '') AS lines
  FROM pages)
"""

SQL = {
    "op7_vector_search": f"""
WITH v AS (SELECT vec_id, min(embedding::DOUBLE[]) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND NOT list_has_any(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x)), [true])
           GROUP BY vec_id),
u AS (SELECT * FROM v WHERE len(e) = (SELECT len(e) FROM v GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)),
p AS (SELECT a.vec_id, b.vec_id AS neighbour_id, list_distance(a.e, b.e) AS dist FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE a.vec_id % {QUERY_EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, neighbour_id) AS n FROM p)
SELECT vec_id, n::INTEGER AS rank, neighbour_id, round(dist, 6) AS distance FROM r WHERE n <= {vector_search.K}""",
    "op8_line_dedup": f"""
WITH {_LINES},
totals AS (SELECT host, count(*) AS total FROM cut GROUP BY host),
often AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM cut) GROUP BY host, line HAVING count(*) >= {line_dedup.LEAST_HOLDING}),
bad AS (SELECT host, list(line) AS bad FROM often JOIN totals USING (host) WHERE n > total * {line_dedup.RATIO} GROUP BY host),
kept AS (SELECT page_id, cut.host, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(bad, []), x)) AS kept FROM cut LEFT JOIN bad USING (host))
SELECT page_id, host, coalesce(array_to_string(kept, chr(10)), '') AS text, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_dropped FROM kept""",
}
