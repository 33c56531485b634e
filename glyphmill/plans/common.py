"""Tables and SQL fragments that the queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.operators import dictionary as D


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.derive(docs(spark, sf_dir))


def misspellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lang, query``: every word that stands in a single document of its language."""
    counts = D.document_counts(docs(spark, sf_dir))
    return counts.where("docs = 1").select("lang", F.col("word").alias("query"))


CHECKER_SQL = "'[A-Za-z'']+'"
WS_SQL = r"'[A-Za-z0-9_'']+|[^A-Za-z0-9_''\s]'"

#: tok(doc_id, lang, word), counts(lang, word, docs), dict(lang, word), miss(lang, query)
BASE = f"""
tok AS (SELECT doc_id, lang, lower(unnest(regexp_extract_all(coalesce(text, ''), {CHECKER_SQL}))) AS word FROM documents),
counts AS (SELECT lang, word, count(DISTINCT doc_id) AS docs FROM tok GROUP BY lang, word),
dict AS (SELECT lang, word FROM counts WHERE docs >= 3),
miss AS (SELECT lang, word AS query FROM counts WHERE docs = 1),
dw AS (SELECT doc_id, lang, word, count(*) AS n FROM tok GROUP BY doc_id, lang, word),
errs AS (SELECT doc_id, lang, word, n FROM dw ANTI JOIN dict USING (lang, word))
"""

#: ws(doc_id, i, token, pos): whitespace tokens with their places.
WS = f"""
wt AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WS_SQL}) AS t,
              string_split_regex(coalesce(text, ''), {WS_SQL}) AS g FROM documents),
wu AS (SELECT doc_id, unnest(t) AS token, unnest(g[1:len(t)]) AS gap, unnest(range(len(t))) AS i FROM wt),
ws AS (SELECT doc_id, i, token,
              CAST(sum(length(gap)) OVER w + coalesce(sum(length(token)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos
       FROM wu WINDOW w AS (PARTITION BY doc_id ORDER BY i))
"""
