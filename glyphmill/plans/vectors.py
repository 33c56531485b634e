"""Vector measures and neighbours over the embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.operators import vectors as V
from glyphmill.plans.common import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


_NEXT = "n AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"


def _adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y"))
    return e.select("vec_id", F.col("embedding").alias("x")).join(other, "vec_id")


for _name, _fn, _sql in (("vec_cosine", V.cosine, "list_cosine_similarity(x, y)"), ("vec_euclidean", V.euclidean, "list_distance(x, y)"),
                         ("vec_manhattan", V.manhattan, "list_sum(list_transform(list_zip(x, y), lambda p: abs(p[1] - p[2])))"), ("vec_dot", V.dot, "list_dot_product(x, y)")):
    QUERIES[_name] = lambda spark, sf_dir, fn=_fn: _adjacent(spark, sf_dir).select("vec_id", F.round(fn(F.col("x"), F.col("y")), 6).alias("value"))
    ORACLE_SQL[_name] = f"WITH {_NEXT} SELECT vec_id, round({_sql}, 6) AS value FROM n"


@query("SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, true AS is_unit FROM embeddings")
def vec_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.with_unit(table(spark, sf_dir, "embeddings"))
    return e.select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"), V.is_unit(F.col("unit")).alias("is_unit"))


@query("""WITH s AS (SELECT q.vec_id AS query, v.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS sim
      FROM embeddings q JOIN embeddings v ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id WHERE sim >= 0)
    SELECT query, id, round(sim, 6) AS sim, row_number() OVER (PARTITION BY query ORDER BY round(sim, 9) DESC, id) AS rank FROM s QUALIFY rank <= 10""")
def vec_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all vectors to each stated query, those whose id is divisible by 100."""
    e = table(spark, sf_dir, "embeddings")
    out = V.nearest(e.where("vec_id % 100 = 0"), e, 10)
    return out.select("query", "id", F.round("sim", 6).alias("sim"), F.col("rank").cast("bigint").alias("rank"))


@query("""WITH s AS (SELECT q.vec_id AS query, q.label AS label, v.label AS other, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS sim, v.vec_id AS id
      FROM embeddings q JOIN embeddings v ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id WHERE sim >= 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round(sim, 9) DESC, v.vec_id) <= 10)
    SELECT label, other, count(*) AS n FROM s GROUP BY ALL""")
def semantic_neighbors_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    near = V.nearest(e.where("vec_id % 100 = 0"), e, 10)
    named = near.join(e.select(F.col("vec_id").alias("query"), "label"), "query").join(e.select(F.col("vec_id").alias("id"), F.col("label").alias("other")), "id")
    return named.groupBy("label", "other").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_NEXT}, s AS (SELECT vec_id, list_cosine_similarity(x, y) AS sim FROM n)
    SELECT vec_id, round(least(1.0, greatest(0.0, (sim + 1) / 2)), 6)::DOUBLE AS confidence, CAST(least(5, greatest(0, floor((1 - sim) * 2))) AS BIGINT) AS distance,
    CASE WHEN sim >= 0.85 THEN 1.0 WHEN sim >= 0.70 THEN 0.7 ELSE 0.5 END::DOUBLE AS band FROM s""")
def similarity_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _adjacent(spark, sf_dir).select("vec_id", V.cosine(F.col("x"), F.col("y")).alias("sim"))
    return s.select("vec_id", F.round(V.similarity_confidence(F.col("sim")), 6).alias("confidence"), V.similarity_distance(F.col("sim")).cast("bigint").alias("distance"), V.band(F.col("sim")).alias("band"))


@query("""SELECT a.vec_id AS a, b.vec_id AS b, round(CASE WHEN a.vec_id = b.vec_id THEN 1.0 ELSE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) END, 6)::DOUBLE AS sim
    FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <= b.vec_id WHERE a.vec_id % 5 = b.vec_id % 5""")
def similarity_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarities inside each group of one label and one fifth of the ids."""
    e = table(spark, sf_dir, "embeddings").withColumn("g", F.col("label") * 5 + F.col("vec_id") % 5)
    return V.similarities(e, "g").select("a", "b", F.round("sim", 6).alias("sim"))


@query("""WITH s AS (SELECT q.vec_id AS query, v.vec_id AS word, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS sim
      FROM embeddings q JOIN embeddings v ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id WHERE sim >= 0.5 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round(sim, 9) DESC, v.vec_id) <= 15),
    c AS (SELECT s.query, s.word, s.sim, s.sim + 0.02 * coalesce(list_cosine_similarity(w.embedding::DOUBLE[], x.embedding::DOUBLE[]), 0) AS score
      FROM s JOIN embeddings w ON w.vec_id = s.word LEFT JOIN embeddings x ON x.vec_id = s.query + 1)
    SELECT query, word, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, CAST(word AS VARCHAR)) AS rank FROM c QUALIFY rank <= 5""")
def semantic_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as words named by their ids: corrections of every hundredth one, with the next one as its context."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("word"), "embedding", "vec_id")
    asked = e.where("vec_id % 100 = 0").select(F.col("word").alias("query"), F.array((F.col("vec_id") + 1).cast("string")).alias("context"))
    out = V.corrections(asked, e.select("word", "embedding"))
    return out.select(F.col("query").cast("bigint").alias("query"), F.col("word").cast("bigint").alias("word"), F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))
