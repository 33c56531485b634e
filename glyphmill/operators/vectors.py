"""Vector measures and nearest neighbours on array columns, exact and without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    """Null where dimensions differ."""
    value = _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    return F.when(F.size(a) == F.size(b), value)


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """0 for null, empty or zero vectors, null where dimensions differ."""
    size = norm(a) * norm(b)
    return F.when(a.isNull() | b.isNull(), 0.0).when(F.size(a) != F.size(b), None).when(size == 0, 0.0).otherwise(dot(a, b) / size)


def euclidean(a: Column, b: Column) -> Column:
    gap = lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.sqrt(_sum(F.zip_with(a, b, gap))))


def manhattan(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == F.size(b), _sum(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))))


def unit(a: Column) -> Column:
    """The vector over its norm; a zero vector stays."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n == 0, x.cast("double")).otherwise(x.cast("double") / n))


def is_unit(a: Column, eps: float = 1e-6) -> Column:
    return F.abs(norm(a) - 1) <= eps * 10


def with_unit(df: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """Adds ``unit``, so that similarity is one dot product."""
    return df.withColumn("unit", unit(F.col(vec_col)))


#: Queries and vectors of a block: what a task holds at a time.
BLOCK, VECTORS = 2_000, 20_000


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 10, least: float = 0.0, id_col: str = "vec_id", vec_col: str = "embedding", exclude_self: bool = True) -> DataFrame:
    """``query, id, sim, rank``: the k most similar vectors of each query, exact.

    The stated queries meet all vectors in blocks. Up to BLOCK queries go to the vectors' own tasks as a broadcast; more
    of them are dealt in blocks, each of which meets each block of vectors in one task, and nothing goes to the driver.
    What is shuffled afterwards is k rows for each query and block.
    """
    import math

    import numpy as np
    import pyarrow as pa

    schema = "query bigint, id bigint, sim double"

    def units(rows: list) -> np.ndarray:
        v = np.array(rows, np.float64)
        size = np.linalg.norm(v, axis=1, keepdims=True)
        return v / np.where(size == 0, 1, size)

    def best(ids: list, sims: np.ndarray, own: list) -> list[tuple]:
        """The k best of each row of similarities."""
        out = []
        for i, query in enumerate(ids):
            take = np.flatnonzero(sims[i] >= least)
            if len(take) > k + 1:
                take = take[sims[i][take] >= np.partition(sims[i][take], -(k + 1))[-(k + 1)]]
            near = sorted((-float(sims[i][j]), own[j]) for j in take.tolist() if not (exclude_self and own[j] == query))
            out += [(query, j, -x) for x, j in near[:k]]
        return out

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["query", "id", "sim"])

    asked = queries.select(F.col(id_col).alias("i"), F.col(vec_col).alias("v")).where("v is not null")
    held = vectors.select(F.col(id_col).alias("i"), F.col(vec_col).alias("v")).where("v is not null")
    blocks = max(1, math.ceil(asked.count() / BLOCK))
    if blocks == 1:
        rows = sorted((r[0], r[1]) for r in asked.collect())  # at most BLOCK of them
        if not rows:
            return vectors.sparkSession.createDataFrame([], f"{schema}, rank int")
        shared = vectors.sparkSession.sparkContext.broadcast(([i for i, _ in rows], units([v for _, v in rows])))

        def run(batches):
            ids, q = shared.value
            for batch in batches:
                for at in range(0, batch.num_rows, VECTORS):
                    piece = batch.slice(at, VECTORS)
                    yield batch_of(best(ids, q @ units(piece.column(1).to_pylist()).T, piece.column(0).to_pylist()))

        found = held.mapInArrow(run, schema)
    else:
        parts = max(1, math.ceil(held.count() / VECTORS))
        deal = lambda n: F.pmod(F.xxhash64("i"), F.lit(n))
        q = asked.withColumn("a", deal(blocks)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        v = held.withColumn("b", deal(parts)).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        columns = ("a", "b", "i", "v")
        kinds = [F.col(c).cast("bigint").alias(c) if c in "ab" else F.col(c) for c in columns]

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            rows = []
            if left.num_rows and right.num_rows:
                sims = units(left["v"].to_pylist()) @ units(right["v"].to_pylist()).T
                rows = best(left["i"].to_pylist(), sims, right["i"].to_pylist())
            return pa.Table.from_batches([batch_of(rows)])

        found = q.select(*kinds).groupBy("a", "b").cogroup(v.select(*kinds).groupBy("a", "b")).applyInArrow(meet, schema)
    w = Window.partitionBy("query").orderBy(F.round("sim", 9).desc(), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def similarities(vectors: DataFrame, by: str, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``a, b, sim``: all pairs of the vectors of one group (``by``), each with itself too; a matrix group by group."""
    u = with_unit(vectors, vec_col).select(F.col(by).alias("g"), F.col(id_col).alias("i"), F.col("unit"))
    left = u.select("g", F.col("i").alias("a"), F.col("unit").alias("x"))
    both = left.join(u.select("g", F.col("i").alias("b"), F.col("unit").alias("y")), "g").where("a <= b")
    return both.select("a", "b", F.when(F.col("a") == F.col("b"), 1.0).otherwise(dot(F.col("x"), F.col("y"))).alias("sim"))


def pairs(vectors: DataFrame, ids: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``a, b, cosine, euclidean, manhattan`` of named pairs; null where a vector is unknown."""
    v = vectors.select(F.col(id_col).alias("k"), F.col(vec_col).alias("v"))
    left = ids.join(v.select(F.col("k").alias("a"), F.col("v").alias("va")), "a", "left")
    both = left.join(v.select(F.col("k").alias("b"), F.col("v").alias("vb")), "b", "left")
    known = F.col("va").isNotNull() & F.col("vb").isNotNull()
    return both.select(
        "a", "b", F.when(known, cosine(F.col("va"), F.col("vb"))).alias("cosine"), euclidean(F.col("va"), F.col("vb")).alias("euclidean"), manhattan(F.col("va"), F.col("vb")).alias("manhattan")
    )


def similarity_confidence(similarity: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (similarity + 1) / 2))


def similarity_distance(similarity: Column) -> Column:
    return F.least(F.lit(5), F.greatest(F.lit(0), F.floor((1 - similarity) * 2).cast("int")))


def band(similarity: Column) -> Column:
    """Confidence of the best correction: 1 from 0.85, 0.7 from 0.70, else 0.5."""
    return F.when(similarity >= 0.85, 1.0).when(similarity >= 0.70, 0.7).otherwise(0.5)


def context_window(text: Column, start: Column, end: Column, width: int = 32) -> Column:
    """The text around a range, ``width`` characters to each side."""
    first = F.greatest(start - width, F.lit(0))
    return F.substring(text, first + 1, F.least(F.length(text), end + width) - first)


def load_vec(spark, path: str, dim: int, most: int | None = None) -> DataFrame:
    """``word, embedding`` from a text file of vectors; the header and rows of another dimension are left out."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), " ").alias("p"))
    rows = parts.where(F.size("p") == dim + 1).select(F.col("p")[0].alias("word"), F.transform(F.slice("p", 2, dim), lambda x: x.cast("float")).alias("embedding"))
    return rows if most is None else rows.limit(most)


# --- corrections by meaning -----------------------------------------------------------------------------------------------

#: Least similarity of a correction, how much a similar context word adds, how many are kept. Fixed values.
MIN_SIMILARITY, CONTEXT_BOOST, MOST_CORRECTIONS = 0.50, 0.02, 5


def known_word(token: Column, words: DataFrame) -> tuple[Column, DataFrame]:
    """For a check by meaning: what needs no look-up (digits, single characters), and the table for the rest."""
    return token.rlike(r"^\d+$") | (F.length(token) <= 1), words.select(F.lower("word").alias("word")).distinct()


def context_fit(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """``query, word, fit``: mean similarity of a candidate to the words around the query; 0.5 without any that has a
    vector. ``rows`` has ``query, word, context array<string>``, ``vectors`` ``word, embedding``."""
    v = vectors.select("word", unit(F.col("embedding")).alias("u"))
    near = rows.select("query", "word", F.explode("context").alias("other")).join(v, "word")
    near = near.join(v.select(F.col("word").alias("other"), F.col("u").alias("o")), "other")
    mean = near.groupBy("query", "word").agg(F.avg(dot(F.col("u"), F.col("o"))).alias("fit"), F.sum(dot(F.col("u"), F.col("o"))).alias("total"))
    return rows.select("query", "word").distinct().join(mean, ["query", "word"], "left").select("query", "word", F.coalesce("fit", F.lit(0.5)).alias("fit"), F.coalesce("total", F.lit(0.0)).alias("total"))


def corrections(queries: DataFrame, vectors: DataFrame, k: int = MOST_CORRECTIONS) -> DataFrame:
    """``query, word, score, distance, confidence, rank``: for words with a vector, the words nearest in meaning, moved
    up by what they share with the context; for others, words within two edits, similarity 1 / (1 + edits).

    ``queries`` has ``query, context array<string>``, ``vectors`` ``word, embedding`` with each word once.
    """
    from glyphmill.operators import suggest as G

    own = vectors.withColumn("vec_id", F.xxhash64("word"))
    asked = queries.join(vectors.select(F.col("word").alias("query"), "embedding"), "query").withColumn("vec_id", F.xxhash64("query"))
    near = nearest(asked.select("vec_id", "embedding").dropDuplicates(["vec_id"]), own.select("vec_id", "embedding"), 3 * k, MIN_SIMILARITY)
    found = near.join(asked.select(F.col("vec_id").alias("query"), F.col("query").alias("name"), "context"), "query")
    found = found.join(own.select(F.col("vec_id").alias("id"), "word"), "id").select(F.col("name").alias("query"), "word", "context", "sim")
    fit = context_fit(found.select("query", "word", "context"), vectors)
    found = found.join(fit, ["query", "word"]).select("query", "word", (F.col("sim") + CONTEXT_BOOST * F.col("total")).alias("score"), "sim")
    rest = queries.join(vectors.select(F.col("word").alias("query")), "query", "left_anti").select(F.lit("").alias("lang"), "query").distinct()
    typed = G.by_levenshtein(rest, vectors.select(F.lit("").alias("lang"), "word"), 2, 3 * k)
    typed = typed.select("query", "word", (1.0 / (1 + F.col("distance"))).alias("score"), (1.0 / (1 + F.col("distance"))).alias("sim"))
    w = Window.partitionBy("query").orderBy(F.round("score", 9).desc(), "word")
    ranked = found.unionByName(typed).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query", "word", "score", similarity_distance(F.col("sim")).alias("distance"), similarity_confidence(F.col("sim")).alias("confidence"), "rank")


def classify(best_similarity: Column, edits: Column) -> Column:
    """Kind of an error by its best correction: a slip of the keys, a word of near meaning, or unknown."""
    return F.when(edits.between(1, 2), "orthographic").when(best_similarity >= 0.70, "semantic").otherwise("unknown")
