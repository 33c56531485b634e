"""Language scores, detection and segmentation, without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LATIN = "[a-zA-Zà-ÿ]"
#: Language, pattern whose matches are counted, least share, scripts that add 0.1 each, priority. Fixed values; the
#: folded letter classes are written out because RE2 and Java fold case differently.
RULES = (
    ("ru", "[\\x{0400}-\\x{04FF}][а-яА-ЯёЁ]", 0.30, ("[а-яА-ЯёЁ]",), 0),
    ("ja", "[\\x{3040}-\\x{309F}\\x{30A0}-\\x{30FF}\\x{4E00}-\\x{9FFF}]", 0.20, ("[\\x{3040}-\\x{309F}]", "[\\x{30A0}-\\x{30FF}]", "[\\x{4E00}-\\x{9FFF}]"), 0),
    ("pt", "[ãõáàâéêíóôúçÃÕÁÀÂÉÊÍÓÔÚÇ]", 0.05, (LATIN,), 0),
    ("fr", "[éèêëàâùûüîïôçÉÈÊËÀÂÙÛÜÎÏÔÇ]", 0.02, (LATIN,), 1),
    ("es", "[áéíóúüñ¿¡ÁÉÍÓÚÜÑ]", 0.02, (LATIN,), 1),
    ("de", "[äöüßÄÖÜ]", 0.02, (LATIN,), 1),
    ("en", "[a-zA-Z]", 0.30, (LATIN,), 0),
)
PRIORITY = {lang: prio for lang, _, _, _, prio in RULES}


def score(text: Column, lang: str) -> Column:
    """Score of one language within 0 and 1, 0 where its conditions fail."""
    _, pattern, least, scripts, _ = next(r for r in RULES if r[0] == lang)
    n = F.length(text)
    ratio = F.regexp_count(text, F.lit(pattern)) / n
    bonus = sum((F.when(text.rlike(s), 0.1).otherwise(0.0) for s in scripts), F.lit(1.0))
    value = ratio * bonus
    if lang != "en":
        value = value * (1 + ratio)
    ok = ratio >= least
    if lang == "ja":
        ok = ok & text.rlike("[\\x{3040}-\\x{309F}]")
    if lang == "en":
        ok = ok & (F.regexp_count(text, F.lit("[à-ÿ]")) / n <= 0.02)
    return F.when((n > 0) & ok, F.least(value, F.lit(1.0))).otherwise(0.0)


def scores(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``scores``: array of (score, priority, language) of the languages that score."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    each = [F.struct(score(t, r[0]).alias("score"), F.lit(r[4]).alias("priority"), F.lit(r[0]).alias("code")) for r in RULES]
    some = F.filter(F.array(*each), lambda s: s["score"] > 0)
    empty = F.trim(t) == ""
    return df.withColumn("scores", F.when(empty, F.slice(some, 1, 0)).otherwise(some))


def detect(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``detected``, null for blank text, and ``confidence``."""
    s = scores(df, text_col)
    ordered = F.reverse(F.array_sort("scores"))
    top, second = F.get(ordered, 0), F.get(ordered, 1)
    ratio = top["score"] / (top["score"] + second["score"])
    conf = F.when(top["score"].isNull(), 0.0).when(second["score"].isNull(), 1.0).otherwise(F.least(F.lit(1.0), ratio * 0.8 + 0.2))
    return s.withColumn("detected", top["code"]).withColumn("confidence", conf).drop("scores")


def candidates(df: DataFrame, k: int = 3, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``id, code, share, rank``: the k best languages with their share of all scores."""
    s = scores(df, text_col)
    total = F.aggregate("scores", F.lit(0.0), lambda acc, x: acc + x["score"])
    ordered = F.slice(F.reverse(F.array_sort("scores")), 1, k)
    return s.select(id_col, total.alias("total"), F.posexplode(ordered).alias("rank", "s")).select(
        id_col, F.col("s.code").alias("code"), (F.col("s.score") / F.col("total")).alias("share"), (F.col("rank") + 1).alias("rank")
    )


def resolve(flag: Column, detected: Column, fallback: str = "en") -> Column:
    """The language to use: an explicit flag, else the detected one, else the fallback."""
    return F.coalesce(flag, detected, F.lit(fallback))


def segments(
    nodes: DataFrame, doc_col: str = "conv_id", order_col: str = "turn", text_col: str = "text",
    min_length: int = 3, min_confidence: float = 0.3, fallback: str = "en",
) -> DataFrame:
    """``doc, segment, code, first, last, nodes, confidence``: runs of nodes in one language; short or doubtful nodes
    count as the fallback language."""
    found = detect(nodes, text_col)
    weak = (F.length(F.trim(F.coalesce(F.col(text_col), F.lit("")))) < min_length) | F.col("detected").isNull() | (F.col("confidence") < min_confidence)
    found = found.withColumn("code", F.when(weak, fallback).otherwise(F.col("detected")))
    own = Window.partitionBy(doc_col).orderBy(order_col)
    starts = F.when(F.lag("code").over(own).eqNullSafe(F.col("code")), 0).otherwise(1)
    marked = found.withColumn("starts", starts).withColumn("segment", F.sum("starts").over(own))
    return marked.groupBy(doc_col, "segment", "code").agg(
        F.min(order_col).alias("first"), F.max(order_col).alias("last"), F.count(F.lit(1)).alias("nodes"), F.avg("confidence").alias("confidence")
    )


def detect_with(df: DataFrame, model, k: int = 3, text_col: str = "text", id_col: str = "doc_id", chars: int = 501) -> DataFrame:
    """``id, code, share, rank`` by an outside model: ``model(texts) -> [[(code, share), ...], ...]``, called with batches
    of the texts' first ``chars`` characters, as such models read no more. Without a model the rules above answer."""
    if model is None:
        return candidates(df, k, text_col, id_col)
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found = [sorted(x, key=lambda c: -c[1])[:k] for x in model(part.column(1).to_pylist())]
                rows = [(i, code, float(share), n + 1) for i, x in enumerate(found) for n, (code, share) in enumerate(x)]
                where = pa.array([r[0] for r in rows], pa.int64())
                rest = [pa.array([r[c] for r in rows], t) for c, t in ((1, pa.string()), (2, pa.float64()), (3, pa.int32()))]
                yield pa.RecordBatch.from_arrays([part.column(0).take(where), *rest], [id_col, "code", "share", "rank"])

    head = df.select(id_col, F.substring(F.coalesce(F.col(text_col), F.lit("")), 1, chars).alias("t"))
    return head.mapInArrow(run, f"{id_col} {dict(df.dtypes)[id_col]}, code string, share double, rank int")
