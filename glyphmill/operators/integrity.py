"""Manifests, cache policies and metrics as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def verify(contents: DataFrame, manifest: DataFrame) -> DataFrame:
    """``path, status``: verified, mismatch, or unverified where the manifest has no entry."""
    digest = contents.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("actual"))
    status = F.when(F.col("sha256").isNull(), "unverified").when(F.col("sha256") == F.col("actual"), "verified").otherwise("mismatch")
    return digest.join(manifest, "path", "left").select("path", status.alias("status"))


def eviction(entries: DataFrame, most: int, buckets: int = 1000) -> DataFrame:
    """Entries ``key, size, ts`` to drop, oldest first, until the rest fits; entries of one time go by key.

    The sizes of ``buckets`` spans of time, a table of that many rows, say in which span the limit is passed; only
    that span's entries are put in order, and in them the same is done again as long as they are many.
    """
    todo, room, gone = entries.select("key", "size", "ts"), most, None
    while True:
        span = todo.agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count(F.lit(1)).alias("n")).first()
        if not span["n"]:
            return todo if gone is None else gone
        low, high = F.lit(span["a"]).cast("double"), F.lit(span["b"]).cast("double")
        bucket = F.least(F.floor((F.col("ts").cast("double") - low) / (high - low) * buckets), F.lit(buckets - 1)) if span["a"] != span["b"] else F.lit(0)
        placed = todo.withColumn("bucket", F.coalesce(bucket, F.lit(0)).cast("int"))
        sums = {r["bucket"]: (r["s"], r["n"]) for r in placed.groupBy("bucket").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).collect()}
        cut = None
        for b in sorted(sums, reverse=True):
            if sums[b][0] > room:
                cut = b
                break
            room -= sums[b][0]
        if cut is None:
            return todo.limit(0) if gone is None else gone
        older = placed.where(F.col("bucket") < cut).select("key", "size", "ts")
        gone = older if gone is None else gone.unionByName(older)
        todo = placed.where(F.col("bucket") == cut).select("key", "size", "ts")
        if sums[cut][1] <= 100_000 or span["a"] == span["b"]:
            break
    newest = Window.partitionBy("one").orderBy(F.col("ts").desc(), F.col("key").desc())
    last = todo.withColumn("one", F.lit(1)).withColumn("kept", F.sum("size").over(newest)).where(F.col("kept") > room).select("key", "size", "ts")
    return gone.unionByName(last)


def expired(ts: Column, now: Column, days: int) -> Column:
    """Whether an ISO-8601 time is older than so many days; what does not parse is."""
    t = F.try_to_timestamp(ts)
    return F.coalesce(F.unix_timestamp(now) - F.unix_timestamp(t) > days * 86400, F.lit(True))


def metrics(events: DataFrame) -> DataFrame:
    """Counts, means and shares by event type."""
    total = Window.partitionBy()
    return (
        events.groupBy("event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.sum("value"), 2).alias("total"), F.countDistinct("user_id").alias("users"))
        .withColumn("share", F.round(F.col("n") / F.sum("n").over(total), 4))
    )


def hit_rate(rows: DataFrame, hit: Column) -> DataFrame:
    hits = F.sum(F.when(hit, 1).otherwise(0))
    return rows.agg(hits.alias("hits"), F.count(F.lit(1)).alias("n"), F.round(hits / F.count(F.lit(1)), 4).alias("rate"))


#: Days for which a kept resource counts as fresh. Fixed values.
LIFETIMES = {"spelling": 7, "grammar": 7, "frequency": 30, "model": 30}


def keep_resource(df: DataFrame, folder: str, kind: str, lang: str) -> None:
    """Write a parsed resource with the time of writing; the one before it is replaced."""
    df.withColumn("kept_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{kind}/{lang}")


def kept_resource(spark, folder: str, kind: str, lang: str, now: Column | None = None) -> DataFrame | None:
    """A resource that is kept and still fresh, else none."""
    from glyphmill.sources.lines import first_that_exists

    path = f"{folder.rstrip('/')}/{kind}/{lang}"
    if first_that_exists(spark, [path]) is None:
        return None
    df = spark.read.parquet(path)
    old = df.agg(F.max("kept_at").alias("t")).select(expired(F.col("t").cast("string"), now if now is not None else F.current_timestamp(), LIFETIMES[kind]).alias("old"))
    return None if old.first()["old"] else df.drop("kept_at")


def observed(df: DataFrame, name: str, **metrics: Column):
    """The table, and an observation that holds the metrics once it has been read."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, *[c.alias(k) for k, c in metrics.items()]), seen
