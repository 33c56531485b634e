"""Streams: documents checked as they arrive, and event metrics with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from glyphmill.functions import tokens as T


def read(spark: SparkSession, path: str, schema: str, files: int = 100, pattern: str = "*.parquet") -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", pattern).parquet(path)


def read_table(spark: SparkSession, path: str, schema: StructType, files: int = 100) -> DataFrame:
    """A table as a stream, be it one Parquet file or a folder of files of any names."""
    one = f"{path[:-1]}[{path[-1]}]"  # a stream takes no single file by its plain name, but what a pattern finds
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(one)


def misspellings(docs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``doc_id, lang, word`` of the words that a static dictionary lacks; the stream keeps no state."""
    words = docs.select("doc_id", "lang", F.explode(F.transform(T.tokens(F.col("text")), F.lower)).alias("word"))
    known = dictionary.withColumn("known", F.lit(True))
    return words.join(known, ["lang", "word"], "left").where("known is null").select("doc_id", "lang", "word")


def event_windows(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts and sums by event type in tumbling windows; rows later than the watermark are left out."""
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", late)
        .groupBy(F.window("ts", size).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "total")
    )


def drain(rows: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write all that is there and stop."""
    query = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def drain_updates(rows: DataFrame, path: str, checkpoint: str, keys: list[str]) -> DataFrame:
    """Write what each batch changes, and return the last state of every key: windows still open are in it too.

    A batch that is done again after a failure overwrites its own folder, so nothing is counted twice.
    """
    spark = rows.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    values = [c for c in rows.columns if c not in keys]
    done = spark.read.schema(rows.schema.add("batch", "long")).parquet(path)
    return done.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("last")).select(*keys, "last.*")
