"""Exact deduplication over a persistent digest index (operator 5), DataFrame functions only.

The index is a table with one row per distinct text: the SHA-256 of the text with A-Z lower-cased, the id of the
row that stays and the number of rows seen. It is bucketed and sorted by digest, so a new batch, reduced to its own
distinct digests first, meets it in a sort-merge anti-join without shuffling the index, and what is new is appended.

Of equal texts the row with the largest id stays (null is the smallest); rows that repeat both the id and the text
count each, and one of them stays. Null counts as the empty text, and empty texts are equal to each other. Empty tables
give empty results; columns besides the id and the text, whatever their names, are carried by ``keep_new`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm.common import checkpointed, fresh_name

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text_col: str) -> Column:
    """SHA-256 of the normalised text, as binary."""
    return F.unhex(F.sha2(F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER).cast("binary"), 256))


class DigestIndex:
    """A persistent table ``digest, keep_id, group_size`` in the warehouse, made empty if it isn't there; ``id_type``
    is then the type of the ids. A table that is there keeps its number of buckets."""

    def __init__(self, spark: SparkSession, table: str, buckets: int | None = None, id_type: str = "bigint") -> None:
        self.spark, self.table = spark, table
        if spark.catalog.tableExists(table):
            rows = spark.sql(f"DESCRIBE FORMATTED {table}").where("lower(col_name) = 'num buckets'").collect()
            self.buckets = int(rows[0]["data_type"])
        else:
            self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.sql(
                f"CREATE TABLE {table} (digest BINARY, keep_id {id_type}, group_size BIGINT) USING parquet "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS"
            )

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def unseen(self, batch: DataFrame) -> DataFrame:
        """Rows of the batch (distinct digests) that the index does not hold."""
        return batch.join(self.read().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, batch: DataFrame) -> None:
        (
            batch.select("digest", "keep_id", "group_size")
            .repartition(self.buckets, "digest")
            .write.bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .format("parquet")
            .mode("append")
            .saveAsTable(self.table)
        )

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def distinct_digests(rows: DataFrame) -> DataFrame:
    """One row per digest; a hot digest is reduced before the shuffle."""
    return rows.groupBy("digest").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def deduplicate(df: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Add the table to the index and report every row: ``id, keep_id, group_size, kept, text_sha256``.

    ``keep_id`` is the row that stays for good: for a text the index held before, a row of an earlier batch, so that no
    row of this one stays. The index is read bucket by bucket and never shuffled: the batch's distinct digests meet it,
    and what it says of them is brought back to the rows by a join that splits a hot digest.
    """
    row, most = fresh_name("row"), F.max(F.struct("id", "row"))
    rows = checkpointed(
        df.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), digest(text_col).alias("digest"))
    )
    batch = rows.groupBy("digest").agg(most.alias("top"), F.count(F.lit(1)).alias("group_size"))
    batch = batch.select("digest", F.col("top.id").alias("keep_id"), F.col("top.row").alias(row), "group_size")
    batch = checkpointed(batch)
    fresh = checkpointed(index.unseen(batch))
    index.append(fresh)
    held = index.read().select("digest", "keep_id", "group_size").hint("merge")
    answer = batch.select("digest").join(held, "digest")
    answer = checkpointed(answer.join(fresh.select("digest", row), "digest", "left"))
    return rows.join(answer, "digest").select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("row").eqNullSafe(F.col(row)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_new(df: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of the table, with all their columns, whose text the index did not hold, one for each text.

    Rows are told by the digest of the text and the id, which any other reading of the table gives again, not by their
    place in it; so it doesn't matter how the table is made or split.
    """
    key = fresh_name("key")
    ident = F.col(id_col).cast("string")
    # One binary key, without nulls: rows are then dealt once for both the removal of repeats and the join.
    whole = F.concat(digest(text_col), F.coalesce(F.concat(F.lit("="), ident), F.lit("")).cast("binary"))
    rows = checkpointed(df.select(F.col(id_col).alias("id"), digest(text_col).alias("digest")))
    fresh = checkpointed(index.unseen(distinct_digests(rows)))
    index.append(fresh)
    kept = F.coalesce(F.concat(F.lit("="), F.col("keep_id").cast("string")), F.lit("")).cast("binary")
    kept = fresh.select(F.concat("digest", kept).alias(key))
    return df.withColumn(key, whole).dropDuplicates([key]).join(kept, key, "left_semi").drop(key)
