"""Check results: errors of documents and their aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphmill.functions import tokens as T
from glyphmill.operators import dictionary as D


def word_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, word``: each document's words, one row for each time they stand there."""
    return docs.select("doc_id", "lang", F.explode(T.folded_tokens(F.col("text"))).alias("word"))


def errors(docs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``doc_id, lang, word, n``: what the dictionary of the document's language lacks.

    A small dictionary goes to the documents, so that only errors are shuffled, already counted in their row's task.
    """
    wrong = word_rows(docs).join(D.sized(dictionary), ["lang", "word"], "left_anti")
    return wrong.groupBy("doc_id", "lang", "word").agg(F.count(F.lit(1)).alias("n"))


def per_document(docs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``doc_id, errors, unique_errors`` of the documents with errors."""
    return errors(docs, dictionary).groupBy("doc_id").agg(F.sum("n").alias("errors"), F.count(F.lit(1)).alias("unique_errors"))


def word_counts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "lang", F.size(T.tokens(F.col("text"))).cast("bigint").alias("words"))


def documents_report(docs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``doc_id, lang, words, errors, unique_errors, success`` for every document."""
    return (
        word_counts(docs)
        .join(per_document(docs, dictionary), "doc_id", "left")
        .select(
            "doc_id", "lang", "words", F.coalesce("errors", F.lit(0)).alias("errors"),
            F.coalesce("unique_errors", F.lit(0)).alias("unique_errors"), F.col("errors").isNull().alias("success"),
        )
    )


def merged(report: DataFrame) -> DataFrame:
    """Results of several documents as one, by language."""
    return report.groupBy("lang").agg(
        F.count(F.lit(1)).alias("docs"), F.sum("words").alias("words"), F.sum("errors").alias("errors"), F.sum(F.when(F.col("success"), 1).otherwise(0)).alias("clean")
    )


def summary(errs: DataFrame) -> DataFrame:
    return errs.groupBy("lang", "word").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"))


def top(errs: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent errors of each language."""
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "word"))
    return summary(errs).withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= k).select("lang", "word", "n", "rank")
