"""Dictionaries as tables: deriving, probing and changing them, and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import tokens as T

#: A dictionary up to this many rows is broadcast: short strings, a few tens of megabytes at most.
BROADCAST_ROWS = 500_000


def sized(words: DataFrame) -> DataFrame:
    """The dictionary, kept, and marked for a broadcast if it is small enough; else joins shuffle it."""
    kept = words.persist()
    return F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept


def words_of(docs: DataFrame, kind: str = "checker", text_col: str = "text") -> DataFrame:
    """``doc_id, lang, word``: one row for each token, folded to lower case."""
    return docs.select("doc_id", "lang", F.explode(T.tokens(F.col(text_col), kind)).alias("token")).select("doc_id", "lang", F.lower("token").alias("word"))


def document_counts(docs: DataFrame) -> DataFrame:
    """``lang, word, docs``: in how many documents a word stands. Repeats inside a document go before any shuffle."""
    folded = F.array_distinct(T.folded_tokens(F.col("text")))
    return docs.select("lang", F.explode(folded).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("docs"))


def derive(docs: DataFrame, least_docs: int = 3) -> DataFrame:
    """``lang, word``: words that stand in at least so many documents of their language."""
    return document_counts(docs).where(F.col("docs") >= least_docs).select("lang", "word")


def membership(words: DataFrame, dictionary: DataFrame, on: list[str], known: bool) -> DataFrame:
    """Rows whose key the dictionary has, or has not; the join's strategy follows the dictionary's size at run time."""
    return words.join(dictionary.select(*on).distinct(), on, "left_semi" if known else "left_anti")


def with_prefix(words: DataFrame, prefix: str, proper: bool = True, ignore_case: bool = False) -> DataFrame:
    """Words that begin so; proper ones are longer than the prefix."""
    w = F.lower("word") if ignore_case else F.col("word")
    p = prefix.lower() if ignore_case else prefix
    return words.where(w.startswith(p) & (F.length("word") > len(prefix) if proper else F.lit(True)))


def with_suffix(words: DataFrame, suffix: str, proper: bool = True, ignore_case: bool = False) -> DataFrame:
    w = F.lower("word") if ignore_case else F.col("word")
    s = suffix.lower() if ignore_case else suffix
    return words.where(w.endswith(s) & (F.length("word") > len(suffix) if proper else F.lit(True)))


def matching(words: DataFrame, pattern: str) -> DataFrame:
    return words.where(F.col("word").rlike(pattern))


def of_length(words: DataFrame, least: int, most: int) -> DataFrame:
    return words.where(F.length("word").between(least, most))


def is_number(word: Column) -> Column:
    return word.rlike(r"^\d+(\.\d+)?$")


def skip_token(token: Column) -> Column:
    """Empty, all digits, or a single character that is no letter."""
    return (token == "") | token.rlike(r"^\d+$") | ((F.length(token) == 1) & ~token.rlike(r"^\p{L}$"))


def add(words: DataFrame, more: DataFrame) -> DataFrame:
    return words.unionByName(more).distinct()


def remove(words: DataFrame, gone: DataFrame) -> DataFrame:
    return words.join(gone, words.columns, "left_anti")


def merge(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.unionByName(right).dropDuplicates()


def intersection(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.intersect(right)


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.subtract(right)


def statistics(words: DataFrame) -> DataFrame:
    """Total, distinct, shortest, longest and mean length by language."""
    size = F.length("word")
    return words.groupBy("lang").agg(
        F.count(F.lit(1)).alias("total"), F.countDistinct("word").alias("uniq"), F.min(size).cast("bigint").alias("min_len"),
        F.max(size).cast("bigint").alias("max_len"), F.round(F.avg(size), 2).alias("avg_len"),
    )


def by_length(words: DataFrame) -> DataFrame:
    return words.groupBy(F.length("word").cast("bigint").alias("len")).agg(F.count(F.lit(1)).alias("n"))


def by_first_letter(words: DataFrame) -> DataFrame:
    return words.groupBy(F.upper(F.substring("word", 1, 1)).alias("letter")).agg(F.count(F.lit(1)).alias("n"))


def tiers(counts: DataFrame) -> DataFrame:
    """``lang, word, rank, bonus``: 200, 100 and 50 for the 50, 200 and 1000 words in most documents, else 0."""
    from pyspark.sql.window import Window

    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("docs").desc(), "word"))
    ranked = counts.withColumn("rank", rank).where("rank <= 1000")
    bonus = F.when(F.col("rank") <= 50, 200).when(F.col("rank") <= 200, 100).otherwise(50)
    return ranked.select("lang", "word", F.col("rank").cast("bigint").alias("rank"), bonus.cast("bigint").alias("bonus"))


def sub_vocabulary(vocabulary: DataFrame, words: DataFrame) -> DataFrame:
    """The vocabulary's rows whose word is in the list."""
    return vocabulary.join(words.select("word").distinct(), "word", "left_semi")
