"""Documents against dictionaries, with what a reader needs: each error's place, surroundings and best corrections.

Only distinct errors are corrected; their corrections then meet the places again in one join. Documents are never
collected, and a document's own errors are put in order inside its own row or by its own key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphmill.functions import tokens as T
from glyphmill.operators import dictionary as D
from glyphmill.operators import suggest as G

#: Words around an error that are shown, in characters. A fixed value.
AROUND = 32


def places(docs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``doc_id, lang, pos, original, word``: every token that the dictionary of the document's language lacks, with its
    offset; ``word`` is folded."""
    keyed = docs.select(F.struct("doc_id", "lang").alias("key"), "text")
    found = T.token_table(keyed, id_col="key").select("key.*", "token", "pos").withColumn("word", F.lower("token"))
    wrong = found.join(D.sized(dictionary), ["lang", "word"], "left_anti")
    return wrong.select("doc_id", "lang", F.col("pos").cast("bigint").alias("pos"), F.col("token").alias("original"), "word")


def best(queries: DataFrame, dictionary: DataFrame, k: int = 3, strategy: Callable | None = None) -> DataFrame:
    """``lang, word, suggestions``: the k best corrections of each distinct error in order; none for some."""
    found = (strategy or (lambda q, d: G.by_levenshtein(q, d, 2, k)))(queries.select("lang", F.col("word").alias("query")).distinct(), dictionary)
    order = F.sort_array(F.collect_list(F.struct("rank", "word")))
    top = found.where(F.col("rank") <= k).groupBy("lang", "query").agg(order.alias("all"))
    return top.select("lang", F.col("query").alias("word"), F.col("all.word").alias("suggestions"))


def check(docs: DataFrame, dictionary: DataFrame, k: int = 3, strategy: Callable | None = None) -> DataFrame:
    """``doc_id, lang, pos, original, word, suggestions`` of every error; an error without corrections has an empty list."""
    wrong = places(docs, dictionary).persist()
    top = best(wrong, dictionary, k, strategy)
    return wrong.join(top, ["lang", "word"], "left").withColumn("suggestions", F.coalesce("suggestions", F.array().cast("array<string>")))


def located(errors: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds ``line, column, context``: where an error stands, from 1, and the text around it."""
    own = errors.join(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id")
    line, column = T.line_and_column(F.col("text"), F.col("pos").cast("int"))
    begin = F.greatest(F.col("pos") - AROUND, F.lit(0)).cast("int")
    end = F.least(F.length("text"), (F.col("pos") + F.length("original") + AROUND).cast("int"))
    return own.withColumn("line", line).withColumn("column", column).withColumn("context", F.substring("text", begin + 1, end - begin)).drop("text")


def in_order(errors: DataFrame) -> DataFrame:
    """``doc_id, errors``: a document's errors by place, at one place the surer first."""
    confidence = F.col("confidence") if "confidence" in errors.columns else F.lit(0.5)
    entry = F.struct(F.col("pos"), (-confidence).alias("less"), "original", "suggestions")
    return errors.groupBy("doc_id").agg(F.sort_array(F.collect_list(entry)).alias("errors"))


def report_lines(docs: DataFrame, errors: DataFrame) -> DataFrame:
    """``doc_id, line_no, line``: ``OK id (n words)``, or ``FAIL id (n errors)`` and a line for each error with its place
    and corrections."""
    words = docs.select("doc_id", F.size(T.tokens(F.col("text"))).alias("words"))
    sorted_ = words.join(in_order(errors), "doc_id", "left")
    name = F.col("doc_id").cast("string")
    ok = F.array(F.concat(F.lit("OK "), name, F.lit(" ("), F.col("words").cast("string"), F.lit(" words)")))
    each = F.transform("errors", lambda e: F.concat(F.lit("  "), e["pos"].cast("string"), F.lit(": "), e["original"], F.when(F.size(e["suggestions"]) > 0, F.concat(F.lit(" -> "), F.array_join(e["suggestions"], ", "))).otherwise("")))
    bad = F.concat(F.array(F.concat(F.lit("FAIL "), name, F.lit(" ("), F.size("errors").cast("string"), F.lit(" errors)"))), each)
    return sorted_.select("doc_id", F.posexplode(F.when(F.col("errors").isNull(), ok).otherwise(bad)).alias("line_no", "line"))


def csv_rows(errors: DataFrame) -> DataFrame:
    """Columns of the CSV report: a stable id, the place, the word, its best correction, confidence in percent, type."""
    key = F.substring(F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("pos").cast("string"), "original").cast("binary"), 256), 1, 16)
    sure = F.when(F.size("suggestions") > 0, 1.0 / F.size("suggestions")).otherwise(0.0)
    return errors.select(
        key.alias("id"), "doc_id", "line", "original", F.coalesce(F.get("suggestions", F.lit(0)), F.lit("")).alias("suggestion"),
        F.round(100 * sure, 1).alias("confidence_pct"), F.lit("orthographic").alias("error_type"),
    )


def sarif(errors: DataFrame, tool: str = "glyphmill") -> DataFrame:
    """``doc_id, sarif``: a SARIF 2.1.0 document for each text with errors."""
    result = lambda e: F.struct(
        F.lit("spelling").alias("ruleId"), F.lit("warning").alias("level"),
        F.struct(F.concat(F.lit("Unknown word: "), e["original"], F.when(F.size(e["suggestions"]) > 0, F.concat(F.lit("; did you mean "), F.array_join(e["suggestions"], ", "), F.lit("?"))).otherwise("")).alias("text")).alias("message"),
        F.array(F.struct(F.struct(
            F.struct(F.col("doc_id").cast("string").alias("uri")).alias("artifactLocation"),
            F.struct(e["pos"].alias("charOffset"), F.length(e["original"]).alias("charLength")).alias("region"),
        ).alias("physicalLocation"))).alias("locations"),
    )
    run = F.struct(F.struct(F.struct(F.lit(tool).alias("name")).alias("driver")).alias("tool"), F.transform("errors", result).alias("results"))
    return in_order(errors).select("doc_id", F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("sarif"))


def check_languages(segments: DataFrame, dictionary: DataFrame, k: int = 5) -> DataFrame:
    """``doc_id, lang, start, stop, original, suggestions, id``: errors of texts whose parts are in several languages.

    ``segments`` has ``doc_id, lang, offset, text``, parts of a document in one language each. Each part is held against
    its own language's dictionary; a part without one and an error without corrections are left out.
    """
    known = segments.join(D.sized(dictionary.select("lang").distinct()), "lang", "left_semi")
    parts = known.withColumn("part", F.struct("doc_id", "lang", "offset"))
    found = T.token_table(parts, id_col="part").select("part.*", "token", "pos").withColumn("word", F.lower("token"))
    wrong = found.join(D.sized(dictionary), ["lang", "word"], "left_anti").persist()
    rows = wrong.join(best(wrong, dictionary, k), ["lang", "word"]).withColumn("start", (F.col("offset") + F.col("pos")).cast("bigint"))
    rows = rows.withColumn("stop", (F.col("start") + F.length("token")).cast("bigint"))
    key = F.concat_ws("-", "lang", "token", F.concat(F.col("start").cast("string"), F.lit(".."), F.col("stop").cast("string")))
    return rows.select("doc_id", "lang", "start", "stop", F.col("token").alias("original"), "suggestions", F.substring(F.sha2(key.cast("binary"), 256), 1, 16).alias("id"))
