"""Reports of check results: text, JSON, CSV, SARIF, metrics and the audit log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def error_type(confidence: Column) -> Column:
    """Bands of confidence: high over 0.8, medium over 0.5, low."""
    return F.when(confidence > 0.8, "high").when(confidence > 0.5, "medium").otherwise("low")


def text_lines(report: DataFrame, details: DataFrame | None = None) -> DataFrame:
    """``doc_id, line``: OK or FAIL with the words and the most frequent errors."""
    if details is None:
        named = report.withColumn("top", F.lit(None).cast("string"))
    else:
        named = report.join(details, "doc_id", "left")
    ok = F.concat(F.lit("OK "), F.col("doc_id").cast("string"), F.lit(" ("), F.col("words").cast("string"), F.lit(" words)"))
    bad = F.concat(F.lit("FAIL "), F.col("doc_id").cast("string"), F.lit(" ("), F.col("errors").cast("string"), F.lit(" errors)"), F.coalesce(F.concat(F.lit(": "), F.col("top")), F.lit("")))
    return named.select("doc_id", F.when(F.col("success"), ok).otherwise(bad).alias("line"))


def json_lines(report: DataFrame) -> DataFrame:
    """``doc_id, json``."""
    return report.select("doc_id", F.to_json(F.struct("doc_id", "words", "errors", "unique_errors", "success")).alias("json"))


def sarif(errors: DataFrame, tool: str = "glyphmill") -> DataFrame:
    """``doc_id, sarif``: one SARIF 2.1.0 document for each text with ``rule_id, pos, context, message``."""
    result = F.struct(
        F.col("rule_id").alias("ruleId"), F.lit("warning").alias("level"), F.struct(F.col("message").alias("text")).alias("message"),
        F.array(F.struct(F.struct(
            F.struct(F.col("doc_id").cast("string").alias("uri")).alias("artifactLocation"),
            F.struct(F.col("pos").alias("charOffset"), F.length("context").alias("charLength")).alias("region"),
        ).alias("physicalLocation"))).alias("locations"),
    )
    grouped = errors.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(F.col("pos").alias("_p"), F.col("rule_id").alias("_r"), result.alias("r")))).alias("all"))
    run = F.struct(F.struct(F.struct(F.lit(tool).alias("name")).alias("driver")).alias("tool"), F.transform("all", lambda x: x["r"]).alias("results"))
    return grouped.select("doc_id", F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("sarif"))


def csv_rows(errors: DataFrame) -> DataFrame:
    """Columns of the CSV report, with a stable id and the confidence in percent."""
    key = F.substring(F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("word")).cast("binary"), 256), 1, 16)
    return errors.select(key.alias("id"), "doc_id", F.col("word").alias("original"), F.round(100.0 / (1 + F.col("n")), 1).alias("confidence_pct"), error_type(1.0 / (1 + F.col("n"))).alias("band"))


def exit_code(report: DataFrame, most: int = 0) -> DataFrame:
    """One row: 0 when there are at most so many errors, else 1."""
    return report.agg(F.coalesce(F.sum("errors"), F.lit(0)).alias("errors")).select("errors", F.when(F.col("errors") <= most, 0).otherwise(1).cast("bigint").alias("exit_code"))


def statsd(metrics: DataFrame) -> DataFrame:
    """``line`` of each ``name, value``."""
    return metrics.select(F.concat(F.col("name"), F.lit(":"), F.col("value").cast("string"), F.lit("|g")).alias("line"))


def prometheus(metrics: DataFrame) -> DataFrame:
    name = F.regexp_replace("name", r"[^a-zA-Z0-9_]", "_")
    return metrics.select(F.concat(F.lit("# TYPE "), name, F.lit(" gauge\n"), name, F.lit(" "), F.col("value").cast("string")).alias("line"))


def append_audit(rows: DataFrame, path: str) -> None:
    """Append JSON lines."""
    rows.write.mode("append").json(path)


def read_audit(spark, path: str, schema: str) -> DataFrame:
    """Newest first."""
    return spark.read.schema(schema).json(path).orderBy(F.col("ts").desc())


def hunspell_line(kind: Column, flag: Column, strip: Column, add: Column, cond: Column) -> Column:
    """An affix rule as a line of an affix file."""
    zero = lambda c: F.when(c == "", "0").otherwise(c)
    return F.concat_ws(" ", kind, flag, zero(strip), zero(add), F.when(cond == "", ".").otherwise(cond))


def with_statistics(errors: DataFrame) -> DataFrame:
    """``json``: one row, the batch report's statistics: documents with errors, errors, and errors by type."""
    by = errors.groupBy("error_type").agg(F.count(F.lit(1)).alias("n"))
    types = by.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("error_type", "n")))).alias("by_type"))
    total = errors.agg(F.count(F.lit(1)).alias("errors"), F.countDistinct("doc_id").alias("documents"))
    return total.join(types).select(F.to_json(F.struct("documents", "errors", "by_type")).alias("json"))  # one row each


def yaml_lines(errors: DataFrame) -> DataFrame:
    """``doc_id, yaml``: a document's errors as a YAML list; texts are quoted as JSON, which YAML reads alike."""
    quote = lambda c: F.regexp_replace(F.to_json(F.struct(c.alias("x"))), r'^\{"x":(.*)\}$', "$1")
    each = F.concat(F.lit("  - pos: "), F.col("pos").cast("string"), F.lit("\n    original: "), quote(F.col("original")))
    rows = errors.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", each.alias("y")))).alias("all"))
    return rows.select("doc_id", F.concat(F.lit("- id: "), F.col("doc_id").cast("string"), F.lit("\n  errors:\n"), F.array_join("all.y", "\n")).alias("yaml"))


def rotate_audit(spark, path: str, most_bytes: int) -> str | None:
    """Move an audit log over the limit aside, under a name with the next number; the name, or none if it stays."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    here = jvm.org.apache.hadoop.fs.Path(path)
    fs = here.getFileSystem(conf)
    if not fs.exists(here) or fs.getContentSummary(here).getLength() <= most_bytes:
        return None
    n = 1
    while fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}.{n}")):
        n += 1
    fs.rename(here, jvm.org.apache.hadoop.fs.Path(f"{path}.{n}"))
    return f"{path}.{n}"
