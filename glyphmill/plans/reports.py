"""Reports, integrity, metrics and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import tokens as T
from glyphmill.operators import grammar as G
from glyphmill.operators import integrity as I
from glyphmill.operators import results as R
from glyphmill.operators import vectors as V
from glyphmill.plans.common import BASE, CHECKER_SQL, dictionary, docs, table
from glyphmill.sinks import reports as S
from glyphmill.streaming import documents as ST

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


_REPORT = f"""r AS (SELECT d.doc_id, d.lang, len(regexp_extract_all(coalesce(d.text, ''), {CHECKER_SQL})) AS words,
    CAST(coalesce(sum(n), 0) AS BIGINT) AS errors, count(e.word) AS unique_errors, count(e.word) = 0 AS success
    FROM documents d LEFT JOIN errs e USING (doc_id) GROUP BY d.doc_id, d.lang, d.text)"""


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.documents_report(docs(spark, sf_dir), dictionary(spark, sf_dir))


@query(f"""WITH {BASE}, {_REPORT}, t AS (SELECT doc_id, word, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS k FROM errs),
    p AS (SELECT doc_id, string_agg(word, ', ' ORDER BY k) AS top FROM t WHERE k <= 3 GROUP BY doc_id)
    SELECT r.doc_id, CASE WHEN success THEN 'OK ' || r.doc_id || ' (' || words || ' words)' ELSE 'FAIL ' || r.doc_id || ' (' || errors || ' errors): ' || top END AS line
    FROM r LEFT JOIN p USING (doc_id)""")
def report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    errs = R.errors(docs(spark, sf_dir), dictionary(spark, sf_dir))
    order = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "word")))
    top = errs.groupBy("doc_id").agg(F.array_join(F.slice(order, 1, 3)["word"], ", ").alias("top"))
    return S.text_lines(_report(spark, sf_dir), top)


@query(f"""WITH {BASE}, {_REPORT} SELECT doc_id, '{{"doc_id":' || doc_id || ',"words":' || words || ',"errors":' || errors || ',"unique_errors":' || unique_errors || ',"success":' || success || '}}' AS json FROM r""")
def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.json_lines(_report(spark, sf_dir))


@query()
def report_sarif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sarif(G.check(docs(spark, sf_dir)))


@query(f"""WITH {BASE} SELECT substr(sha256(doc_id || ':' || word), 1, 16) AS id, doc_id, word AS original, round(100.0::DOUBLE / (1 + n), 1) AS confidence_pct,
    CASE WHEN 1.0 / (1 + n) > 0.8 THEN 'high' WHEN 1.0 / (1 + n) > 0.5 THEN 'medium' ELSE 'low' END AS band FROM errs""")
def report_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.csv_rows(R.errors(docs(spark, sf_dir), dictionary(spark, sf_dir)))


@query(f"""WITH {BASE}, b AS (SELECT lang, CASE WHEN 1.0 / (1 + n) > 0.8 THEN 'high' WHEN 1.0 / (1 + n) > 0.5 THEN 'medium' ELSE 'low' END AS band FROM errs)
    SELECT lang, band, count(*) AS n FROM b GROUP BY ALL""")
def error_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    errs = R.errors(docs(spark, sf_dir), dictionary(spark, sf_dir))
    return errs.groupBy("lang", S.error_type(1.0 / (1 + F.col("n"))).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {BASE} SELECT CAST(sum(n) AS BIGINT) AS errors, CAST(1 AS BIGINT) AS exit_code FROM errs")
def exit_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.exit_code(_report(spark, sf_dir))


@query("""SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 3 = 0 THEN 'unverified' WHEN doc_id % 3 = 1 THEN 'verified' ELSE 'mismatch' END AS status FROM documents""")
def integrity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against a manifest that lacks every third and is wrong for another."""
    d = docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), "text", (F.col("doc_id") % 3).alias("k"))
    manifest = d.where("k > 0").select("path", F.when(F.col("k") == 1, F.sha2(F.col("text").cast("binary"), 256)).otherwise("0").alias("sha256"))
    return I.verify(d.select("path", F.col("text").alias("content")), manifest)


@query("""SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, round(sum(value), 2) AS total, count(DISTINCT user_id) AS users,
    round(count(*) / sum(count(*)) OVER (), 4) AS share FROM events GROUP BY event_type""")
def event_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.metrics(table(spark, sf_dir, "events"))


@query("SELECT 'events_' || event_type || ':' || count(*) || '|g' AS line FROM events GROUP BY event_type")
def metrics_statsd(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("value"))
    return S.statsd(n.select(F.concat(F.lit("events_"), "event_type").alias("name"), "value"))


@query("SELECT '# TYPE events_' || event_type || ' gauge' || chr(10) || 'events_' || event_type || ' ' || count(*) AS line FROM events GROUP BY event_type")
def metrics_prometheus(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("value"))
    return S.prometheus(n.select(F.concat(F.lit("events_"), "event_type").alias("name"), "value"))


@query("SELECT count(*) FILTER (event_type = 'click') AS hits, count(*) AS n, round(count(*) FILTER (event_type = 'click') / count(*), 4) AS rate FROM events")
def hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.hit_rate(table(spark, sf_dir, "events"), F.col("event_type") == "click")


@query("""WITH p AS (SELECT doc_id, coalesce(text, '') AS text, instr(coalesce(text, ''), 'the') - 1 AS a FROM documents WHERE contains(text, 'the'))
    SELECT doc_id, a AS start, substr(text, greatest(a - 32, 0) + 1, least(length(text), a + 3 + 32) - greatest(a - 32, 0)) AS context FROM p""")
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surroundings of the first "the"."""
    d = docs(spark, sf_dir).where(F.contains("text", F.lit("the"))).withColumn("start", F.instr("text", "the").cast("bigint") - 1)
    return d.select("doc_id", "start", V.context_window(F.col("text"), F.col("start").cast("int"), (F.col("start") + 3).cast("int")).alias("context"))


@query("""WITH p AS (SELECT doc_id, text, instr(text, 'the') - 1 AS a FROM documents WHERE contains(text, 'the'))
    SELECT doc_id, len(string_split(substr(text, 1, a), chr(10))) AS line, length(list_last(string_split(substr(text, 1, a), chr(10)))) + 1 AS col FROM p""")
def line_and_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).where(F.contains("text", F.lit("the"))).withColumn("a", F.instr("text", "the") - 1)
    line, _ = T.line_and_column(F.col("text"), F.col("a"))
    last = F.length(F.substring_index(F.substring(F.col("text"), F.lit(1), F.col("a")), "\n", -1)) + 1
    return d.select("doc_id", line.cast("bigint").alias("line"), last.cast("bigint").alias("col"))


def _folder(spark: SparkSession) -> str:
    """A fresh folder that the driver and the executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_glyphmill"
    return f"{base.rstrip('/')}/stream_{uuid.uuid4().hex[:12]}"


@query(f"WITH {BASE} SELECT doc_id, CAST(sum(n) AS BIGINT) AS errors FROM errs GROUP BY doc_id")
def stream_misspellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents read as a stream, checked against the static dictionary, written, and counted."""
    folder = _folder(spark)
    dictionary(spark, sf_dir).write.parquet(f"{folder}/words")  # derived once, not for each batch
    stream = ST.read_table(spark, f"{sf_dir}/documents.parquet", docs(spark, sf_dir).schema)
    found = ST.misspellings(stream, spark.read.parquet(f"{folder}/words"))
    ST.drain(found, f"{folder}/out", f"{folder}/state")
    return spark.read.schema(found.schema).parquet(f"{folder}/out").groupBy("doc_id").agg(F.count(F.lit(1)).alias("errors"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def stream_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts by event type with a watermark, the last windows included."""
    folder = _folder(spark)
    stream = ST.read_table(spark, f"{sf_dir}/events.parquet", table(spark, sf_dir, "events").schema)
    return ST.drain_updates(ST.event_windows(stream), f"{folder}/out", f"{folder}/state", ["start", "event_type"])


@query("""WITH e AS (SELECT CAST(s_suppkey AS VARCHAR) AS key, CAST(length(s_name) AS BIGINT) AS size, s_suppkey AS ts FROM supplier),
    k AS (SELECT *, sum(size) OVER (ORDER BY ts DESC, key DESC) AS kept FROM e) SELECT key, size, ts FROM k WHERE kept > 500""")
def eviction_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as cache entries: what goes so that the rest fits."""
    s = table(spark, sf_dir, "supplier")
    return I.eviction(s.select(F.col("s_suppkey").cast("string").alias("key"), F.length("s_name").cast("bigint").alias("size"), F.col("s_suppkey").alias("ts")), 500)
