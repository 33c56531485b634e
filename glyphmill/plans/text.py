"""Checking texts against a dictionary, and dictionaries as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import strings as S
from glyphmill.functions import tokens as T
from glyphmill.operators import dictionary as D
from glyphmill.operators import results as R
from glyphmill.plans.common import BASE, CHECKER_SQL, WS, dictionary, docs, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


@query(f"WITH {BASE} SELECT doc_id, CAST(sum(n) AS BIGINT) AS errors, count(*) AS unique_errors, max(quality) AS quality "
       "FROM errs LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id) GROUP BY doc_id")
def doc_error_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling errors of each document next to its quality label."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return R.per_document(docs(spark, sf_dir), dictionary(spark, sf_dir)).join(labels, "doc_id", "left")


@query(f"""WITH {BASE} SELECT d.doc_id, d.lang, len(regexp_extract_all(coalesce(d.text, ''), {CHECKER_SQL})) AS words,
    CAST(coalesce(sum(n), 0) AS BIGINT) AS errors, count(e.word) AS unique_errors, count(e.word) = 0 AS success
    FROM documents d LEFT JOIN errs e USING (doc_id) GROUP BY d.doc_id, d.lang, d.text""")
def doc_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.documents_report(docs(spark, sf_dir), dictionary(spark, sf_dir))


@query(f"""WITH {BASE}, r AS (SELECT d.doc_id, d.lang, len(regexp_extract_all(coalesce(d.text, ''), {CHECKER_SQL})) AS words,
    coalesce(sum(n), 0) AS errors FROM documents d LEFT JOIN errs e USING (doc_id) GROUP BY d.doc_id, d.lang, d.text)
    SELECT lang, count(*) AS docs, CAST(sum(words) AS BIGINT) AS words, CAST(sum(errors) AS BIGINT) AS errors,
    count(*) FILTER (errors = 0) AS clean FROM r GROUP BY lang""")
def merged_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.merged(R.documents_report(docs(spark, sf_dir), dictionary(spark, sf_dir)))


@query(f"WITH {BASE} SELECT lang, word, CAST(sum(n) AS BIGINT) AS n, count(*) AS docs FROM errs GROUP BY lang, word")
def error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.summary(R.errors(docs(spark, sf_dir), dictionary(spark, sf_dir)))


@query(f"""WITH {BASE}, s AS (SELECT lang, word, CAST(sum(n) AS BIGINT) AS n FROM errs GROUP BY lang, word)
    SELECT lang, word, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS rank FROM s QUALIFY rank <= 10""")
def top_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top(R.errors(docs(spark, sf_dir), dictionary(spark, sf_dir)))


@query(f"WITH {BASE} SELECT doc_id, lang, word, n FROM errs")
def unique_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.errors(docs(spark, sf_dir), dictionary(spark, sf_dir))


@query(f"WITH {BASE} SELECT doc_id, CAST(sum(n) AS BIGINT) AS known FROM dw SEMI JOIN dict USING (lang, word) GROUP BY doc_id")
def known_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.membership(R.word_rows(docs(spark, sf_dir)), dictionary(spark, sf_dir), ["lang", "word"], known=True)
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("known"))


@query(f"""WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {CHECKER_SQL}) AS t, string_split_regex(coalesce(text, ''), {CHECKER_SQL}) AS g FROM documents),
    u AS (SELECT doc_id, unnest(t) AS token, unnest(g[1:len(t)]) AS gap, unnest(range(len(t))) AS i FROM t)
    SELECT doc_id, CAST(i AS INTEGER) AS idx, token,
      CAST(sum(length(gap)) OVER (PARTITION BY doc_id ORDER BY i) + coalesce(sum(length(token)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS pos,
      CAST(length(token) AS INTEGER) AS len FROM u""")
def token_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.token_table(docs(spark, sf_dir), "checker")


@query(f"WITH {WS} SELECT doc_id, count(*) AS tokens, CAST(sum(pos) AS BIGINT) AS pos_sum, max(pos) AS last_pos FROM ws GROUP BY doc_id")
def whitespace_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.token_table(docs(spark, sf_dir), "whitespace")
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("tokens"), F.sum("pos").alias("pos_sum"), F.max("pos").cast("bigint").alias("last_pos"))


@query(f"""SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '{T.MULTI}')) AS multi,
    len(regexp_extract_all(coalesce(text, ''), '{T.SEMANTIC.replace("'", "''")}')) AS semantic FROM documents""".replace("['’-]", "[''’-]"))
def tokenizer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    return d.select("doc_id", *[F.size(T.tokens(F.col("text"), k)).cast("bigint").alias(k) for k in ("multi", "semantic")])


@query()
def language_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document by its own language's tokeniser."""
    out = T.latin(F.col("text"))
    for lang, fn in T.BY_LANGUAGE.items():
        out = F.when(F.col("lang") == lang, fn(F.col("text"))).otherwise(out)
    return docs(spark, sf_dir).select("doc_id", "lang", F.size(out).cast("bigint").alias("tokens"))


@query(f"""WITH {BASE} SELECT lang, count(*) AS total, count(DISTINCT word) AS uniq, min(length(word)) AS min_len, max(length(word)) AS max_len,
    round(avg(length(word)), 2) AS avg_len FROM dict GROUP BY lang""")
def dictionary_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.statistics(dictionary(spark, sf_dir))


@query(f"WITH {BASE} SELECT length(word) AS len, count(*) AS n FROM dict GROUP BY 1")
def count_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.by_length(dictionary(spark, sf_dir))


@query(f"WITH {BASE} SELECT upper(word[1]) AS letter, count(*) AS n FROM dict GROUP BY 1")
def count_by_first_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.by_first_letter(dictionary(spark, sf_dir))


@query(f"WITH {BASE} SELECT lang, word FROM dict WHERE starts_with(word, 'th') AND length(word) > 2")
def prefix_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.with_prefix(dictionary(spark, sf_dir), "th")


@query(f"WITH {BASE} SELECT lang, word FROM dict WHERE suffix(word, 'ing') AND length(word) > 3")
def suffix_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.with_suffix(dictionary(spark, sf_dir), "ing")


@query(f"WITH {BASE} SELECT lang, count(*) AS n FROM dict WHERE starts_with(word, 'th') GROUP BY lang")
def prefix_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.with_prefix(dictionary(spark, sf_dir), "th", proper=False).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {BASE} SELECT lang, word FROM dict WHERE length(word) BETWEEN 4 AND 6")
def length_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.of_length(dictionary(spark, sf_dir), 4, 6)


@query(f"WITH {BASE} SELECT lang, word FROM dict WHERE regexp_matches(word, '^[aeiou].*[st]$')")
def pattern_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.matching(dictionary(spark, sf_dir), "^[aeiou].*[st]$")


def _of(spark: SparkSession, sf_dir: str, lang: str) -> DataFrame:
    return dictionary(spark, sf_dir).where(F.col("lang") == lang).select("word")


for _name, _op, _sql in (
    ("set_union", D.merge, "UNION"), ("set_intersect", D.intersection, "INTERSECT"), ("set_except", D.difference, "EXCEPT"),
):
    QUERIES[_name] = lambda spark, sf_dir, op=_op: op(_of(spark, sf_dir, "en"), _of(spark, sf_dir, "fr"))
    ORACLE_SQL[_name] = f"WITH {BASE} SELECT word FROM dict WHERE lang = 'en' {_sql} SELECT word FROM dict WHERE lang = 'fr'"


@query(f"""WITH {BASE} (SELECT lang, word FROM dict UNION SELECT 'en', 'zyx') EXCEPT SELECT lang, word FROM dict WHERE length(word) <= 2""")
def add_and_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = dictionary(spark, sf_dir)
    grown = D.add(own, spark.createDataFrame([("en", "zyx")], "lang string, word string"))
    return D.remove(grown, own.where("length(word) <= 2"))


@query(f"""WITH {BASE} SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY docs DESC, word) AS rank,
    CAST(CASE WHEN rank <= 50 THEN 200 WHEN rank <= 200 THEN 100 ELSE 50 END AS BIGINT) AS bonus FROM counts QUALIFY rank <= 1000""")
def frequency_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.tiers(D.document_counts(docs(spark, sf_dir)))


@query(r"""SELECT doc_id, md5(lower(regexp_replace(trim(text), '\s+', ' ', 'g'))) AS plain,
    md5(trim(regexp_replace(lower(regexp_replace(trim(text), '\s+', ' ', 'g')), '[^\p{L}\p{N}\s]', '', 'g'))) AS bare FROM documents""")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", F.md5(S.normalise(t).cast("binary")).alias("plain"), F.md5(S.normalise(t, True).cast("binary")).alias("bare"))


_TOKENS = f"SELECT DISTINCT unnest(regexp_extract_all(coalesce(text, ''), {CHECKER_SQL})) AS token FROM documents"


@query(f"""WITH t AS ({_TOKENS}) SELECT token, CASE WHEN lower(token) = token THEN 'NO' WHEN upper(token) = token THEN 'ALL'
    WHEN upper(token[1]) = token[1] AND lower(token[2:]) = token[2:] THEN 'INIT' WHEN upper(token[1]) = token[1] THEN 'HUHINIT' ELSE 'HUH' END AS kind FROM t""")
def capitalization_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = docs(spark, sf_dir).select(F.explode(T.tokens(F.col("text"))).alias("token")).distinct()
    return t.select("token", S.capitalisation(F.col("token")).alias("kind"))


_TITLE = "upper(low[1]) || low[2:]"


@query(f"""WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(coalesce(text, ''), {CHECKER_SQL})) AS token FROM documents),
    k AS (SELECT token, lower(token) AS low, CASE WHEN lower(token) = token THEN 'NO' WHEN upper(token) = token THEN 'ALL'
      WHEN upper(token[1]) = token[1] THEN CASE WHEN lower(token[2:]) = token[2:] THEN 'INIT' ELSE 'HUHINIT' END ELSE 'HUH' END AS kind FROM t),
    v AS (SELECT *, {_TITLE} AS title, lower(token[1]) || token[2:] AS small FROM k)
    SELECT token,
      token || CASE WHEN kind IN ('INIT', 'ALL') AND low <> token THEN ' ' || low ELSE '' END || CASE WHEN kind = 'ALL' AND title <> token AND title <> low THEN ' ' || title ELSE '' END
        || CASE WHEN kind = 'HUHINIT' AND small <> token THEN ' ' || small ELSE '' END AS variants,
      token || CASE WHEN kind = 'HUHINIT' AND small <> token THEN ' ' || small ELSE '' END
        || CASE WHEN kind IN ('INIT', 'ALL', 'HUH') AND low <> token OR kind = 'HUHINIT' AND low <> token AND low <> small THEN ' ' || low ELSE '' END
        || CASE WHEN kind IN ('ALL', 'HUHINIT') AND title <> token AND title <> low AND (kind = 'ALL' OR title <> small) THEN ' ' || title ELSE '' END AS corrections,
      CASE WHEN kind IN ('INIT', 'HUHINIT') THEN title WHEN kind = 'ALL' THEN upper(low) ELSE low END AS coerced FROM v""")
def case_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = docs(spark, sf_dir).select(F.explode(T.tokens(F.col("text"))).alias("token")).distinct()
    w = F.col("token")
    return t.select(
        "token", F.array_join(S.case_variants(w), " ").alias("variants"), F.array_join(S.case_corrections(w), " ").alias("corrections"),
        S.coerce(F.lower(w), S.capitalisation(w)).alias("coerced"),
    )


@query(f"""WITH t AS (SELECT DISTINCT lower(token) AS word FROM ({_TOKENS})) SELECT word, substr(sha256(word), 1, 16) AS id FROM t""")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = docs(spark, sf_dir).select(F.explode(T.tokens(F.col("text"))).alias("token")).select(F.lower("token").alias("word")).distinct()
    return t.select("word", S.short_id(F.col("word")).alias("id"))


@query(r"""SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[0-9]+(\.[0-9]+)?')) AS numbers FROM documents""")
def number_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.size(T.all_matches(F.col("text"), r"[0-9]+(\.[0-9]+)?")).cast("bigint").alias("numbers"))
