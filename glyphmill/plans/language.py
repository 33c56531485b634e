"""Language detection, segmentation and grammar."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.operators import detect as L
from glyphmill.operators import grammar as G
from glyphmill.plans.common import WS, docs, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def _score_sql(text: str) -> str:
    """SQL for the struct of all scores of a text."""
    parts = []
    for lang, pattern, least, scripts, _ in L.RULES:
        ratio = f"(len(regexp_extract_all({text}, '{pattern}')) / length({text}))"
        bonus = "(1.0" + "".join(f" + CASE WHEN regexp_matches({text}, '{s}') THEN 0.1 ELSE 0.0 END" for s in scripts) + ")::DOUBLE"
        ok = f"{ratio} >= {least}"
        if lang == "ja":
            ok += f" AND regexp_matches({text}, '[\\x{{3040}}-\\x{{309F}}]')"
        if lang == "en":
            ok += f" AND len(regexp_extract_all({text}, '[à-ÿ]')) / length({text}) <= 0.02"
        more = "" if lang == "en" else f" * (1 + {ratio})"
        parts.append(f"CASE WHEN length({text}) > 0 AND {ok} THEN least({ratio} * {bonus}{more}, 1.0)::DOUBLE ELSE 0.0::DOUBLE END AS {lang}")
    return ", ".join(parts)


_SCORES = f"SELECT doc_id, lang, {_score_sql('text')} FROM (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents)"
_LONG = "SELECT doc_id, lang, code, score, CASE WHEN code IN ('fr', 'es', 'de') THEN 1 ELSE 0 END AS prio FROM (UNPIVOT ({s}) ON ru, ja, pt, fr, es, de, en INTO NAME code VALUE score) WHERE score > 0"


@query(f"SELECT doc_id, lang, round(ru, 6) AS ru, round(ja, 6) AS ja, round(pt, 6) AS pt, round(fr, 6) AS fr, round(es, 6) AS es, round(de, 6) AS de, round(en, 6) AS en FROM ({_SCORES})")
def lang_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce(F.col("text"), F.lit(""))
    return docs(spark, sf_dir).select("doc_id", "lang", *[F.round(L.score(t, r[0]), 6).alias(r[0]) for r in L.RULES])


@query(f"""WITH s AS ({_LONG.format(s=_SCORES)}), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, prio DESC, code DESC) AS n FROM s),
    p AS (SELECT doc_id, max(code) FILTER (n = 1) AS detected, max(score) FILTER (n = 1) AS a, max(score) FILTER (n = 2) AS b FROM r GROUP BY doc_id)
    SELECT d.doc_id, d.lang, detected, round(CASE WHEN a IS NULL THEN 0.0 WHEN b IS NULL THEN 1.0 ELSE least(1.0, a / (a + b) * 0.8 + 0.2) END, 6)::DOUBLE AS confidence
    FROM documents d LEFT JOIN p USING (doc_id)""")
def lang_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.detect(docs(spark, sf_dir)).select("doc_id", "lang", "detected", F.round("confidence", 6).alias("confidence"))


@query(f"""WITH s AS ({_LONG.format(s=_SCORES)}), r AS (SELECT doc_id, code, score / sum(score) OVER (PARTITION BY doc_id) AS share,
    row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, prio DESC, code DESC) AS rank FROM s)
    SELECT doc_id, code, round(share, 6) AS share, rank FROM r WHERE rank <= 3""")
def lang_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = L.candidates(docs(spark, sf_dir), 3)
    return out.select("doc_id", "code", F.round("share", 6).alias("share"), F.col("rank").cast("bigint").alias("rank"))


@query(f"""WITH s AS ({_LONG.format(s=_SCORES)}), t AS (SELECT doc_id, lang, code, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, prio DESC, code DESC) AS n FROM s)
    SELECT lang, code AS detected, count(*) AS n FROM t WHERE n = 1 GROUP BY ALL""")
def lang_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.detect(docs(spark, sf_dir)).where("detected is not null").groupBy("lang", "detected").agg(F.count(F.lit(1)).alias("n"))


_TURNS = f"SELECT conv_id, turn, raw, {_score_sql('text')} FROM (SELECT conv_id, turn, text AS raw, coalesce(text, '') AS text FROM conversations)"
_TURN_LONG = _LONG.format(s=_TURNS).replace("doc_id, lang", "conv_id, turn, raw")


@query(f"""WITH s AS ({_TURN_LONG}), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, prio DESC, code DESC) AS n FROM s),
    p AS (SELECT conv_id, turn, max(code) FILTER (n = 1) AS code, max(score) FILTER (n = 1) AS a, max(score) FILTER (n = 2) AS b FROM r GROUP BY ALL),
    c AS (SELECT v.conv_id, v.turn, CASE WHEN length(trim(coalesce(v.text, ''))) < 3 OR code IS NULL OR (b IS NOT NULL AND a / (a + b) * 0.8 + 0.2 < 0.3) THEN 'en' ELSE code END AS code
          FROM conversations v LEFT JOIN p ON v.conv_id = p.conv_id AND v.turn = p.turn),
    m AS (SELECT *, CASE WHEN lag(code) OVER w IS NOT DISTINCT FROM code THEN 0 ELSE 1 END AS s FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    g AS (SELECT *, CAST(sum(s) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS segment FROM m)
    SELECT conv_id, segment, code, min(turn) AS first, max(turn) AS last, count(*) AS nodes FROM g GROUP BY ALL""")
def lang_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.segments(table(spark, sf_dir, "conversations")).drop("confidence")


def _rules(*ids: str) -> tuple[G.Rule, ...]:
    return tuple(r for r in G.ENGLISH if r.id in ids)


def _run(spark: SparkSession, sf_dir: str, *ids: str) -> DataFrame:
    return G.check(docs(spark, sf_dir), _rules(*ids))


_NEXT = "nx AS (SELECT *, lead(token) OVER (PARTITION BY doc_id ORDER BY i) AS nxt, lag(token) OVER (PARTITION BY doc_id ORDER BY i) AS prv FROM ws)"
_CONS, _VOW = (", ".join(f"'{w}'" for w in x) for x in (G.CONSONANT_SOUND, G.VOWEL_SOUND))


@query(f"""WITH {WS}, {_NEXT}, e AS (SELECT *, CASE WHEN lower(nxt) IN ({_CONS}) THEN 'a' WHEN lower(nxt) IN ({_VOW}) THEN 'an'
      WHEN lower(nxt[1]) IN ('a', 'e', 'i', 'o', 'u') THEN 'an' ELSE 'a' END AS want FROM nx WHERE lower(token) IN ('a', 'an') AND nxt IS NOT NULL)
    SELECT doc_id, 'EN_A_VS_AN' AS rule_id, pos, token || ' ' || nxt AS context, want AS suggestion, 'Use "' || want || '" before "' || nxt || '"' AS message
    FROM e WHERE lower(token) <> want""")
def grammar_a_an(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, "EN_A_VS_AN")


_IN = lambda words: ", ".join(f"'{w}'" for w in words)


@query(f"""WITH {WS}, {_NEXT} SELECT doc_id, 'EN_THERE_THEIR' AS rule_id, pos, '"' || token || ' ' || nxt || '"' AS context, 'their' AS suggestion, 'Did you mean "their"?' AS message
    FROM nx WHERE lower(token) = 'there' AND lower(nxt) IN ({_IN(G.POSSESSED)}) AND lower(nxt) NOT IN ({_IN(G.LOCATION_VERBS)})""")
def grammar_there_their(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, "EN_THERE_THEIR")


@query(f"WITH {WS}, {_NEXT} " + " UNION ALL ".join(
    f"""SELECT doc_id, '{k}' AS rule_id, pos, '"' || token || ' ' || nxt || '"' AS context, '{b.replace("'", "''")}' AS suggestion, 'Did you mean "{b.replace("'", "''")}"?' AS message
    FROM nx WHERE lower(token) = '{a}' AND lower(nxt) IN ({_IN(w.split())})""" for k, (a, b, _, w) in G.CONTRACTIONS.items()))
def grammar_possessive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, *G.CONTRACTIONS)


def _phrase_sql(rule: str, wrong: str, right: str) -> str:
    words = wrong.split()
    tests = " AND ".join(f"lower(t[{k + 1}]) = '{w}'" for k, w in enumerate(words))
    quoted = right.replace("'", "''")
    return (
        f"SELECT doc_id, '{rule}' AS rule_id, pos, array_to_string(t[1:{len(words)}], ' ') AS context, '{quoted}' AS suggestion, "
        f"'\"{wrong}\" should be \"{quoted}\"' AS message FROM ph WHERE len(t) >= {len(words)} AND {tests}"
    )


@query(f"WITH {WS}, ph AS (SELECT doc_id, pos, list(token) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS t FROM ws) "
       + " UNION ALL ".join(_phrase_sql(k, a, b) for k, (a, b) in G.PHRASES.items()))
def grammar_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, *G.PHRASES)


@query(f"""WITH {WS}, n AS (SELECT *, lead(pos) OVER w AS pos2, lead(i) OVER w AS i2 FROM ws
      WHERE lower(token) IN ({_IN(G.NEGATIVES)}) OR suffix(lower(token), 'n''t') WINDOW w AS (PARTITION BY doc_id ORDER BY i))
    SELECT n.doc_id, 'EN_DOUBLE_NEGATIVE' AS rule_id, n.pos, string_agg(s.token, ' ' ORDER BY s.i) AS context,
      'Consider using a single negative' AS suggestion, 'Double negative detected - consider rephrasing' AS message
    FROM n JOIN ws s ON s.doc_id = n.doc_id AND s.i BETWEEN n.i AND n.i2 WHERE n.pos2 - n.pos <= 15 GROUP BY n.doc_id, n.pos""")
def grammar_double_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, "EN_DOUBLE_NEGATIVE")


@query(f"""WITH {WS}, {_NEXT} SELECT doc_id, 'EN_SENTENCE_START_CAP' AS rule_id, pos, '"' || token || '"' AS context,
    CASE WHEN regexp_matches(token, '^[A-Za-z0-9_]') THEN upper(token[1]) || token[2:] ELSE token END AS suggestion, 'Sentences should start with a capital letter' AS message
    FROM nx WHERE (prv IS NULL OR right(prv, 1) IN ('.', '!', '?')) AND regexp_matches(token, '^\\p{{L}}') AND lower(token[1]) = token[1] AND upper(token[1]) <> token[1]""")
def grammar_sentence_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, "EN_SENTENCE_START_CAP")


@query(f"""WITH {WS}, c(low, good) AS (VALUES {", ".join(f"('{w.lower()}', '{w}')" for w in G.PROPER)})
    SELECT doc_id, 'EN_PROPER_NOUN_CAP' AS rule_id, pos, '"' || token || '"' AS context, good AS suggestion, 'Proper nouns should be capitalized' AS message
    FROM ws JOIN c ON lower(token) = low WHERE token <> good""")
def grammar_word_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, "EN_PROPER_NOUN_CAP")


_EACH = ("grammar_a_an", "grammar_there_their", "grammar_possessive", "grammar_phrase", "grammar_double_negative", "grammar_sentence_start", "grammar_word_list")
_ALL = " UNION ALL ".join(f"SELECT doc_id, rule_id, pos, context, suggestion FROM ({ORACLE_SQL[k]})" for k in _EACH)


@query(f"SELECT doc_id, rule_id, count(*) AS n FROM ({_ALL}) GROUP BY doc_id, rule_id")
def grammar_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All English rules by document and rule."""
    return G.check(docs(spark, sf_dir)).groupBy("doc_id", "rule_id").agg(F.count(F.lit(1)).alias("n"))


#: What every rule finds something in; put behind each text, as the corpus has few such places.
SLIPS = (
    ". there parents were there is . its going , its tail , your coming , whose there . I could of , should of , would of , must of , might of , in regards to , "
    "an advise , suppose to , use to , more then , less then , rather then , other then , could care less , for free , alot , to much , to many , as follow , "
    "between you and I , apart of , inspite , alright . on monday in English or french . he never did nothing , an car and a hour and a European ."
)
_SLIPPED = _ALL.replace("FROM documents", "FROM slipped")


@query(f"WITH slipped AS (SELECT doc_id, lang, coalesce(text, '') || '{SLIPS}' AS text FROM documents) SELECT doc_id, rule_id, pos, context, suggestion FROM ({_SLIPPED})")
def grammar_slips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule over texts that break it."""
    d = docs(spark, sf_dir).withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(SLIPS)))
    return G.check(d).select("doc_id", "rule_id", "pos", "context", "suggestion")


@query()
def grammar_other_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    of = lambda lang: d.where(F.col("lang") == lang)
    rows = G.german_nouns(of("de")).unionByName(G.french_negation(of("fr"))).unionByName(G.spanish_marks(of("es")))
    return rows.unionByName(G.portuguese_crase(of("pt"))).groupBy("doc_id", "rule_id").agg(F.count(F.lit(1)).alias("n"))
