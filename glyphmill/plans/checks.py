"""Full check results, sources, catalogues, filters and affix dictionaries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import bloom as B
from glyphmill.operators import check as C
from glyphmill.operators import dictionary as D
from glyphmill.operators import spelling as P
from glyphmill.plans.common import BASE, CHECKER_SQL, dictionary, docs, table
from glyphmill.sources import catalog as K
from glyphmill.sources import hunspell as H
from glyphmill.sources import lines as L
from glyphmill.sources import parsers as R

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


#: places(doc_id, lang, pos, original, word): errors with their offsets; top(lang, word, suggestions): three corrections.
_PLACES = f"""
ct AS (SELECT doc_id, lang, regexp_extract_all(coalesce(text, ''), {CHECKER_SQL}) AS t, string_split_regex(coalesce(text, ''), {CHECKER_SQL}) AS g FROM documents),
cu AS (SELECT doc_id, lang, unnest(t) AS token, unnest(g[1:len(t)]) AS gap, unnest(range(len(t))) AS i FROM ct),
cp AS (SELECT doc_id, lang, token, lower(token) AS word,
         CAST(sum(length(gap)) OVER w + sum(length(token)) OVER w - length(token) AS BIGINT) AS pos FROM cu WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
places AS (SELECT doc_id, lang, pos, token AS original, word FROM cp ANTI JOIN dict USING (lang, word)),
asked AS (SELECT DISTINCT lang, word FROM places),
near AS (SELECT a.lang, a.word AS query, d.word, levenshtein(a.word, d.word) AS lev FROM asked a JOIN dict d ON a.lang = d.lang AND abs(length(a.word) - length(d.word)) <= 2 AND a.word <> d.word),
ranked AS (SELECT lang, query, word, row_number() OVER (PARTITION BY lang, query ORDER BY lev, word) AS k FROM near WHERE lev BETWEEN 1 AND 2),
top AS (SELECT lang, query AS word, string_agg(word, ',' ORDER BY k) AS suggestions FROM ranked WHERE k <= 3 GROUP BY lang, query)"""


@query(f"""WITH {BASE}, {_PLACES}, x AS (SELECT p.*, coalesce(top.suggestions, '') AS suggestions FROM places p LEFT JOIN top ON p.lang = top.lang AND p.word = top.word)
    SELECT x.doc_id, pos, original, suggestions, len(string_split(substr(text, 1, pos), chr(10))) AS line, length(list_last(string_split(substr(text, 1, pos), chr(10)))) + 1 AS col,
      substr(text, greatest(pos - 32, 0) + 1, least(length(text), pos + length(original) + 32) - greatest(pos - 32, 0)) AS context
    FROM x JOIN documents d ON x.doc_id = d.doc_id""")
def check_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every error of every document with its place, line, column, surroundings and three best corrections."""
    d = docs(spark, sf_dir)
    found = C.located(C.check(d, dictionary(spark, sf_dir).persist()), d)
    return found.select(
        "doc_id", "pos", "original", F.array_join("suggestions", ",").alias("suggestions"), F.col("line").cast("bigint").alias("line"),
        F.col("column").cast("bigint").alias("col"), "context",
    )


@query()
def report_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text report with a line for each error."""
    d = docs(spark, sf_dir)
    return C.report_lines(d, C.check(d, dictionary(spark, sf_dir).persist())).select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "line")


@query()
def check_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations' turns, each held against the dictionary of the language it is detected to be in."""
    from glyphmill.operators import detect as LD

    turns = LD.detect(table(spark, sf_dir, "conversations")).select(F.struct("conv_id", "turn").alias("doc_id"), F.coalesce("detected", F.lit("en")).alias("lang"), F.lit(0).alias("offset"), "text")
    found = C.check_languages(turns, dictionary(spark, sf_dir).persist())
    return found.select("doc_id.conv_id", "doc_id.turn", "lang", "start", "stop", "original", F.array_join("suggestions", ",").alias("suggestions"), "id")


_HTML = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<(?:script\b.*?</script\s*>|style\b.*?</style\s*>|head\b.*?</head\s*>|noscript\b.*?</noscript\s*>)', ' ', 'g'),
    '(?s)<!--.*?-->', ' ', 'g'), '(?i)</?(p|div|br|li|tr|h[1-6]|section|article|ul|ol|table|blockquote)\b[^>]*>', chr(10), 'g'), '<[^>]*>', ' ', 'g')"""
_ENTITIES = _HTML
for _name, _char in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("apos", "''"), ("amp", "&")):
    _ENTITIES = f"replace({_ENTITIES}, '&{_name};', '{_char}')"


@query(rf"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace({_ENTITIES}, '[^\S\n]+', ' ', 'g'), ' *\n\s*', chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM pages""")
def pages_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", R.parse(F.col("html"), "html").alias("text"))


@query("""WITH n AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS text, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS node FROM documents),
    o AS (SELECT doc_id, node, text, CAST(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY node) - length(text) - 1 AS BIGINT) AS "offset" FROM n)
    SELECT doc_id, node, "offset", text FROM o WHERE trim(text, ' ') <> ''""")
def text_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.text_nodes(docs(spark, sf_dir))


@query("""WITH n AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS text, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS node FROM documents),
    o AS (SELECT doc_id, node, text, CAST(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY node) - length(text) - 1 AS BIGINT) AS a FROM n),
    p AS (SELECT doc_id, CAST(floor(n_chars / 2) AS BIGINT) AS at FROM documents)
    SELECT p.doc_id, p.at, o.node FROM p LEFT JOIN o ON p.doc_id = o.doc_id AND trim(o.text, ' ') <> '' AND p.at >= o.a AND p.at < o.a + length(o.text)""")
def node_of_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line that holds each document's middle character."""
    d = docs(spark, sf_dir)
    return R.node_at(d.select("doc_id", F.floor(F.col("n_chars") / 2).alias("at")), R.text_nodes(d))


@query(f"""WITH {BASE} SELECT DISTINCT lower(word) AS word FROM counts WHERE regexp_matches(word, '^[a-z]{{3,8}}$')""")
def word_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus' words written as a list with comments and blanks, and read again with a pattern."""
    words = D.document_counts(docs(spark, sf_dir)).select(F.col("word").alias("value"))
    noise = spark.createDataFrame([("# a comment",), ("",), ("   ",)], "value string")
    return L.word_list(words.unionByName(noise), pattern="[a-z]{3,8}").distinct()


@query(f"""WITH {BASE}, mine AS (SELECT DISTINCT word FROM errs WHERE word LIKE 'a%')
    SELECT doc_id, word, n FROM errs WHERE word NOT IN (SELECT word FROM mine) AND NOT regexp_matches(word, '^z') AND NOT regexp_matches(word, 'ing$')""")
def ignored_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors without a personal list (what begins with a) and a project's patterns."""
    from glyphmill.operators import results

    errs = results.errors(docs(spark, sf_dir), dictionary(spark, sf_dir)).select("doc_id", "word", "n").persist()
    return L.not_ignored(errs, errs.where(F.col("word").startswith("a")).select("word"), ["^z", "ing$"])


@query(f"""WITH {BASE}, s AS (SELECT word FROM dict WHERE lang = 'en'), m AS (SELECT word FROM s UNION SELECT word || 'x' FROM s WHERE word LIKE 'b%')
    SELECT word FROM m WHERE word NOT LIKE 'c%'""")
def personal_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A personal dictionary with words added, then others removed."""
    words = dictionary(spark, sf_dir).where("lang = 'en'").select("word").persist()
    more = L.personal_add(words, words.where("word like 'b%'").select(F.concat("word", F.lit("x")).alias("word")))
    return L.personal_remove(more, words.where("word like 'c%'"))


_CATALOG = """c AS (SELECT lang || '-' || source AS code, lang AS language, 'fmt' || (doc_id % 3) AS format,
    CASE WHEN doc_id % 2 = 0 THEN 'MIT License' ELSE 'GPL v3' END AS license, n_chars AS word_count FROM documents)"""


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.when(F.col("doc_id") % 2 == 0, "MIT License").otherwise("GPL v3")
    return docs(spark, sf_dir).select(
        F.concat_ws("-", "lang", "source").alias("code"), F.col("lang").alias("language"), F.concat(F.lit("fmt"), (F.col("doc_id") % 3).cast("string")).alias("format"),
        even.alias("license"), F.col("n_chars").alias("word_count"),
    )


@query(f"""WITH {_CATALOG}, s AS (SELECT 'format' AS what, format AS value, word_count FROM c UNION ALL SELECT 'license', string_split(license, ' ')[1], word_count FROM c
    UNION ALL SELECT 'language', language, word_count FROM c UNION ALL SELECT 'all', '', word_count FROM c)
    SELECT what, value, count(*) AS n, CAST(sum(word_count) AS BIGINT) AS words FROM s GROUP BY what, value""")
def catalog_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as entries of a catalogue."""
    return K.statistics(_catalog(spark, sf_dir))


@query(f"""WITH {_CATALOG} SELECT code, format, word_count FROM c WHERE lower(language) = 'de' AND lower(format) = 'fmt1' AND contains(lower(license), 'gpl')""")
def catalog_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.by_license(K.find(_catalog(spark, sf_dir), language="DE", format="fmt1"), "gpl").select("code", "format", "word_count")


@query("""WITH a AS (SELECT DISTINCT lang || '-' || source AS code FROM documents UNION SELECT DISTINCT source FROM documents UNION SELECT DISTINCT lang FROM documents), k AS (SELECT DISTINCT lang AS code FROM documents)
    SELECT a.code, CASE WHEN a.code IN (SELECT code FROM k) THEN a.code WHEN string_split(a.code, '-')[1] IN (SELECT code FROM k) THEN string_split(a.code, '-')[1] ELSE 'en' END AS found,
      CASE WHEN a.code IN (SELECT code FROM k) THEN 'exact' WHEN string_split(a.code, '-')[1] IN (SELECT code FROM k) THEN 'base' ELSE 'fallback' END AS note FROM a""")
def language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes with a region, without one, and unknown ones, resolved against the documents' languages."""
    d = docs(spark, sf_dir)
    asked = d.select(F.concat_ws("-", "lang", "source").alias("code")).union(d.select("source")).union(d.select("lang"))
    return K.resolve_code(asked, d.select(F.col("lang").alias("code")))


@query(f"""WITH {BASE} SELECT count(DISTINCT word) AS asked, count(DISTINCT word) AS found FROM dict""")
def bloom_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter of the dictionary has every word of it."""
    words = dictionary(spark, sf_dir).select("word").distinct().persist()
    shape = B.Shape.of(max(1, words.count()))
    half = words.where(F.length("word") % 2 == 0)
    bloom = B.union(B.build(half, "word", shape), B.build(words.where(F.length("word") % 2 == 1), "word", shape))
    return B.probe(words, "word", bloom, shape).agg(F.count(F.lit(1)).alias("asked"), F.count_if("maybe").alias("found"))


# --- affix dictionaries ---------------------------------------------------------------------------------------------------

RULES = "SFX S Y 2\nSFX S 0 s [^sxy]\nSFX S y ies [^aeiou]y\nPFX U Y 1\nPFX U 0 un [aeiou]\n"


@query(f"""WITH {BASE}, d AS (SELECT word FROM dict WHERE lang = 'en'),
    s AS (SELECT word AS stem, 's' AS tail, 0 AS cut FROM d WHERE regexp_matches(word, '[^sxy]$') UNION ALL SELECT word, 'ies', 1 FROM d WHERE regexp_matches(word, '[^aeiou]y$')),
    f AS (SELECT word AS stem, word AS form FROM d UNION SELECT stem, left(stem, length(stem) - cut) || tail FROM s
          UNION SELECT word, 'un' || word FROM d WHERE regexp_matches(word, '^[aeiou]')
          UNION SELECT stem, 'un' || left(stem, length(stem) - cut) || tail FROM s WHERE regexp_matches(stem, '^[aeiou]'))
    SELECT stem, form FROM f""")
def affix_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every form of the English dictionary's words under plural and negation rules."""
    _, rules = H.read_aff(spark, RULES)
    stems = dictionary(spark, sf_dir).where("lang = 'en'").select(F.col("word").alias("stem"), F.array(F.lit("S"), F.lit("U")).alias("flags"))
    return P.expand(stems, rules)


def _part_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")).distinct()


_PART_WORDS = "w AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS word FROM part)"


@query(f"""WITH {_PART_WORDS}, k AS (SELECT word FROM w WHERE length(word) % 2 = 0), a AS (SELECT DISTINCT lower(replace(p_name, ' ', '-')) AS word FROM part)
    SELECT word, bool_and(p IN (SELECT word FROM k)) AS correct FROM (SELECT word, unnest(string_split(word, '-')) AS p FROM a) GROUP BY word""")
def break_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' names joined by hyphens, against a dictionary of the names' words of even length."""
    stems = [r["word"] for r in _part_words(spark, sf_dir).where(F.length("word") % 2 == 0).collect()]  # a colour list
    asked = table(spark, sf_dir, "part").select(F.replace(F.lower("p_name"), F.lit(" "), F.lit("-")).alias("word"))
    return P.lookup(asked, P.Dictionary("", stems))


@query(f"""WITH {_PART_WORDS}, a AS (SELECT DISTINCT string_split(lower(p_name), ' ')[1] || string_split(lower(p_name), ' ')[-1] AS word FROM part),
    c AS (SELECT DISTINCT x.word || y.word AS word FROM w x JOIN w y ON length(x.word) >= 3 AND length(y.word) >= 3 AND length(x.word) % 2 = 0)
    SELECT word, word IN (SELECT word FROM c) OR word IN (SELECT word FROM w) AS correct FROM a""")
def compound_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last words of parts' names written as one, where compounds begin with a word of even length."""
    words = [r["word"] for r in _part_words(spark, sf_dir).collect()]  # a colour list
    aff = "COMPOUNDMIN 3\nCOMPOUNDWORDMAX 1\nCOMPOUNDBEGIN B\nCOMPOUNDEND E\n"
    lines = [f"{w}/{'BE' if len(w) % 2 == 0 else 'E'}" for w in words]
    name = F.split(F.lower("p_name"), " ")
    asked = table(spark, sf_dir, "part").select(F.concat(F.element_at(name, 1), F.element_at(name, -1)).alias("word"))
    return P.lookup(asked, P.Dictionary(aff, lines))


@query()
def hunspell_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of parts' names, each with its first two letters swapped, corrected by a dictionary of the right ones."""
    words = _part_words(spark, sf_dir)
    lines = [r["word"] for r in words.collect()]  # a colour list
    asked = words.select(F.concat(F.substring("word", 2, 1), F.substring("word", 1, 1), F.expr("substring(word, 3)")).alias("word"))
    return P.corrections(asked, P.Dictionary("TRY esianrtolcdugmphbyfvkwz\nMAXNGRAMSUGS 2\n", lines), 5)
