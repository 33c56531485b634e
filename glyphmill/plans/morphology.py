"""Words of the English documents against an affix dictionary: the derived words as stems, with two plural rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.operators import dictionary as D
from glyphmill.operators import morphology as M
from glyphmill.plans.common import BASE, dictionary, docs
from glyphmill.sources import hunspell as H

RULES = "SFX S Y 2\nSFX S 0 s [^sxy]\nSFX S y ies [^aeiou]y\n"


def hunspell_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    options, rules = H.read_aff(spark, RULES)
    lines = dictionary(spark, sf_dir).where("lang = 'en'").select(F.concat("word", F.lit("/S")).alias("value"))
    words = D.document_counts(docs(spark, sf_dir)).where("lang = 'en'").select("word")
    return M.check(words, H.read_dic(lines, options), rules, options)


QUERIES = {"hunspell_check": hunspell_check}
ORACLE_SQL = {
    "hunspell_check": f"""WITH {BASE}, d AS (SELECT word FROM dict WHERE lang = 'en'),
    f AS (SELECT word FROM d UNION SELECT word || 's' FROM d WHERE regexp_matches(word, '[^sxy]$')
          UNION SELECT word[:-2] || 'ies' FROM d WHERE regexp_matches(word, '[^aeiou]y$'))
    SELECT word, word IN (SELECT word FROM f) AS correct FROM counts WHERE lang = 'en'"""
}
