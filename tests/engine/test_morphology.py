"""Affix dictionaries on a small hand-made pair of files."""

from __future__ import annotations

from glyphmill.operators import morphology as M
from glyphmill.sources import hunspell as H

AFF = """FORBIDDENWORD !
NEEDAFFIX ~
KEEPCASE K
PFX A Y 1
PFX A 0 re .
SFX B Y 2
SFX B y ied [^aeiou]y
SFX B 0 ed [^ey]
SFX C N 1
SFX C 0 able/D .
SFX D Y 1
SFX D 0 s .
"""
DIC = ["7", "work/ABC", "try/B", "well", "well-known", "bad/!", "foo/~B", "iPod/K", "a\\/b", "sing/B po:verb"]
RIGHT = ["work", "worked", "rework", "reworked", "workable", "workables", "tried", "Work", "WORKED", "well-known", "well-work", "well-known-work", "12", "3.5", "fooed", "iPod", "a/b", "singed", ""]
WRONG = ["works", "reworkable", "tryed", "trys", "bad", "foo", "IPOD", "wOrk", "retry", "well-xx", "known", "7x"]


def test_words_against_affix_rules(spark):
    options, rules = H.read_aff(spark, AFF)
    stems = H.read_dic(spark.createDataFrame([(x,) for x in DIC], "value string"), options)
    entries = {r["stem"]: r for r in stems.collect()}
    assert len(entries) == 9 and entries["sing"]["morph"] == ["po:verb"] and entries["work"]["flags"] == ["A", "B", "C"]
    asked = spark.createDataFrame([(w,) for w in [*RIGHT, *WRONG, None, "work"]], "word string")
    got = {r["word"]: r["correct"] for r in M.check(asked, stems, rules, options).collect()}
    assert got == {**dict.fromkeys(RIGHT, True), **dict.fromkeys(WRONG, False)}


def test_flag_formats_and_empty_tables(spark):
    assert H.split_flags("AaBb", "long") == ["Aa", "Bb"] and H.split_flags("12,7", "num") == ["12", "7"]
    assert H.split_flags("2", "short", [["x"], ["y", "z"]]) == ["y", "z"]
    options, rules = H.read_aff(spark, "")
    stems = H.read_dic(spark.createDataFrame([], "value string"), options)
    assert M.check(spark.createDataFrame([("x",)], "word string"), stems, rules, options).first()["correct"] is False
