"""The rules in one pass over the texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.operators import grammar as G

TEXTS = [
    "", None, " ", "a", "a hour", "An European went.  there parents; THERE is", "its going . ünder the Ünder. ßa? éa! 'tis. _x. 9a. Ⅰⅰ. ªb",
    "I could of, Should Of you; alot ALOT more then less then. between you and I", "he never did nothing. I don't not only but also know no one", "not \U0001f600 without. never nothing",
    "İt is on monday MONDAY Monday march. K a K. ǆ? ŉa", "should of", "should", "no\nno\tno\x0bno\x1cno", "your coming your  coming whose there an apple a apple",
]


def test_one_pass_gives_what_the_columns_give(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    one = G.check(df)
    by_columns = G.check(df, tags=F.array().cast("array<string>"))
    assert dict(one.dtypes)["doc_id"] == "int"
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, by_columns.collect()))
    assert one.count() > 30


def test_texts_are_read_once(spark, sf):
    rows = G.check(spark.read.parquet(f"{sf}/documents.parquet"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
