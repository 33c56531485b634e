"""Similar words by n-grams, block by block, against all pairs."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from glyphmill.functions import strings as S
from glyphmill.operators import suggest as G


def test_ngram_blocks_find_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(G, "QUERY_BLOCK", 30)
    monkeypatch.setattr(G, "WORD_BLOCK", 20)
    monkeypatch.setattr(G, "BLOCK_TASKS", 4)
    draw = random.Random(3)
    made = sorted({"".join(draw.choice("abé'\U0001f600An") for _ in range(draw.randint(1, 9))) for _ in range(160)})
    queries, words = made[::2], made[1::2] + ["aaaaaa", "aaaa"]
    frame = lambda xs, c: spark.createDataFrame([(lang, x) for x in xs for lang in ("en", "de")] + [(None, "aaaaa")], f"lang string, {c} string")
    got = {(r["lang"], r["query"], r["word"]): r["distance"] for r in G.ngram(frame(queries, "query"), frame(words, "word")).collect()}
    bag = lambda x: Counter(x[i : i + 3] for i in range(len(x) - 2))
    pairs = frame(queries, "query").crossJoin(spark.createDataFrame([(w,) for w in words], "word string")).where("lang = 'en'")
    near = pairs.withColumn("sim", S.similarity(F.col("query"), F.col("word"))).where("sim >= 0.7 and query <> word").collect()
    want = {}
    for r in near:
        shared = sum((bag(r["query"]) & bag(r["word"])).values())
        union = sum((bag(r["query"]) | bag(r["word"])).values())
        if shared and shared / union >= 0.3 and (d := int(round((1 - shared / union) * 10, 9))) > 0:
            want |= {(lang, r["query"], r["word"]): d for lang in ("en", "de")}
    assert want and got == want


def test_ngram_makes_no_pairs_in_the_plan(spark):
    """Grams that most words have must not be joined row by row."""
    rows = G.ngram(spark.createDataFrame([("en", "abcd")], "lang string, query string"), spark.createDataFrame([("en", "abce")], "lang string, word string"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" in plan and "gram#" not in plan.replace("ngram#", "")
