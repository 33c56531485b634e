"""Suggestions, ranking, grammar, detection and vectors on small cases, and blocking against full comparison."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from glyphmill.functions import metrics as M
from glyphmill.operators import detect as L
from glyphmill.operators import dictionary as D
from glyphmill.operators import grammar as G
from glyphmill.operators import integrity as I
from glyphmill.operators import rank as R
from glyphmill.operators import suggest as Q
from glyphmill.operators import vectors as V

WORDS = "the hello help held hero world word work cat cart card their there receive believe letter better butter phone fone night".split()


def _dict(spark, words=WORDS):
    return spark.createDataFrame([("en", w) for w in words], "lang string, word string")


def _ask(spark, *queries):
    return spark.createDataFrame([("en", q) for q in queries], "lang string, query string")


def test_blocking_loses_no_pair_within_two_edits(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(1, 7)))
    words, queries = sorted({word() for _ in range(120)}), sorted({word() for _ in range(60)})
    got = {(r["query"], r["word"]) for r in Q.edit_candidates(_ask(spark, *queries), _dict(spark, words), 2).collect()}
    want = {(q, w) for q in queries for w in words if q != w and M.osa(q, w) <= 2}
    assert want <= got


def test_edit_distance_prefers_likely_typos(spark):
    out = R.top(Q.edit_distance(_ask(spark, "teh", "helo", "wrold"), _dict(spark)), 3).collect()
    best = {r["query"]: r["word"] for r in out if r["rank"] == 1}
    assert best == {"teh": "the", "helo": "hello", "wrold": "world"}


def test_other_strategies(spark):
    d = _dict(spark)
    words = lambda df: {(r["query"], r["word"]) for r in df.collect()}
    assert ("thier", "their") in words(Q.phonetic(_ask(spark, "thier"), d))
    assert ("lettre", "letter") in words(Q.ngram(_ask(spark, "lettre"), d, least=0.2))
    assert {("helo", "hello"), ("helo", "help")} <= words(Q.symspell(_ask(spark, "helo"), d))
    assert ("bettwt", "better") in words(Q.keyboard(_ask(spark, "bettwt"), d))
    assert ("recieve", "receive") in words(Q.language_edits(_ask(spark, "recieve"), d))
    assert ("hell", "hello") in words(Q.quick(_ask(spark, "hell"), d))
    assert ("car", "cart") in words(Q.trie_suggest(_ask(spark, "car"), d))
    out = Q.generate(_ask(spark, "helo", "hello"), d).collect()
    assert {r["query"] for r in out} == {"helo"} and len({r["word"].lower() for r in out}) == len(out) <= 10


def test_ngram_prefix_filter_is_exact(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(2, 9)))
    words, queries = sorted({word() for _ in range(80)}), sorted({word() for _ in range(40)})
    from collections import Counter

    bag = lambda w: Counter(w[i : i + 3] for i in range(len(w) - 2))
    want = set()
    for q in queries:
        for w in words:
            a, b = bag(q), bag(w)
            if q != w and a and b and (j := sum((a & b).values()) / sum((a | b).values())) >= 0.3 and int(round((1 - j) * 10, 9)) > 0:
                want.add((q, w))
    got = {(r["query"], r["word"]) for r in Q.ngram(_ask(spark, *queries), _dict(spark, words), min_similarity=0.0).collect()}
    assert got == want


def test_staged_stops_at_an_empty_stage(spark):
    row = lambda q, w: ("en", q, w, 1, 0.5, "s", 0.5)
    schema = "lang string, query string, word string, distance int, confidence double, source string, ngram double"
    make = lambda *rows: spark.createDataFrame(list(rows), schema)
    stages = [make(row("a", "x"), row("b", "x")), make(row("a", "y")), make(row("a", "z"), row("b", "z"))]
    got = {(r["query"], r["word"]) for r in R.staged(stages, stop_early=True).collect()}
    assert got == {("a", "x"), ("a", "y"), ("a", "z"), ("b", "x")}
    assert R.union(stages[0], make(("en", "a", "X", 1, 0.9, "t", 0.5))).where("query = 'a'").count() == 1


def test_grammar(spark):
    texts = {
        1: "I ate a apple and an pear in an hour.", 2: "there house is big. there is one", 3: "its been long, your going home",
        4: "I could of gone. i do not know nothing", 5: "see you on monday in March", 6: "He can't hardly wait. not only but also no",
        7: "not one without no doubt", 8: None, 9: "",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {(r["doc_id"], r["rule_id"], r["context"]) for r in G.check(df).collect()}
    for want in (
        (1, "EN_A_VS_AN", "a apple"), (1, "EN_A_VS_AN", "an pear"), (2, "EN_THERE_THEIR", '"there house"'), (3, "EN_ITS_IT_S", '"its been"'),
        (3, "EN_YOUR_YOURE", '"your going"'), (4, "EN_COULD_OF", "could of"), (4, "EN_SENTENCE_START_CAP", '"i"'), (5, "EN_PROPER_NOUN_CAP", '"monday"'),
        (4, "EN_DOUBLE_NEGATIVE", "not know nothing"), (6, "EN_DOUBLE_NEGATIVE", "can't hardly"),
    ):
        assert want in got, want
    assert not any(d == 1 and c.startswith("an hour") for d, _, c in got)
    assert not any(d == 2 and c == '"there is"' for d, _, c in got)
    assert not any(d == 7 and r == "EN_DOUBLE_NEGATIVE" for d, r, _ in got)
    other = spark.createDataFrame([(1, "Qué hora es? ¿Y tú?"), (2, "je ne sais rien. je ne veux")], "doc_id bigint, text string")
    assert [r["pos"] for r in G.spanish_marks(other.where("doc_id = 1")).collect()] == [11]
    assert G.french_negation(other.where("doc_id = 2")).count() == 1


def test_detection(spark):
    texts = [(1, "the house is green"), (2, "äöü über größe schön"), (3, "être déjà là où ça même"), (4, "привет мир как дела"), (5, "これは日本語です"), (6, ""), (7, None)]
    got = {r["doc_id"]: r["detected"] for r in L.detect(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    assert got[1] == "en" and got[2] == "de" and got[3] in ("fr", "pt") and got[4] == "ru" and got[5] == "ja" and got[6] is None and got[7] is None


def test_vectors(spark):
    rows = [(i, [float(i % 3), float(i % 5), 1.0]) for i in range(30)] + [(99, None)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    near = V.nearest(df.where("vec_id < 2"), df, 3).collect()
    assert len(near) == 6 and {r["rank"] for r in near} == {1, 2, 3}
    import numpy as np

    v = {i: np.array(x) for i, x in rows if x}
    for q in (0, 1):
        sims = sorted(((-round(float(v[q] @ v[i] / np.linalg.norm(v[q]) / np.linalg.norm(v[i])), 9), i) for i in v if i != q))[:3]
        assert [i for _, i in sims] == [r["id"] for r in sorted(near, key=lambda r: r["rank"]) if r["query"] == q]
    zero = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0], [1.0])], "a array<float>, b array<float>, c array<float>")
    assert zero.select(V.cosine(F.col("a"), F.col("b")), V.cosine(F.col("a"), F.col("c"))).first() == (0.0, None)


def test_dictionaries_and_policies(spark):
    d = _dict(spark, ["a", "ab", "abc", "xab"])
    assert {r["word"] for r in D.with_prefix(d, "ab").collect()} == {"abc"}
    assert {r["word"] for r in D.with_suffix(d, "ab", proper=False).collect()} == {"ab", "xab"}
    assert D.statistics(d).first()["avg_len"] == 2.25
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    one = spark.range(1).select(I.expired(F.lit("2024-01-31T00:00:00Z"), now, 7), I.expired(F.lit("2024-01-01T00:00:00Z"), now, 7), I.expired(F.lit("junk"), now, 7)).first()
    assert tuple(one) == (False, True, True)
    entries = spark.createDataFrame([("a", 5, 1), ("b", 5, 2), ("c", 5, 3)], "key string, size int, ts int")
    assert [r["key"] for r in I.eviction(entries, 10).collect()] == ["a"]


def test_nearest_in_blocks_equals_one_broadcast(spark, monkeypatch):
    rng = random.Random(21)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(90)] + [(90, None), (91, [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    key = lambda out: sorted((r["query"], r["rank"], r["id"], round(r["sim"], 9)) for r in out.collect())
    whole = key(V.nearest(df, df, 4, -1.0))
    monkeypatch.setattr(V, "BLOCK", 20)
    monkeypatch.setattr(V, "VECTORS", 30)
    assert key(V.nearest(df, df, 4, -1.0)) == whole and len(whole) == 91 * 4
    assert V.nearest(df.limit(0), df, 4).count() == 0


def test_corrections_by_meaning(spark):
    vecs = [("cat", [1.0, 0.0]), ("kitten", [0.9, 0.1]), ("dog", [0.7, 0.7]), ("car", [0.0, 1.0])]
    v = spark.createDataFrame(vecs, "word string, embedding array<double>")
    q = spark.createDataFrame([("cat", ["car"]), ("dgo", []), ("zzzzz", ["cat"])], "query string, context array<string>")
    rows = {}
    for r in V.corrections(q, v, 2).collect():
        rows.setdefault(r["query"], {})[r["rank"]] = r["word"]
    assert rows == {"cat": {1: "kitten", 2: "dog"}, "dgo": {1: "dog"}}
    fit = V.context_fit(spark.createDataFrame([("q", "cat", ["car", "cat"]), ("q", "dog", [])], "query string, word string, context array<string>"), v)
    assert {r["word"]: round(r["fit"], 6) for r in fit.collect()} == {"cat": 0.5, "dog": 0.5}
