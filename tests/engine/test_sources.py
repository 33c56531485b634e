"""Line readers, lists, tiers, rules, settings, parsers, catalogues, registries and small helpers."""

from __future__ import annotations

import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import attempt as A
from glyphmill.functions import bloom as B
from glyphmill.functions.kept import Kept
from glyphmill.operators import check as C
from glyphmill.operators import detect as LD
from glyphmill.operators import integrity as I
from glyphmill.operators import rank as R
from glyphmill.operators import spelling as P
from glyphmill.operators import suggest as Q
from glyphmill.sinks import reports as S
from glyphmill.sources import catalog as K
from glyphmill.sources import lines as L
from glyphmill.sources import parsers as D


def test_lines_and_encodings(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿eins\n\n  zwei \r\n# drei\n".encode())
    (tmp_path / "b.txt").write_bytes("caf\xe9\nüber\n".encode("latin-1"))
    rows = {(r["path"].rsplit("/", 1)[-1], r["line_no"], r["value"]) for r in L.read_lines(spark, str(tmp_path), pattern="*.txt").collect()}
    assert rows == {("a.txt", 1, "eins"), ("a.txt", 3, "zwei"), ("a.txt", 4, "# drei"), ("b.txt", 1, "café"), ("b.txt", 2, "über")}
    assert L.detect_encoding(b"SET microsoft-cp1251\n") == "cp1251" and L.detect_encoding(b"caf\xe9") == "iso8859-1" and L.detect_encoding("é".encode()) == "utf-8"
    assert L.decode(b"ok\ncaf\xe9\n") == [(1, "ok"), (2, "café")]  # one line at a time
    assert [r["value"] for r in L.lines_of(spark, "a\n\nb").orderBy("line_no").collect()] == ["a", "b"]
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("x.aff", "SET UTF-8\nTRY ab\n")
        z.writestr("x.dic", "2\n1984\nword\n")
    assert [r["value"] for r in L.read_zip_lines(spark, str(tmp_path / "d.zip"), "x.dic").orderBy("line_no").collect()] == ["2", "1984", "word"]
    with pytest.raises(FileNotFoundError):
        L.zip_entry((tmp_path / "d.zip").read_bytes(), "y")
    d = P.Dictionary.read_zip(spark, str(tmp_path / "d.zip"), "x.aff", "x.dic")
    assert d.lines == ["1984", "word"] and d.options["TRY"] == "ab"
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "de.aff").write_bytes("SET ISO8859-1\nTRY \xe9\n".encode("latin-1"))
    (tmp_path / "p" / "de.dic").write_bytes("1\ncaf\xe9\n".encode("latin-1"))
    assert P.Dictionary.read_first(spark, [str(tmp_path / "none"), str(tmp_path / "p")], "de").lines == ["café"]
    with pytest.raises(FileNotFoundError):
        P.Dictionary.read_first(spark, [str(tmp_path)], "fr")
    assert {r["path"].rsplit("/", 1)[-1] for r in L.read_documents(spark, str(tmp_path)).collect()} == {"a.txt", "b.txt"}


def test_word_lists_tiers_and_vocabularies(spark, tmp_path):
    lines = spark.createDataFrame([("Word",), (" two ",), ("# no",), ("",), ("x1",)], "value string")
    words = lambda df: sorted(r["word"] for r in df.collect())
    assert words(L.word_list(lines)) == ["two", "word", "x1"] and words(L.word_list(lines, "[a-z]+")) == ["two"]
    assert words(L.word_list(lines, case_sensitive=True, strip=False)) == [" two ", "Word", "x1"]
    assert words(L.custom_words(spark, [" A ", "", "b"])) == ["a", "b"] and words(L.code_word_list(lines.union(lines))) == ["two", "word", "x1"]
    (tmp_path / "list").write_text("alpha\nBeta\n")
    assert words(L.system_words(spark, (str(tmp_path / "no"), str(tmp_path / "list")))) == ["alpha", "beta"]
    (tmp_path / "t.json").write_text(json.dumps({"tiers": {"top_50": {"words": ["the"]}, "top_200": ["the", "of"], "top_1000": ["cat"]}}))
    tiers = L.read_tiers(spark, str(tmp_path / "t.json"), "en")
    assert {(r["word"], r["bonus"]) for r in tiers.collect()} == {("the", 200), ("of", 100), ("cat", 50)}
    assert L.read_tiers(spark, str(tmp_path / "none.json"), "en").count() == 0
    other = L.tiers_of(spark, {"tiers": {"top_50": ["le"]}}, "fr")
    assert {r["word"] for r in L.first_tiers(tiers, other, L.tiers_of(spark, {"tiers": {"top_50": ["x"]}}, "en")).collect()} == {"the", "of", "cat", "le"}
    vocab = spark.createDataFrame([("b", 1), ("a", 0)], "word string, idx int")
    assert json.loads(L.vocabulary_json(vocab).first()["json"]) == {"a": 0, "b": 1} and json.loads(L.vocabulary_json(vocab, True).first()["json"]) == ["a", "b"]
    (tmp_path / "v.json").write_text('["a", "b"]')
    assert {(r["word"], r["idx"]) for r in L.read_vocabulary(spark, str(tmp_path / "v.json")).collect()} == {("a", 0), ("b", 1)}


def test_rules_and_settings(spark, tmp_path):
    (tmp_path / "rules.json").write_text(json.dumps({"rules": [{"id": "X", "kind": "phrase", "message": "m", "suggestion": "a lot", "params": {"phrase": "alot"}}]}))
    rules = L.read_rules(spark, ["", str(tmp_path / "none.json"), str(tmp_path / "rules.json")])
    from glyphmill.operators import grammar as G

    hits = G.check(spark.createDataFrame([(1, "I have alot .")], "doc_id bigint, text string"), tuple(rules)).collect()
    assert [(r["rule_id"], r["pos"], r["suggestion"]) for r in hits] == [("X", 7, "a lot")]
    assert L.read_rules(spark, [str(tmp_path / "none.json")]) == []
    assert len(G.POSSESSED) == 205 and "indication" in G.POSSESSED
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "ignore.json").write_text('{"ignore_words": ["foo"], "ignore_patterns": ["^x"]}')
    assert L.project_settings(spark, str(tmp_path / "a" / "b"), "ignore.json") == {"words": ["foo"], "patterns": ["^x"]}
    errs = spark.createDataFrame([("Foo", 1), ("xyz", 2), ("bar", 3)], "word string, n int")
    assert [r["n"] for r in L.not_ignored(errs, L.custom_words(spark, ["foo"]), ["^x"]).collect()] == [3]
    mine = L.personal_add(L.custom_words(spark, ["b", "a"]), L.custom_words(spark, ["c", "a"]))
    L.personal_save(L.personal_remove(mine, L.custom_words(spark, ["b"])), str(tmp_path / "mine"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "mine")).collect()] == ["a", "c"]
    sets = L.confusion_sets(spark.createDataFrame([("a; b; 10 # x",), ("# no",), ("c -> d; 5",)], "value string"))
    assert {tuple(r) for r in sets.collect()} == {("a", "b", 10.0, True), ("c", "d", 5.0, False)}
    assert K.setting("k", {}, {"GLYPHMILL_K": "env"}, {"k": "prog"}, {"k": 0}) == "env" and K.setting("k", {"k": 1}, {}, {}, {}) == 1


def test_parsers_and_nodes(spark):
    page = "<html><head><title>t</title></head><body><!-- c --><p>One &amp; two</p><script>x()</script><div>three</div></body>"
    one = lambda c: spark.range(1).select(c.alias("t")).first()["t"]
    assert one(D.parse(F.lit(page), "html")).split("\n") == ["One & two", "three"]
    assert one(D.parse(F.lit("# Head\n`code` [link](http://x) **bold**"), "markdown")).split() == ["Head", "link", "bold"]
    assert one(D.parse(F.lit("as <it> is"), "unknown")) == "as <it> is"
    D.register("loud", lambda c: F.upper(c))
    assert one(D.parse(F.lit("a"), "loud")) == "A"
    texts = {1: "ab\n\n cd\n", 2: None, 3: ""}
    nodes = D.text_nodes(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"))
    assert {(r["doc_id"], r["node"], r["offset"], r["text"]) for r in nodes.collect()} == {(1, 0, 0, "ab"), (1, 2, 4, " cd")}
    at = spark.createDataFrame([(1, 0), (1, 2), (1, 5), (2, 0)], "doc_id bigint, at bigint")
    assert {(r["doc_id"], r["at"], r["node"]) for r in D.node_at(at, nodes).collect()} == {(1, 0, 0), (1, 2, None), (1, 5, 2), (2, 0, None)}


def test_bloom_catalogue_and_registry(spark):
    shape = B.Shape.of(200, 0.01)
    assert (shape.bits, shape.hashes) == (1918, 7)
    words = spark.createDataFrame([(f"word{i}",) for i in range(200)], "word string")
    bloom = B.build(words, "word", shape)
    assert B.probe(words, "word", bloom, shape).where("not maybe").count() == 0
    others = spark.createDataFrame([(f"other{i}",) for i in range(500)], "word string")
    assert B.probe(others, "word", bloom, shape).where("maybe").count() <= 25
    r = K.Registry()
    r.register("a", dict)
    r.register("b", lambda a: (a,), needs=("a",))
    assert r.single("b")[0] is r.single("a") and r.get("a-XX") is dict and r.missing("a", ("keys", "fly")) == ["fly"]
    with pytest.raises(KeyError):
        r.register("a", list)
    r.register("c", lambda d: d, needs=("d",))
    r.register("d", lambda c: c, needs=("c",))
    with pytest.raises(ValueError):
        r.single("c")


def test_kept_values():
    now = [0.0]
    kept = Kept(2, 10, lambda: now[0])
    made = []
    ask = lambda k: kept.fetch(k, lambda: made.append(k) or k)
    assert [ask(k) for k in "abacb"] == list("abacb") and made == ["a", "b", "c", "b"]
    now[0] = 11
    ask("b")
    assert made[-1] == "b" and len(made) == 5 and kept.hits == 1 and 0 < kept.rate < 1


def test_attempts(spark):
    df = spark.createDataFrame([("4",), ("x",), ("0",)], "s string")
    number = A.attempt(F.col("s").try_cast("int"), "no number")
    part = A.and_then(number, lambda v: A.attempt(F.try_divide(F.lit(8), v), "division by zero"))
    rows = df.select("s", part.alias("p"), A.value_or(A.map_value(part, lambda v: v + 1), F.lit(-1.0)).alias("v"), A.or_else(part, lambda e: A.ok(F.lit(0.0)))["value"].alias("o")).collect()
    assert {r["s"]: (r["p"]["value"], r["p"]["error"], r["v"], r["o"]) for r in rows} == {"4": (2.0, None, 3.0, 2.0), "x": (None, "no number", -1.0, 0.0), "0": (None, "division by zero", -1.0, 0.0)}


def test_resources_and_observations(spark, tmp_path):
    df = spark.createDataFrame([("a",)], "word string")
    assert I.kept_resource(spark, str(tmp_path), "spelling", "en") is None
    I.keep_resource(df, str(tmp_path), "spelling", "en")
    assert I.kept_resource(spark, str(tmp_path), "spelling", "en").collect() == df.collect()
    assert I.kept_resource(spark, str(tmp_path), "spelling", "en", F.expr("current_timestamp() + interval 8 days")) is None
    out, seen = I.observed(df, "seen", n=F.count(F.lit(1)))
    assert out.count() == 1 and seen.get["n"] == 1


def test_eviction_over_many_spans(spark):
    rng = random.Random(3)
    rows = [(str(i), rng.randint(1, 9), rng.randint(0, 40)) for i in range(300)]
    want, total = set(), 0
    for key, size, ts in sorted(rows, key=lambda r: (r[2], r[0]), reverse=True):
        total += size
        if total > 700:
            want.add(key)
    df = spark.createDataFrame(rows, "key string, size bigint, ts bigint")
    assert {r["key"] for r in I.eviction(df, 700, 8).collect()} == want
    assert I.eviction(df, 10**6).count() == 0 and I.eviction(df.limit(0), 5).count() == 0 and I.eviction(df, 0).count() == 300


def test_check_output_and_reports(spark):
    docs = spark.createDataFrame([(1, "The wrold is\nbig. Wrold!", "en"), (2, "The world", "en"), (3, None, "en"), (4, "hallo wrold", "de")], "doc_id bigint, text string, lang string")
    words = spark.createDataFrame([("en", w) for w in "the world is big word".split()] + [("de", "hallo")], "lang string, word string")
    errors = C.located(C.check(docs, words), docs)
    rows = sorted((r["doc_id"], r["pos"], r["original"], tuple(r["suggestions"]), r["line"], r["column"]) for r in errors.collect())
    assert rows == [(1, 4, "wrold", ("word", "world"), 1, 5), (1, 18, "Wrold", ("word", "world"), 2, 6), (4, 6, "wrold", (), 1, 7)]
    lines = {}
    for r in C.report_lines(docs, errors).orderBy("doc_id", "line_no").collect():
        lines.setdefault(r["doc_id"], []).append(r["line"])
    assert lines[1] == ["FAIL 1 (2 errors)", "  4: wrold -> word, world", "  18: Wrold -> word, world"]
    assert lines[2] == ["OK 2 (2 words)"] and lines[3] == ["OK 3 (0 words)"] and lines[4] == ["FAIL 4 (1 errors)", "  6: wrold"]
    csv = C.csv_rows(errors)
    assert {(r["doc_id"], r["line"], r["suggestion"], r["confidence_pct"]) for r in csv.collect()} == {(1, 1, "word", 50.0), (1, 2, "word", 50.0), (4, 1, "", 0.0)}
    assert json.loads(S.with_statistics(csv).first()["json"]) == {"documents": 2, "errors": 3, "by_type": {"orthographic": 3}}
    sarif = {r["doc_id"]: json.loads(r["sarif"]) for r in C.sarif(errors).collect()}
    assert [x["locations"][0]["physicalLocation"]["region"]["charOffset"] for x in sarif[1]["runs"][0]["results"]] == [4, 18]
    yaml = {r["doc_id"]: r["yaml"] for r in S.yaml_lines(errors).collect()}
    assert yaml[4] == '- id: 4\n  errors:\n  - pos: 6\n    original: "wrold"'
    parts = spark.createDataFrame([(1, "en", 0, "the wrold"), (1, "de", 10, "hallo"), (1, "fr", 20, "monde")], "doc_id bigint, lang string, offset bigint, text string")
    got = C.check_languages(parts, words).collect()
    assert [(r["start"], r["stop"], r["original"], len(r["id"])) for r in got] == [(4, 9, "wrold", 16)]


def test_orders_strategies_and_hooks(spark, tmp_path):
    rows = spark.createDataFrame([("en", "q", w, d, 1.0 / (1 + d), "s", 0.5) for w, d in (("a", 1), ("b", 2), ("c", 3))], "lang string, query string, word string, distance int, confidence double, source string, ngram double")
    names = lambda df: [r["word"] for r in df.orderBy("rank").collect()]
    assert names(R.first(rows, 2)) == ["a", "b"] and names(R.last(rows, 2)) == ["b", "c"] and R.including(rows, "c").count() == 3 and R.including(rows, "x").count() == 0
    v = spark.createDataFrame([("x", 2), ("y", 0), ("z", 1)], "word string, idx int")
    assert [r["word"] for r in R.common_words(v, 2).collect()] == ["y", "z"]
    assert R.random_words(v, 2).collect() == R.random_words(v.repartition(3), 2).collect()
    assert Q.chosen({"symspell": {"enabled": True, "priority": 1}, "ngram": {"enabled": False}}) == ("symspell", "edit_distance", "keyboard_proximity", "phonetic")
    de = spark.createDataFrame([("de", w) for w in ("Haus", "Tür", "tür", "schlüssel")], "lang string, word string")
    out = Q.german_compounds(spark.createDataFrame([("de", "Hausschlüssel"), ("de", "Haustür")], "lang string, query string"), de)
    assert [(r["query"], r["word"]) for r in out.collect()] == [("Hausschlüssel", "Haus schlüssel")]
    ja = spark.createDataFrame([("ja", w) for w in ("かがみ", "さくら")], "lang string, word string")
    found = Q.japanese(spark.createDataFrame([("ja", "かみ"), ("ja", "さくろ")], "lang string, query string"), ja).collect()
    assert {(r["query"], r["word"]) for r in found if r["rank"] == 1} == {("かみ", "かがみ"), ("さくろ", "さくら")}
    df = spark.createDataFrame([(1, "bonjour"), (2, None)], "doc_id bigint, text string")
    model = lambda texts: [[("fr", 0.9), ("en", 0.1)] if t else [("en", 0.5)] for t in texts]
    assert {(r["doc_id"], r["code"], r["rank"]) for r in LD.detect_with(df, model, 1).collect()} == {(1, "fr", 1), (2, "en", 1)}
    S.append_audit(spark.createDataFrame([("a", 1), ("b", 2)], "what string, ts bigint"), str(tmp_path / "log"))
    assert [r["what"] for r in S.read_audit(spark, str(tmp_path / "log"), "what string, ts bigint").collect()] == ["b", "a"]
    assert S.rotate_audit(spark, str(tmp_path / "log"), 10**6) is None and S.rotate_audit(spark, str(tmp_path / "log"), 1).endswith("log.1")
