"""Compounds, conversions, break points and corrections on small hand-made dictionaries."""

from __future__ import annotations

import random
import re

import pytest

from glyphmill.functions import metrics as M
from glyphmill.functions import speller as P
from glyphmill.operators import morphology, spelling
from glyphmill.sources import hunspell as H


def _speller(aff: str, *lines: str) -> P.Speller:
    return spelling.Dictionary(aff, list(lines)).speller()


AFF = """TRY esianrtolcdugmphbyfvkwz
FORBIDDENWORD !
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
DIC = ["work/ABC", "try/B", "well", "well-known", "bad/!", "foo/~B", "iPod/K", "a\\/b", "sing/B po:verb", "1984"]


def test_agrees_with_the_joins(spark):
    words = "work worked rework reworked workable workables tried Work WORKED well-known well-work 12 3.5 fooed iPod a/b singed 1984 works reworkable tryed bad foo IPOD wOrk retry well-xx known 7x".split()
    s = _speller(AFF, *DIC)
    options, rules = H.read_aff(spark, AFF)
    stems = H.read_dic(spark.createDataFrame([(x,) for x in DIC], "value string"), options)
    table = spark.createDataFrame([(w,) for w in words], "word string")
    want = {r["word"]: r["correct"] for r in morphology.check(table, stems, rules, options).collect()}
    assert {w: s.correct(w) for w in words} == want
    d = spelling.Dictionary(AFF, DIC)
    assert {r["word"]: r["correct"] for r in spelling.lookup(table, d).collect()} == want
    assert spelling.lookup(table.limit(0), d).count() == 0


def test_first_line_is_a_count_and_other_numbers_are_stems(spark):
    options, _ = H.parse_aff("")
    lines = spark.createDataFrame([(1, "3"), (2, "1984"), (3, "word")], "line_no int, value string")
    assert {r["stem"] for r in H.read_dic(lines, options).collect()} == {"1984", "word"}


@pytest.mark.parametrize(
    ("aff", "lines", "right", "wrong"),
    [
        ("COMPOUNDMIN 3\nCOMPOUNDFLAG X\n", ["foo/X", "bar/X", "xy/X"], ["foobar", "barfoo", "foofoobar", "foo"], ["fooxy", "foob"]),
        ("COMPOUNDFLAG X\nCOMPOUNDWORDMAX 2\n", ["foo/X", "bar/X"], ["foobar"], ["foobarfoobar"]),
        ("COMPOUNDBEGIN B\nCOMPOUNDEND E\nONLYINCOMPOUND O\n", ["foo/BO", "bar/E"], ["foobar", "bar"], ["foo", "barfoo", "foofoo"]),
        ("COMPOUNDMIN 1\nCOMPOUNDRULE 1\nCOMPOUNDRULE ab*c?\n", ["x/a", "y/b", "z/c"], ["xyz", "xy", "xyy", "xyyy", "xz"], ["yx", "xzy", "xq"]),
        ("FLAG num\nCOMPOUNDMIN 1\nCOMPOUNDRULE 1\nCOMPOUNDRULE (11)(22)\n", ["x/11", "y/22"], ["xy"], ["yx", "xx"]),
        ("COMPOUNDFLAG X\nCHECKCOMPOUNDDUP\n", ["foo/X", "bar/X"], ["foobar"], ["foofoo"]),
        ("COMPOUNDFLAG X\nCHECKCOMPOUNDCASE\n", ["foo/X", "Bar/X"], ["foofoo"], ["fooBar"]),
        ("COMPOUNDFLAG X\nCHECKCOMPOUNDTRIPLE\n", ["foo/X", "opera/X", "bar/X"], ["foobar"], ["fooopera"]),
        ("COMPOUNDFLAG X\nSIMPLIFIEDTRIPLE\nCHECKCOMPOUNDTRIPLE\n", ["schiff/X", "fahrt/X"], ["schiffahrt"], ["schifffahrt"]),
        ("COMPOUNDFLAG X\nCHECKCOMPOUNDREP\nREP 1\nREP f ph\n", ["foto/X", "bar/X", "photobar"], ["barfoto"], ["fotobar"]),
        ("COMPOUNDFLAG X\nCHECKCOMPOUNDPATTERN 1\nCHECKCOMPOUNDPATTERN o b\n", ["foo/X", "bar/X"], ["barfoo"], ["foobar"]),
        ("COMPOUNDFLAG X\nCOMPOUNDFORBIDFLAG F\n", ["foo/X", "bar/XF"], ["foofoo", "foobar"], ["barfoo"]),
        ("COMPOUNDFLAG X\nCOMPOUNDPERMITFLAG P\nSFX S Y 1\nSFX S 0 s/P .\nSFX T Y 1\nSFX T 0 t .\n", ["foo/XST", "bar/X"], ["foosbar", "foobar"], ["footbar"]),
        ("COMPOUNDFLAG X\nFORCEUCASE U\n", ["foo/X", "bar/XU"], ["Foobar", "foofoo"], ["foobar"]),
        ("COMPOUNDFLAG X\nFORBIDDENWORD !\n", ["foo/X", "bar/X", "foobar/!"], ["barfoo"], ["foobar"]),
        ("BREAK 2\nBREAK -\nBREAK ^/\n", ["foo", "bar"], ["foo-bar", "/foo", "foo-bar-foo"], ["foo/bar", "-foo", "foo-"]),
        ("", ["foo", "bar"], ["foo-bar", "-foo", "foo-"], ["foo--baz"]),
        ("BREAK 0\n", ["foo", "bar"], ["foo"], ["foo-bar"]),
        ("ICONV 2\nICONV ’ '\nICONV _xx y\n", ["don't", "yes", "axxb"], ["don’t", "xxes", "axxb"], ["xes"]),
        ("IGNORE -\n", ["foobar"], ["foo-bar", "foobar"], ["foo"]),
        ("CHECKSHARPS\n", ["groß", "Straße"], ["GROSS", "STRASSE", "Straße", "groß"], ["gross", "Strasse"]),
        ("LANG tr\n", ["ışık"], ["IŞIK", "Işık"], ["İŞIK"]),
        ("CIRCUMFIX C\nPFX A Y 1\nPFX A 0 ge/C .\nSFX B Y 1\nSFX B 0 t/C .\n", ["mach/AB"], ["gemacht", "mach"], ["gemach", "macht"]),
        ("COMPLEXPREFIXES\nPFX A Y 1\nPFX A 0 a/B .\nPFX B Y 1\nPFX B 0 b .\n", ["word/A"], ["word", "aword", "baword"], ["bword"]),
    ],
)
def test_directives(aff, lines, right, wrong):
    s = _speller(aff, *lines)
    assert [w for w in right if not s.correct(w)] == []
    assert [w for w in wrong if s.correct(w)] == []


def test_compounds_match_brute_force():
    rng = random.Random(4)
    stems = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(2, 4))) for _ in range(8)})
    flags = {w: rng.choice(["B", "M", "E", "BE", "X"]) for w in stems}
    s = _speller("COMPOUNDMIN 2\nCOMPOUNDFLAG X\nCOMPOUNDBEGIN B\nCOMPOUNDMIDDLE M\nCOMPOUNDEND E\n", *[f"{w}/{f}" for w, f in flags.items()])

    def made(word, first=True):
        ends = [w for w in stems if w == word and not first and set(flags[w]) & {"E", "X"}]
        return bool(ends) or any(word.startswith(w) and len(word) > len(w) and set(flags[w]) & {"B" if first else "M", "X"} and made(word[len(w) :], False) for w in stems)

    for _ in range(400):
        w = "".join(rng.choice("ab") for _ in range(rng.randint(2, 9)))
        assert s.correct(w) == (w in stems or made(w)), w


def test_compound_rule_matches_a_regular_expression():
    rng = random.Random(5)
    for _ in range(200):
        text = "".join(rng.choice("abc") + rng.choice(["", "*", "?"]) for _ in range(rng.randint(1, 4)))
        rule, pattern = P.CompoundRule(text), re.compile(text)
        for _ in range(20):
            flags = "".join(rng.choice("abc") for _ in range(rng.randint(1, 5)))
            states = {0}
            for f in flags:
                states = rule.step(states, frozenset(f))
            assert rule.complete(states) == bool(pattern.fullmatch(flags)), (text, flags)


def test_slips():
    o = {"TRY": "ab", "KEY": "qwe|as", "MAP": [["a", "á"]], "REP": [("f", "ph"), ("x$", "_y")]}
    kinds: dict = {}
    for made, kind in P.slips("fax", o):
        kinds.setdefault(kind, []).append(made)
    assert list(kinds) == ["uppercase", "replchars", "spaceword", "mapchars", "swapchar", "longswapchar", "badcharkey", "extrachar", "forgotchar", "movechar", "badchar", "twowords"]
    assert kinds["replchars"] == ["phax", "fa y", ("fa", "y")] and kinds["spaceword"] == ["f ax", "f-ax", "fa x", "fa-x"]
    assert kinds["swapchar"] == ["afx", "fxa"] and kinds["longswapchar"] == ["xaf"] and kinds["extrachar"] == ["ax", "fx", "fa"]
    assert kinds["mapchars"] == ["fáx"] and kinds["movechar"] == ["xfa", "afx"]
    assert kinds["badcharkey"] == ["Fax", "fAx", "fsx", "faX"] and kinds["badchar"] == ["faa", "aax", "fab", "fbx", "bax"]
    assert ("vacation", "doubletwochars") in set(P.slips("vacacation", {}))
    assert [x for x, k in P.slips("abcd", {}) if k == "swapchar"] == ["bacd", "acbd", "abdc", "badc"]


def test_corrections(spark):
    s = _speller(AFF + "REP 2\nREP f ph\nREP alot a_lot\nMAP 1\nMAP eé\n", *DIC, "phone", "hello", "café", "lot", "a", "world", "permanent")
    first = lambda w: s.suggest(w)[0]
    assert first("fone") == ("phone", "replchars") and first("Fone") == ("Phone", "replchars")
    assert first("helol")[0] == "hello" and ("hello", "extrachar") in s.suggest("helllo")
    assert first("cafe") == ("café", "mapchars") and first("alot")[0] == "a lot"
    assert s.suggest("helloworld")[0] == ("hello world", "twowords")
    assert ("WORLD", "swapchar") in s.suggest("WROLD")
    assert "permanent" in [x for x, k in s.suggest("permenrantt") if k == "ngram"]
    assert ("well-hello", "dashes") in s.suggest("well-helllo")
    assert not any(x == "bad" for x, _ in s.suggest("bda"))
    words = spark.createDataFrame([("fone",), ("hello",), ("fone",), (None,), ("",)], "word string")
    rows = spelling.corrections(words, spelling.Dictionary(AFF + "REP 1\nREP f ph\n", [*DIC, "phone", "hello"]), 2).collect()
    assert (rows[0]["word"], rows[0]["rank"], rows[0]["suggestion"], rows[0]["kind"]) == ("fone", 1, "phone", "replchars")
    assert {r["word"] for r in rows} == {"fone"}


def test_ph_sounds_and_output_conversion():
    s = _speller("OCONV 1\nOCONV ' ’\n", "which ph:wich", "Wednesday ph:wendsay->wednesday", "don't ph:dont")
    assert s.suggest("wich")[0][0] == "which" and s.suggest("dont")[0][0] == "don’t"
    code = P.Sounds([("PH", "F"), ("A(EI)--", "A"), ("B$", ""), ("^B", "P"), ("K", "K"), ("E", "E"), ("I", "I"), ("F", "F"), ("B", "B")])
    assert code("phab") == "F" and code("kei") == "KEI" and code("aek") == "AEK"
    s = _speller("MAXNGRAMSUGS 0\nPHONE 4\nPHONE F F\nPHONE PH F\nPHONE O _\nPHONE N N\n", "phon", "other")
    assert ("phon", "phonet") in s.suggest("foonn")


def test_expand_matches_the_speller(spark):
    options, rules = H.read_aff(spark, AFF)
    stems = H.read_dic(spark.createDataFrame([(x,) for x in DIC], "value string"), options)
    got = {(r["stem"], r["form"]) for r in spelling.expand(stems, rules).collect()}
    s = _speller(AFF, *DIC)
    assert got == {(e.stem, f) for held in s.entries.values() for e in held for f in s.expand(e)}


def test_overlap_and_swaps_match_the_columns(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(0, 7)))
    pairs = [(word(), word()) for _ in range(400)] + [("ca", "abc"), ("teh", "the"), ("abcd", "badc"), ("axby", "xayb"), ("abc", "cab")]
    df = spark.createDataFrame(pairs, "a string, b string")
    from pyspark.sql import functions as F

    a, b = F.col("a"), F.col("b")
    rows = df.select("a", "b", M.ngram_score(3, a, b, longer_worse=True).alias("l"), M.ngram_score(2, a, b, weighted=True, any_mismatch=True).alias("w"), M.osa_within_two(a, b).alias("d"), M.swap_bonus(a, b).alias("s")).collect()
    for r in rows:
        x, y = r["a"], r["b"]
        assert r["l"] == P.overlap(3, x, y, longer_worse=True) and r["w"] == P.overlap(2, x, y, weighted=True, any_mismatch=True), r
        assert r["d"] == min(3, M.osa(x, y)), r
        assert M.osa_within(x, y, 2) == (M.osa(x, y) if M.osa(x, y) <= 2 else None)
        places = [i for i, c in enumerate(x) if len(x) == len(y) and c != y[i] and (k := y.find(c, i + 1)) > 0 and (k == i + 1 or x[k] == y[i])]
        assert r["s"] == (200 if len(places) == 1 else 100 * len(places)), r
