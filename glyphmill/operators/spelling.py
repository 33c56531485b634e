"""Affix dictionaries over tables of words: lookup with compounds and break points, corrections, all forms.

The dictionary travels to the workers: its text may have at most ``MOST_CHARS`` characters (large ones have ten
million). Beyond that ``morphology.check`` joins words and stems instead. Only distinct words are looked up.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions.speller import Affix, Entry, Speller
from glyphmill.sources import hunspell as H
from glyphmill.sources import lines as L

MOST_CHARS = 100_000_000
_HELD: dict[str, Speller] = {}


class Dictionary:
    """An affix file's text and the lines of a word file."""

    def __init__(self, aff: str, lines: list[str]) -> None:
        if sum(map(len, lines)) > MOST_CHARS:
            raise ValueError(f"a dictionary of over {MOST_CHARS} characters is not sent to workers; use morphology.check")
        self.options, self.rules = H.parse_aff(aff)
        self.lines, self.key = lines, uuid.uuid4().hex

    @staticmethod
    def read(spark: SparkSession, aff_path: str, dic_path: str) -> Dictionary:
        """From two files in any store; the affix file names the encoding of both."""
        raw = bytes(spark.read.format("binaryFile").load(aff_path).first()["content"])
        encoding = L.detect_encoding(raw)
        aff = "\n".join(x for _, x in L.decode(raw, encoding))
        rows = L.read_lines(spark, dic_path, encoding).orderBy("line_no").collect()
        return Dictionary(aff, _without_count([(r["line_no"], r["value"]) for r in rows]))

    @staticmethod
    def read_zip(spark: SparkSession, path: str, aff_entry: str, dic_entry: str) -> Dictionary:
        """From two entries of an archive."""
        content = bytes(spark.read.format("binaryFile").load(path).first()["content"])
        raw = L.zip_entry(content, aff_entry)
        encoding = L.detect_encoding(raw)
        aff = "\n".join(x for _, x in L.decode(raw, encoding))
        return Dictionary(aff, _without_count(L.decode(L.zip_entry(content, dic_entry), encoding)))

    @staticmethod
    def read_first(spark: SparkSession, folders: list[str], name: str) -> Dictionary:
        """``name.aff`` and ``name.dic`` of the first folder that has both; an error if none has."""
        for f in folders:
            pair = [f"{f.rstrip('/')}/{name}.{end}" for end in ("aff", "dic")]
            if all(L.first_that_exists(spark, [p]) for p in pair):
                return Dictionary.read(spark, *pair)
        raise FileNotFoundError(f"no {name}.aff and {name}.dic in {', '.join(folders)}")

    def speller(self) -> Speller:
        rules = [Affix(k, f, x, strip, add, re.compile(cond) if cond else None, frozenset(own)) for k, f, x, strip, add, cond, own in self.rules]
        entries = [Entry(stem, frozenset(flags), tuple(morph)) for stem, flags, morph in (H.parse_entry(x, self.options) for x in self.lines) if stem]
        return Speller(self.options, rules, entries)


def _without_count(rows: list[tuple[int, str]]) -> list[str]:
    return [x for n, x in rows if not (n == 1 and x.isdigit())]


def _each(words: DataFrame, dictionary: Dictionary, schema: str, names: list[str], fn: Callable[[Speller, str], Iterator[tuple]]) -> DataFrame:
    sent, key, arrow = words.sparkSession.sparkContext.broadcast(pickle.dumps(dictionary)), dictionary.key, _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _HELD:
            _HELD.clear()
            _HELD[key] = pickle.loads(sent.value).speller()
        speller = _HELD[key]
        for batch in batches:
            rows = [(w, *r) for w in batch.column(0).to_pylist() for r in fn(speller, w)]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=arrow)

    distinct = words.select("word").where("word is not null").distinct()
    return distinct.mapInArrow(run, schema)


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def lookup(words: DataFrame, dictionary: Dictionary) -> DataFrame:
    """``word, correct`` of the distinct words; nulls are left out, the empty word is right."""
    return _each(words, dictionary, "word string, correct boolean", ["word", "correct"], lambda s, w: iter([(s.correct(w),)]))


def corrections(words: DataFrame, dictionary: Dictionary, k: int = 15) -> DataFrame:
    """``word, rank, suggestion, kind`` of the distinct words that are wrong."""
    names = ["word", "rank", "suggestion", "kind"]

    def some(s: Speller, w: str) -> Iterator[tuple]:
        if w and not s.correct(w):
            yield from ((i + 1, text, kind) for i, (text, kind) in enumerate(s.suggest(w)[:k]))

    return _each(words, dictionary, "word string, rank int, suggestion string, kind string", names, some)


def readings(words: DataFrame, dictionary: Dictionary) -> DataFrame:
    """``word, parts``: for each reading the stems of its parts; one for a word, more for a compound."""
    def some(s: Speller, w: str) -> Iterator[tuple]:
        found = dict.fromkeys(tuple(f.entry.stem for f in parts) for parts in s.forms(w)) if w else {}
        yield from ((list(parts),) for parts in found)

    return _each(words, dictionary, "word string, parts array<string>", ["word", "parts"], some)


def expand(stems: DataFrame, rules: DataFrame) -> DataFrame:
    """``stem, form``: every form that the rules of a stem's flags make of it (one level, and prefix with suffix).

    A join on the flag; both tables may be of any size. Stems come as ``stem, flags``.
    """
    flagged = stems.select("stem", F.explode("flags").alias("flag"))
    fits = F.expr("cond = '' or stem rlike cond")
    ends = flagged.join(rules.where("kind = 'SFX'"), "flag").where(fits)
    starts = flagged.join(rules.where("kind = 'PFX'"), "flag").where(fits)
    tail = F.concat(F.expr("left(stem, length(stem) - length(strip))"), "add")
    one = ends.select("stem", tail.alias("form"))
    two = starts.select("stem", F.concat("add", F.expr("substring(stem, length(strip) + 1)")).alias("form"))
    s = ends.where("cross").select("stem", F.length("strip").alias("cut"), F.col("add").alias("end"))
    p = starts.where("cross").select("stem", F.col("add").alias("begin"), F.length("strip").alias("skip"))
    both = s.join(p, "stem").select("stem", F.concat("begin", F.expr("substring(stem, skip + 1, length(stem) - skip - cut)"), "end").alias("form"))
    return stems.select("stem", F.col("stem").alias("form")).unionByName(one).unionByName(two).unionByName(both).distinct()


#: Part of speech by the first letter of a stem's first flag, then by its ending. Fixed values of this engine.
POS_FLAGS = {"V": "VERB", "N": "NOUN", "A": "ADJ", "R": "ADV", "S": "NOUN", "D": "VERB", "G": "VERB", "Y": "ADV"}
POS_ENDINGS = (("ly", "ADV"), ("ing", "VERB"), ("ed", "VERB"), ("ness", "NOUN"), ("tion", "NOUN"), ("ous", "ADJ"), ("ful", "ADJ"), ("able", "ADJ"))


def tag(forms: DataFrame) -> DataFrame:
    """``word, lemma, pos`` from the first reading ``word, entry, root_flags`` (see ``morphology.good_forms``)."""
    first = forms.groupBy("word").agg(F.min(F.struct(F.length("entry").alias("n"), "entry", "root_flags")).alias("r"))
    own = F.upper(F.substring(F.get(F.sort_array("r.root_flags"), F.lit(0)), 1, 1))
    by_flag = F.coalesce(*[F.when(own == k, v) for k, v in POS_FLAGS.items()])
    by_end = F.coalesce(*[F.when(F.col("word").endswith(e), v) for e, v in POS_ENDINGS])
    return first.select("word", F.col("r.entry").alias("lemma"), F.coalesce(by_flag, by_end, F.lit("X")).alias("pos"))
