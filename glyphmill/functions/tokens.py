"""Tokenisers as column expressions over whole texts; offsets come with the token table of an Arrow pass."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns fixed by the behaviour to match, each valid for Java, Python and RE2.
CHECKER = r"[A-Za-z']+"
MULTI = r"[a-zA-Zà-ÿÀ-ÖØ-Þ]+(?:['’-][a-zA-Zà-ÿÀ-ÖØ-Þ]+)*"
SEMANTIC = r"[a-zA-Z]+(?:['’-][a-zA-Z]+)*"
WHITESPACE = r"[A-Za-z0-9_']+|[^A-Za-z0-9_'\s]"
PATTERNS = {"checker": CHECKER, "multi": MULTI, "semantic": SEMANTIC, "whitespace": WHITESPACE}


def all_matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def tokens(text: Column, kind: str = "checker") -> Column:
    """Array of the tokens of one tokeniser; ``multi`` and ``semantic`` fold case."""
    found = all_matches(text, PATTERNS[kind])
    return F.transform(found, F.lower) if kind in ("multi", "semantic") else found


def folded_tokens(text: Column) -> Column:
    """Tokens of the checker in lower case. They are ASCII, so the text's ASCII letters are folded, in one go."""
    return all_matches(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[a-z']+")


def token_table(df: DataFrame, kind: str = "checker", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, idx, token, pos, len``: one row for each token with its offset in code points, in linear time."""
    find, fold = re.compile(PATTERNS[kind], re.ASCII).finditer, kind in ("multi", "semantic")
    key = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                where, idx, tok, pos, size = [], [], [], [], []
                for row, text in enumerate(part.column(1).to_pylist()):
                    for i, m in enumerate(find(text or "")):
                        where.append(row)
                        idx.append(i)
                        tok.append(m.group().lower() if fold else m.group())
                        pos.append(m.start())
                        size.append(m.end() - m.start())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(where, pa.int64())), pa.array(idx, pa.int32()), pa.array(tok, pa.string()), pa.array(pos, pa.int32()), pa.array(size, pa.int32())],
                    ["id", "idx", "token", "pos", "len"],
                )

    out = df.select(id_col, text_col).mapInArrow(run, f"id {key}, idx int, token string, pos int, len int")
    return out.withColumnRenamed("id", id_col)


def with_arrays(df: DataFrame, text_col: str = "text", pattern: str = WHITESPACE) -> DataFrame:
    """Adds ``toks`` and ``gaps``, what stands between them, so that offsets of single tokens can be computed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.withColumn("toks", all_matches(text, pattern)).withColumn("gaps", F.split(text, pattern, -1))


def offset(i: Column) -> Column:
    """Offset of token i (from 0) in a row of ``with_arrays``."""
    add = lambda acc, x: acc + F.length(x)
    return F.aggregate(F.slice("gaps", 1, i + 1), F.lit(0), add) + F.aggregate(F.slice("toks", F.lit(1), i), F.lit(0), add)


def token_at(i: Column) -> Column:
    return F.get(F.col("toks"), i)


def line_and_column(text: Column, pos: Column) -> tuple[Column, Column]:
    """Line and column, from 1, of an offset."""
    before = F.substring(text, F.lit(1), pos)
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    return line, pos - (F.length(before) - F.length(F.substring_index(before, "\n", -1))) + 1


# --- language tokenisers ----------------------------------------------------------------------------------------------

#: Words that a contraction stands for.
CONTRACTIONS = {"won't": ["will", "not"], "can't": ["can", "'t"], "shan't": ["shall", "not"]}
SUFFIXES = ("n't", "'ll", "'re", "'ve", "'m", "'d", "'s")
KEEP_WHOLE_FR = ("aujourd'hui", "presqu'île", "quelqu'un", "prud'homme")


def english(text: Column) -> Column:
    """Words with contractions and possessives opened: ``won't`` to will, not; ``cat's`` to cat, 's."""

    def one(tok: Column) -> Column:
        low = F.lower(tok)
        out = F.array(tok)
        for suffix in reversed(SUFFIXES):
            stem = F.substring(tok, F.lit(1), F.length(tok) - len(suffix))
            cut = F.array(stem, F.right(tok, F.lit(len(suffix))))
            out = F.when(low.endswith(suffix) & (F.length(tok) > len(suffix)), cut).otherwise(out)
        for word, parts in CONTRACTIONS.items():
            out = F.when(low == word, F.array(*[F.lit(p) for p in parts])).otherwise(out)
        return out

    return F.flatten(F.transform(all_matches(text, WHITESPACE), one))


def _split(text: Column, separators: str) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), separators), lambda x: x != "")


def latin(text: Column) -> Column:
    """Runs without white space or punctuation that hold a Latin letter; numbers alone and lone marks go."""
    return F.filter(_split(text, r"[\s.,;:!?()\[\]{}\"«»„“”…]+"), lambda x: x.rlike(r"[A-Za-zÀ-ɏ]"))


def french(text: Column) -> Column:
    """Elided articles stand alone with their apostrophe, hyphens split, words on the keep list stay whole."""

    def one(tok: Column) -> Column:
        parts = F.filter(F.split(F.regexp_replace(tok, "(['’])", "$1\u0001"), "\u0001|-"), lambda x: x != "")
        return F.when(F.lower(tok).isin(*KEEP_WHOLE_FR), F.array(tok)).otherwise(parts)

    return F.flatten(F.transform(latin(text), one))


def _protected(text: Column, holds: list[tuple[str, str]], separators: str) -> Column:
    """Split after hiding separators that belong to a token, then bring them back."""
    for i, (pattern, _) in enumerate(holds):
        text = F.regexp_replace(text, pattern, f"$1{chr(0xE000 + i)}$2")
    out = _split(text, separators)
    for i, (_, char) in enumerate(holds):
        out = F.transform(out, _shown(chr(0xE000 + i), char))
    return out


def _shown(stand_in: str, char: str):
    return lambda x: F.replace(x, F.lit(stand_in), F.lit(char))


_MARKS = r"[\s.,;:!?¡¿()\[\]{}\"«»…]+"


def spanish(text: Column) -> Column:
    """Decimals keep their comma or point, ordinals their point."""
    return _protected(text, [(r"(\d),(\d)", ","), (r"(\d)\.(\d)", "."), (r"(\d)\.(º|ª)", ".")], _MARKS)


def portuguese(text: Column) -> Column:
    """Decimals, dates, spaced thousands and times are one token."""
    return _protected(text, [(r"(\d),(\d)", ","), (r"(\d)\.(\d)", "."), (r"(\d) (\d{3}\b)", " "), (r"(\d):(\d)", ":")], _MARKS)


def russian(text: Column) -> Column:
    """The abbreviations б/у and б/н stay whole."""
    return _protected(text, [(r"(?iu)(б)/(у|н)", "/")], r"[\s.,;:!?()\[\]{}\"«»…/]+")


def german(text: Column) -> Column:
    return _split(text, r"[\s.,;:!?()\[\]{}\"«»„“”…]+")


def semitic(text: Column) -> Column:
    """Arabic, Persian and Hebrew: also their comma, semicolon and question mark separate."""
    return _split(text, r"[\s.,;:!?()\[\]{}\"«»…،؛؟]+")


def japanese(text: Column) -> Column:
    """Runs of one script; a stand-in for a morphological tagger."""
    return all_matches(text, r"[\x{3041}-\x{309F}]+|[\x{30A0}-\x{30FF}]+|[\x{4E00}-\x{9FFF}]+|[A-Za-z0-9]+")


BY_LANGUAGE = {
    "en": english, "fr": french, "de": german, "es": spanish, "pt": portuguese, "ru": russian,
    "ja": japanese, "ar": semitic, "fa": semitic, "he": semitic,
}
