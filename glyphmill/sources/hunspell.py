"""Affix dictionaries: the ``.aff`` file is parsed on the driver (a few thousand lines), the ``.dic`` file by Spark."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AFFIXES = "kind string, flag string, cross boolean, strip string, add string, cond string, flags array<string>"
#: Directives by what their value is. Fixed names.
FLAGS = (
    "FORBIDDENWORD", "NOSUGGEST", "KEEPCASE", "NEEDAFFIX", "CIRCUMFIX", "ONLYINCOMPOUND", "COMPOUNDFLAG", "COMPOUNDBEGIN", "COMPOUNDMIDDLE",
    "COMPOUNDEND", "COMPOUNDPERMITFLAG", "COMPOUNDFORBIDFLAG", "FORCEUCASE",
)
TEXTS = ("SET", "FLAG", "KEY", "TRY", "LANG", "IGNORE", "WORDCHARS")
NUMBERS = ("MAXDIFF", "MAXNGRAMSUGS", "MAXCPDSUGS", "COMPOUNDMIN", "COMPOUNDWORDMAX")
SWITCHES = (
    "COMPLEXPREFIXES", "FULLSTRIP", "NOSPLITSUGS", "CHECKSHARPS", "CHECKCOMPOUNDCASE", "CHECKCOMPOUNDDUP", "CHECKCOMPOUNDREP", "CHECKCOMPOUNDTRIPLE",
    "SIMPLIFIEDTRIPLE", "ONLYMAXDIFF",
)
PAIRS = ("REP", "ICONV", "OCONV", "PHONE", "CHECKCOMPOUNDPATTERN")
LISTS = ("BREAK", "COMPOUNDRULE", "MAP", "AF", "AM")


def split_flags(value: str, kind: str, aliases: list[list[str]] | None = None) -> list[str]:
    """Flags of a string: one character each, pairs (``long``) or numbers (``num``); a number may name an alias."""
    if aliases and value.isdigit():
        return aliases[int(value) - 1] if 0 < int(value) <= len(aliases) else []
    return re.findall({"long": "..", "num": r"\d+"}.get(kind, "."), value)


def parse_aff(text: str) -> tuple[dict, list[tuple]]:
    """Options and affix rules of an affix file. Unknown directives are ignored; an empty text has no rules.

    Of a table's lines the first one is its size. Without BREAK lines the option is absent, and defaults hold.
    """
    options: dict = {"FLAG": "short", "aliases": [], "IGNORE": "", "COMPLEXPREFIXES": False}
    lines = [x.split() for x in text.lstrip("\ufeff").splitlines() if x.strip() and not x.startswith("#")]
    tables: dict[str, list] = {}
    for key, *v in lines:
        if key in TEXTS and v:
            options[key] = " ".join(v) if key == "KEY" else v[0]
        elif key in SWITCHES:
            options[key] = True
        elif key in NUMBERS and v and v[0].isdigit():
            options[key] = int(v[0])
        elif key in FLAGS and v:
            options[key] = v[0]
        elif key in (*PAIRS, *LISTS):
            tables.setdefault(key, []).append(v)
    for key, rows in tables.items():
        rows = rows[1:]
        if key in PAIRS:
            options[key] = [(v[0], v[1] if len(v) > 1 else "") for v in rows if v]
        elif key == "MAP":
            options[key] = [[x or y for x, y in re.findall(r"\(([^)]+)\)|(.)", v[0])] for v in rows if v]
        elif key == "AF":
            options["aliases"] = [split_flags(v[0], options["FLAG"]) for v in rows if v]
        elif key == "AM":
            options["morphs"] = rows
        else:
            options[key] = [v[0] for v in rows if v]
    rules, cross = [], {}
    for key, *v in lines:
        if key not in ("SFX", "PFX") or len(v) < 3:
            continue
        if (key, v[0]) not in cross:
            cross[key, v[0]] = v[1] == "Y"
            continue
        add, _, own = v[2].partition("/")
        cond = v[3] if len(v) > 3 else "."
        cond = "" if cond == "." else cond.replace("-", r"\-")
        ignore = str.maketrans("", "", options["IGNORE"])
        rules.append((
            key, v[0], cross[key, v[0]], "" if v[1] == "0" else v[1], "" if add == "0" else add.translate(ignore),
            (f"^{cond}" if key == "PFX" else f"{cond}$") if cond else "", split_flags(own, options["FLAG"], options["aliases"]),
        ))
    return options, rules


def read_aff(spark: SparkSession, text: str) -> tuple[dict, DataFrame]:
    """Options and the table of affix rules."""
    options, rules = parse_aff(text)
    return options, spark.createDataFrame(rules, AFFIXES)


def parse_entry(line: str, options: dict) -> tuple[str, list[str], list[str]]:
    """Stem, flags and morphology of a line of a word file, as ``read_dic`` reads it."""
    head, *rest = re.split(r"\t|\s+(?=[A-Za-z]+:\S)", line.strip().lstrip("\ufeff"), maxsplit=1)
    m = re.match(r"(/.*|(?:[^/\\]|\\.)*)(?:/(.*))?$", head.strip())
    morph = rest[0].split() if rest else []
    if morph and morph[0].isdigit() and options.get("morphs"):
        morph = options["morphs"][int(morph[0]) - 1]
    stem = m[1].replace("\\/", "/").translate(str.maketrans("", "", options.get("IGNORE") or ""))
    return stem, split_flags(m[2] or "", options["FLAG"], options["aliases"]), morph


def read_dic(lines: DataFrame, options: dict, column: str = "value") -> DataFrame:
    """``stem, flags, morph`` of each line; blank lines are left out, and a first line (``line_no`` 1) that is a count.

    Lines without ``line_no`` (see ``sources.lines``) are taken as they come: a file's first row is its first line. Morphology starts at a tab or at `` xx:``; an escaped slash belongs to the stem, a leading one too.
    """
    first = F.col("line_no") == 1 if "line_no" in lines.columns else F.monotonically_increasing_id() == 0
    line = F.regexp_replace(F.trim(column), "^﻿", "")
    cut = F.regexp_extract(line, r"^(.*?)(?:\t|\s+(?=[A-Za-z]+:\S))(.*)$", 2)
    head = F.trim(F.when(cut == "", line).otherwise(F.regexp_extract(line, r"^(.*?)(?:\t|\s+(?=[A-Za-z]+:\S))", 1)))
    split = r"^(/.*|(?:[^/\\]|\\.)*)(?:/(.*))?$"
    stem = F.regexp_replace(F.regexp_extract(head, split, 1), r"\\/", "/")
    own = F.regexp_extract(head, split, 2)
    return (
        lines.where((F.trim(column) != "") & ~(first & F.trim(column).rlike("^﻿?[0-9]+$")))
        .select(stem.alias("stem"), _flags(own, options).alias("flags"), F.filter(F.split(cut, r"\s+"), lambda x: x != "").alias("morph"))
    )


def _flags(own: Column, options: dict) -> Column:
    pattern = {"long": "..", "num": "[0-9]+"}.get(options["FLAG"], "(?s).")
    found = F.regexp_extract_all(own, F.lit(pattern), F.lit(0))
    if not options["aliases"]:
        return found
    named = F.array(*[F.array(*map(F.lit, x)) if x else F.array().cast("array<string>") for x in options["aliases"]])
    return F.when(own.rlike("^[0-9]+$"), F.coalesce(F.get(named, own.try_cast("int") - 1), F.array().cast("array<string>"))).otherwise(found)
