"""Words against stems and affix rules, as joins over distinct words.

A word's endings (or beginnings) meet the rules' added strings in an equi-join, the stripped candidates meet the stems
in another; two levels of suffixes, prefixes and the cross product are a union of such joins. Rules are a table from
one file; neither side is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = r"^[0-9]+(\.[0-9]+)?$"
_NONE = "struct<flag:string,flags:array<string>,cross:boolean>"


def _caps(name: str) -> Column:
    """Letter case of a column: ``no``, ``all``, ``init`` (first only), ``huhinit`` or ``huh`` (mixed)."""
    first, rest = f"left({name}, 1)", f"substr({name}, 2)"
    return F.expr(
        f"case when {name} = lower({name}) then 'no' when {name} = upper({name}) then 'all' when {first} <> upper({first}) then 'huh'"
        f" when {rest} = lower({rest}) then 'init' else 'huhinit' end"
    )


def _strip(forms: DataFrame, rules: DataFrame, kind: str, slot: str) -> DataFrame:
    """Candidates of ``stem`` with one affix taken off; the affix goes to ``slot``."""
    suffix = kind == "SFX"
    own = rules.where(F.col("kind") == kind).select("add", "strip", "cond", F.struct("flag", "flags", "cross").alias("rule"))
    size = F.length("stem")
    piece = F.expr("right(stem, n)" if suffix else "left(stem, n)")
    cut = forms.withColumn("n", F.explode(F.sequence(F.lit(0), size))).withColumn("add", piece).join(own, "add")
    rest = F.expr("left(stem, length(stem) - n)" if suffix else "right(stem, length(stem) - n)")
    stem = F.concat(rest, "strip") if suffix else F.concat("strip", rest)
    cut = cut.withColumn("stem", stem).where((F.col("cond") == "") | F.expr("stem rlike cond"))
    return cut.withColumn(slot, F.col("rule")).select(*forms.columns)


def _suffixed(forms: DataFrame, rules: DataFrame) -> DataFrame:
    """One or two suffixes; the inner one must carry the outer one's flag."""
    one = _strip(forms, rules, "SFX", "s")
    two = _strip(one.withColumn("s2", F.col("s")), rules, "SFX", "s").where("array_contains(s.flags, s2.flag)")
    return one.unionByName(two)


def forms(words: DataFrame, rules: DataFrame, complex_prefixes: bool = False) -> DataFrame:
    """``word, text, caps, stem, s, s2, p, p2``: every way to take affixes off each case variant of the words."""
    caps = _caps("word")
    capital = F.expr("concat(upper(left(word, 1)), lower(substr(word, 2)))")
    variants = (
        F.when(F.col("caps") == "init", F.array("word", F.lower("word")))
        .when(F.col("caps") == "all", F.array("word", F.lower("word"), capital))
        .when(F.col("caps") == "huhinit", F.array("word", F.expr("concat(lower(left(word, 1)), substr(word, 2))")))
        .otherwise(F.array("word"))
    )
    bare = words.select("word").where("word <> ''").distinct().withColumn("caps", caps).withColumn("text", F.explode(F.array_distinct(variants)))
    bare = bare.withColumn("stem", F.col("text")).select("*", *[F.lit(None).cast(_NONE).alias(c) for c in ("s", "s2", "p", "p2")])
    one = _strip(bare, rules, "PFX", "p")
    before = one
    if complex_prefixes:
        before = one.unionByName(_strip(one.withColumn("p2", F.col("p")), rules, "PFX", "p").where("array_contains(p.flags, p2.flag)"))
    both = _suffixed(before.where("p.cross"), rules).where("s.cross and (s2 is null or s2.cross)")
    return bare.unionByName(_suffixed(bare, rules)).unionByName(before).unionByName(both)


def _has(flags: Column, options: dict, name: str) -> Column:
    return F.coalesce(F.array_contains(flags, options[name]), F.lit(False)) if options.get(name) else F.lit(False)


def good_forms(words: DataFrame, stems: DataFrame, rules: DataFrame, options: dict, allow_nosuggest: bool = True) -> DataFrame:
    """The forms, with ``entry, root_flags``, whose stem is in the dictionary and whose flags allow them."""
    entries = stems.select(F.col("stem").alias("entry"), F.col("flags").alias("root_flags"), F.lower("stem").alias("low"))
    found = forms(words, rules, options.get("COMPLEXPREFIXES", False))
    banned = entries.where(_has(F.col("root_flags"), options, "FORBIDDENWORD")).select(F.col("entry").alias("stem")).distinct()
    affixed = F.col("s").isNotNull() | F.col("p").isNotNull()
    found = found.where(~affixed).unionByName(found.where(affixed).join(banned, "stem", "left_anti").select(*found.columns))
    exact = found.join(entries, F.col("stem") == F.col("entry"))
    # In capitals, an all-lower variant also meets entries that differ in case.
    loose = found.where("caps = 'all' and text = lower(text)").join(entries.where("entry <> low"), F.lower("stem") == F.col("low"))
    rows = exact.unionByName(loose)
    root, none = F.col("root_flags"), F.array().cast("array<string>")
    flags = F.concat(root, F.coalesce("p.flags", none), F.coalesce("s.flags", none))
    ok = F.coalesce(F.array_contains(flags, F.col("p.flag")), F.lit(True)) & F.coalesce(F.array_contains(flags, F.col("s.flag")), F.lit(True))
    if not allow_nosuggest:
        ok &= ~_has(root, options, "NOSUGGEST")
    ok &= ~_has(root, options, "KEEPCASE") | (_caps("entry") == F.col("caps"))
    each = [F.col(c).isNull() | _has(F.col(f"{c}.flags"), options, "NEEDAFFIX") for c in ("s", "s2", "p", "p2")]
    ok &= ~(_has(root, options, "NEEDAFFIX") & ~affixed) & ~(affixed & each[0] & each[1] & each[2] & each[3])
    ok &= _has(F.col("s.flags"), options, "CIRCUMFIX") == _has(F.col("p.flags"), options, "CIRCUMFIX")
    return rows.where(ok & ~_has(flags, options, "ONLYINCOMPOUND")).drop("low")


def check(words: DataFrame, stems: DataFrame, rules: DataFrame, options: dict, separator: str = "-") -> DataFrame:
    """``word, correct`` for every distinct word.

    Words that the dictionary only forbids are wrong and numbers are right. Otherwise some split at separators must
    have only parts that are empty or have a good form. Nulls are left out; the empty word is right.
    """
    ignored = options.get("IGNORE") or ""
    asked = words.select("word").where("word is not null").distinct().withColumn("clean", F.translate("word", ignored, "") if ignored else F.col("word"))
    asked = asked.withColumn("parts", F.split("clean", f"\\Q{separator}\\E", -1))
    n = F.size("parts")
    spans = asked.withColumn("i", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("j", F.explode(F.sequence(F.col("i") + 1, n)))
    spans = spans.select("word", "i", "j", F.array_join(F.slice("parts", F.col("i") + 1, F.col("j") - F.col("i")), separator).alias("span"))
    right = good_forms(spans.select(F.col("span").alias("word")), stems, rules, options).select(F.col("word").alias("span")).distinct()
    good = spans.join(right, "span", "left_semi").select("word", "i", "j").unionByName(spans.where("span = ''").select("word", "i", "j"))
    good = good.groupBy("word").agg(F.collect_set(F.concat_ws(":", "i", "j")).alias("good"))
    reach = F.expr(
        "element_at(aggregate(sequence(1, size(parts)), array(true), (acc, j) -> concat(acc, array(exists(sequence(0, j - 1),"
        " i -> acc[i] and array_contains(good, concat(i, ':', j)))))), -1)"
    )
    per_stem = stems.groupBy(F.col("stem").alias("word")).agg(F.min(_has(F.col("flags"), options, "FORBIDDENWORD")).alias("banned"))
    return asked.join(good, "word", "left").join(per_stem, "word", "left").select(
        "word",
        (~F.coalesce("banned", F.lit(False)) & (F.col("clean").rlike(NUMBER) | F.coalesce(reach, F.lit(False)))).alias("correct"),
    )
