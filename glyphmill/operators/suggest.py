"""Suggestion strategies over a table of misspellings ``lang, query`` and a dictionary ``lang, word``.

Every strategy finds its candidates by an equi-join on a derived key, never by comparing all pairs: words within two
edits share a string that up to two deletions from each lead to, words of equal sound share a code, similar words share
n-grams. The exact measure then runs on the candidates alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphmill.functions import keyboard as K
from glyphmill.functions import metrics as M
from glyphmill.functions import strings as S
from glyphmill.operators import rank as R

SOFT_STOP = 10


def deletions(word: Column) -> Column:
    """The word without each of its characters."""
    return F.when(
        F.length(word) > 0,
        F.transform(
            F.sequence(F.lit(1), F.length(word)),
            lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))),
        ),
    ).otherwise(F.array().cast("array<string>"))


def neighbourhood(word: Column, depth: int) -> Column:
    """The word and all strings that up to ``depth`` deletions lead to."""
    level, out = F.array(word), F.array(word)
    for _ in range(depth):
        level = F.array_distinct(F.flatten(F.transform(level, deletions)))
        out = F.array_distinct(F.concat(out, level))
    return out


#: Words of up to so many letters are found by deletions, longer ones (junk, as a rule) by equal segments.
SHORT = 20


def edit_candidates(queries: DataFrame, words: DataFrame, most: int = 2, swaps: bool = True) -> DataFrame:
    """``lang, query, word`` of all pairs within ``most`` edits or swaps (and some others); without ``swaps`` exactly those
    within ``most`` plain edits. Pairs meet at several keys, so what is too far apart goes before repeats do.

    A query of L letters has about L * L / 2 strings within two deletions, so long ones take another way: a dictionary
    word of over SHORT letters is cut into segments, more than the edits can touch (a swap may touch two), so one stands
    unchanged in the query, shifted by ``most`` places at most.
    """
    w_short, q_short = words.where(F.length("word") <= SHORT), queries.where(F.length("query") <= SHORT + most)
    q = q_short.select("lang", "query", F.explode(neighbourhood(F.col("query"), most)).alias("key"))
    w = w_short.select("lang", "word", F.explode(neighbourhood(F.col("word"), most)).alias("key"))
    close = (F.col("query") != F.col("word")) & (F.levenshtein("query", "word", 2 * most if swaps else most) >= 0)
    near = q.join(w, ["lang", "key"]).where(close).select("lang", "query", "word")
    parts = 2 * most + 1
    begin = lambda size, i: F.floor(size * i / parts).cast("int")
    part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    w = words.where(F.length("word") > SHORT).withColumn("size", F.length("word")).withColumn("part", part)
    w = w.select("lang", "word", "size", "part", F.substring("word", begin(F.col("size"), F.col("part")) + 1, begin(F.col("size"), F.col("part") + 1) - begin(F.col("size"), F.col("part"))).alias("key"))
    q = queries.where(F.length("query") > SHORT - most).withColumn("size", F.explode(F.sequence(F.length("query") - most, F.length("query") + most))).where(F.col("size") > SHORT)
    q = q.withColumn("part", part).withColumn("shift", F.explode(F.sequence(F.lit(-most), F.lit(most))))
    at = begin(F.col("size"), F.col("part")) + F.col("shift")
    q = q.where(at >= 0).select("lang", "query", "size", "part", F.substring("query", at + 1, begin(F.col("size"), F.col("part") + 1) - begin(F.col("size"), F.col("part"))).alias("key"))
    long = q.distinct().join(w, ["lang", "size", "part", "key"]).where(close).select("lang", "query", "word")
    return near.unionByName(long).distinct()


def length_candidates(queries: DataFrame, words: DataFrame, most: int = 2) -> DataFrame:
    """``lang, query, word`` of all pairs whose lengths differ by at most ``most``: an equi-join on the length."""
    size = F.length("query")
    q = queries.withColumn("len", F.explode(F.sequence(size - most, size + most)))
    return q.join(words.withColumn("len", F.length("word")), ["lang", "len"]).select("lang", "query", "word")


def by_levenshtein(queries: DataFrame, words: DataFrame, most: int = 2, k: int = 5) -> DataFrame:
    """The k nearest words by plain edit distance, then alphabet."""
    near = edit_candidates(queries, words, most, swaps=False).withColumn("distance", F.levenshtein("query", "word"))
    w = Window.partitionBy("lang", "query").orderBy("distance", "word")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _suggestions(rows: DataFrame, source: str) -> DataFrame:
    """Adds what a plain set of suggestions has: confidence from the distance, and the similarity."""
    return rows.select(
        "lang", "query", "word", F.col("distance").cast("int").alias("distance"), S.confidence(F.col("distance")).alias("confidence"),
        F.lit(source).alias("source"), S.similarity(F.col("query"), F.col("word")).alias("ngram"),
    )


def pattern_bonus(query: Column, word: Column) -> Column:
    """300 where the word only doubles a letter of the query, 30 where it is longer and the query starts like it."""
    places = F.when(F.length(word) >= 2, F.sequence(F.lit(1), F.length(word) - 1)).otherwise(F.array().cast("array<int>"))
    doubled = F.exists(
        places,
        lambda i: (F.substring(word, i, F.lit(1)) == F.substring(word, i + 1, F.lit(1)))
        & (F.concat(F.substring(word, F.lit(1), i), F.substring(word, i + 2, F.length(word))) == query),
    )
    extends = query.startswith(F.substring(word, 1, 3)) & (F.length(word) > F.length(query))
    return F.when((F.length(word) == F.length(query) + 1) & doubled, 300).otherwise(0) + F.when(extends, 30).otherwise(0)


def edit_scores(queries: DataFrame, words: DataFrame, tiers: DataFrame | None = None, most: int = 2, layout: str = "QWERTY") -> DataFrame:
    """``lang, query, word, distance, score``: edits weighted by frequency, keyboard and typing patterns; less is better."""
    pairs = edit_candidates(queries, words, most)
    if most <= 2:
        distance = M.osa_within_two(F.col("query"), F.col("word"))
    else:
        pairs = pairs.where(F.levenshtein("query", "word", 2 * most) > 0)  # a swap saves one edit of two at most
        distance = M.osa_udf("query", "word")
    pairs = pairs.withColumn("distance", distance).where(F.col("distance") <= most)
    if tiers is not None:
        pairs = pairs.join(tiers.select("lang", "word", "bonus"), ["lang", "word"], "left")
    bonus = F.coalesce("bonus", F.lit(0)) if tiers is not None else F.lit(0)
    q, w = F.col("query"), F.col("word")
    score = (
        F.col("distance") * 1000.0 - bonus + K.penalty(q, w, layout) - M.swap_bonus(q, w) - pattern_bonus(q, w) + 50 * F.abs(F.length(q) - F.length(w))
    )
    return pairs.withColumn("score", score).select("lang", "query", "word", "distance", "score")


def edit_distance(
    queries: DataFrame, words: DataFrame, tiers: DataFrame | None = None, most: int = 2, min_confidence: float = 0.75,
    min_similarity: float = 0.70, min_results: int = 3, max_results: int = 10,
) -> DataFrame:
    """Edit-distance suggestions: scores scaled to confidences within a query; the first ``min_results`` always stay."""
    scored = edit_scores(queries, words, tiers, most)
    own = Window.partitionBy("lang", "query")
    low, high = F.min("score").over(own), F.max("score").over(own)
    scored = scored.withColumn("confidence", F.when(high > low, 1 - (F.col("score") - low) / (high - low)).otherwise(1.0))
    scored = scored.withColumn("ngram", S.similarity(F.col("query"), F.col("word")))
    place = F.row_number().over(own.orderBy("score", F.lower("word"), "word"))
    kept = scored.withColumn("place", place).where(
        (F.col("place") <= min_results) | ((F.col("confidence") >= min_confidence) & (F.col("ngram") >= min_similarity))
    )
    kept = kept.withColumn("place", F.row_number().over(own.orderBy("score", F.lower("word"), "word"))).where(F.col("place") <= max_results)
    return kept.select("lang", "query", "word", F.col("distance").cast("int").alias("distance"), "confidence", F.lit("edit_distance").alias("source"), "ngram")


def phonetic(queries: DataFrame, words: DataFrame, algorithm: str = "soundex", most: int = 2) -> DataFrame:
    """Words of equal sound within ``most`` plain edits; all count as distance 1."""
    code = S.soundex if algorithm == "soundex" else M.metaphone_udf
    q = queries.withColumn("code", code(F.col("query"))).where("code <> ''")
    w = words.withColumn("code", code(F.col("word"))).where("code <> ''")
    near = q.join(w, ["lang", "code"]).where("query <> word").where(F.levenshtein("query", "word", most).between(1, most))
    return _suggestions(near.withColumn("distance", F.lit(1)), "phonetic")


#: Queries and words of one language that one task compares: its tables and its output are bounded by them.
QUERY_BLOCK, WORD_BLOCK = 4_096, 32_768
BLOCK_TASKS = 96
#: Letters of a block up to which similarities are bounded by letters before pairs leave the task.
LETTERS = 128


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words in a row, and each word's length."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32), np.array([len(w) for w in words], np.int64)


def _bags(words: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word, n-gram and occurrence (the second of two equal ones told from the first) of all n-grams of some words."""
    codes, sizes = _codes(words)
    many = np.maximum(sizes - n + 1, 0)
    word = np.repeat(np.arange(len(words)), many)
    at = np.repeat(np.cumsum(sizes) - sizes, many) + np.arange(len(word)) - np.repeat(np.cumsum(many) - many, many)
    gram = np.zeros(len(word), np.uint64)
    for k in range(n):  # three code points of 21 bits are told apart for sure, more by 64 bits
        gram = gram * np.uint64(1 << 21 if n <= 3 else 0x9E3779B97F4A7C15) + codes[at + k].astype(np.uint64)
    order = np.lexsort((gram, word))
    word, gram = word[order], gram[order]
    new = np.ones(len(word), bool)
    new[1:] = (word[1:] != word[:-1]) | (gram[1:] != gram[:-1])
    place = np.arange(len(word))
    return word, gram, place - np.maximum.accumulate(np.where(new, place, 0))


def _ends(words: list[str], none: int) -> np.ndarray:
    """The first four and the last four letters of each word, the last one first; ``none`` where there are fewer."""
    pad = lambda w: [*map(ord, w[:4]), *[none] * (4 - len(w))]
    return np.array([pad(w) + pad(w[::-1]) for w in words], np.int64).reshape(-1, 8)


def _ngram_block(queries: list[str], words: list[str], n: int, least: float, min_similarity: float) -> Iterator[tuple[np.ndarray, ...]]:
    """Places of queries and words whose bags of n-grams overlap enough, and how many n-grams they share. Each query
    counts the words of its n-grams in an inverted index of the block. Pairs that cannot be similar enough are left out
    (some that are not stay)."""
    q_row, q_gram, q_nth = _bags(queries, n)
    w_row, w_gram, w_nth = _bags(words, n)
    grams = np.unique(w_gram)
    if not len(grams) or not len(q_gram):
        return
    deep = int(w_nth.max()) + 1
    ids = np.searchsorted(grams, w_gram) * deep + w_nth
    order = np.argsort(ids, kind="stable")
    posts, starts = w_row[order].astype(np.int32), np.searchsorted(ids[order], np.arange(len(grams) * deep + 1))
    hit = np.minimum(np.searchsorted(grams, q_gram), len(grams) - 1)
    known = (grams[hit] == q_gram) & (q_nth < deep)
    q_ids, q_rows = (hit * deep + q_nth)[known], q_row[known]
    begin = np.searchsorted(q_rows, np.arange(len(queries) + 1))
    q_size, w_size = (np.array([max(len(x) - n + 1, 0) for x in side], np.int64) for side in (queries, words))
    fold = lambda side: [x.lower() for x in side]
    q_low, w_low = fold(queries), fold(words)
    q_ends, w_ends, (q_codes, q_len), (w_codes, w_len) = _ends(q_low, -1), _ends(w_low, -2), _codes(q_low), _codes(w_low)
    letters = np.unique(q_codes)
    if few := len(letters) <= LETTERS:
        held = np.zeros((len(words), len(letters)), np.float32)
        at = np.minimum(np.searchsorted(letters, w_codes), len(letters) - 1)
        same = letters[at] == w_codes
        held[np.repeat(np.arange(len(words)), w_len)[same], at[same]] = 1
        counts = np.zeros((len(queries), len(letters)), np.float32)
        np.add.at(counts, (np.repeat(np.arange(len(queries)), q_len), np.searchsorted(letters, q_codes)), 1)

    def likely(q: int, w: np.ndarray) -> np.ndarray:
        longer = np.maximum(q_len[q], w_len[w])
        overlap = held[w] @ counts[q] if few else q_len[q]
        head, tail = (np.cumprod(w_ends[w, k : k + 4] == q_ends[q, k : k + 4], axis=1).sum(axis=1) for k in (0, 4))
        return overlap / longer + 0.15 * head + 0.05 * tail - 0.1 * np.abs(q_len[q] - w_len[w]) >= min_similarity - 1e-6

    for q in range(len(queries)):
        own = q_ids[begin[q] : begin[q + 1]]
        if not len(own):
            continue
        shared = np.bincount(np.concatenate([posts[starts[g] : starts[g + 1]] for g in own]), minlength=len(words))
        w = np.flatnonzero(shared >= max(1, math.ceil(least * q_size[q] - 1e-9)))
        w = w[shared[w] >= least * (q_size[q] + w_size[w] - shared[w]) - 1e-6]
        w = w[likely(q, w)] if len(w) else w
        if len(w):
            yield np.full(len(w), q, np.int32), w.astype(np.int32), shared[w].astype(np.int32)


def ngram(queries: DataFrame, words: DataFrame, n: int = 3, least: float = 0.3, min_similarity: float = 0.70) -> DataFrame:
    """Words whose bags of n-grams overlap, by an inverted index; equal bags are left out.

    Most words of a language share some n-gram, so pairs are not joined gram by gram: a block of queries meets a block
    of words in one task, which counts what they share in arrays. Only pairs with enough overlap become rows.
    """
    queries, words = (df.select("lang", c).where(F.col("lang").isNotNull() & (F.length(c) >= n)) for df, c in ((queries, "query"), (words, "word")))
    sizes = [df.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(c)) for df, c, most in ((queries, "q_blocks", QUERY_BLOCK), (words, "w_blocks", WORD_BLOCK))]
    blocks = F.broadcast(sizes[0].join(sizes[1], "lang"))  # one row for each language
    deal = lambda df, name, own, other, mine, far: df.join(blocks, "lang").select(
        "lang", name, F.pmod(F.xxhash64(name), own).cast("int").alias(mine), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(far)
    )
    q = deal(queries, "query", F.col("q_blocks"), "w_blocks", "q_block", "w_block")
    w = deal(words, "word", F.col("w_blocks"), "q_blocks", "w_block", "q_block")
    names = pa.schema([("lang", pa.string()), ("query", pa.string()), ("word", pa.string()), ("shared", pa.int32())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return names.empty_table()
        own, other = left.column("query").to_pylist(), right.column("word").to_pylist()
        found = list(_ngram_block(own, other, n, least, min_similarity))
        qs, ws, shared = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int32),) * 3
        lang = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(qs), np.int32)), pa.array([left.column("lang")[0].as_py()])).cast(pa.string())
        return pa.Table.from_arrays([lang, pa.array(own, pa.string()).take(pa.array(qs)), pa.array(other, pa.string()).take(pa.array(ws)), pa.array(shared)], schema=names)

    keys = ["lang", "q_block", "w_block"]
    # Blocks are few bytes and much work, so their number of tasks must not be cut down to what their bytes suggest.
    tasks = max(BLOCK_TASKS, int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    q, w = q.repartition(tasks, *keys), w.repartition(tasks, *keys)
    rows = q.groupBy(*keys).cogroup(w.groupBy(*keys)).applyInArrow(run, "lang string, query string, word string, shared int")
    union = F.length("query") + F.length("word") - 2 * (n - 1) - F.col("shared")
    rows = rows.withColumn("jaccard", F.col("shared") / union).where("query <> word").where(F.col("jaccard") >= least)
    distance = F.floor(F.round((1 - F.col("jaccard")) * 10, 9)).cast("int")
    found = _suggestions(rows.withColumn("distance", distance).where("distance > 0"), "ngram")
    return found.where(F.col("ngram") >= min_similarity)


def _swaps(word: Column) -> Column:
    return F.when(
        F.length(word) > 1,
        F.transform(
            F.sequence(F.lit(1), F.length(word) - 1),
            lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.lit(1)), F.substring(word, i, F.lit(1)), F.substring(word, i + 2, F.length(word))),
        ),
    ).otherwise(F.array().cast("array<string>"))


def _at(keys: Column, distance: int) -> Column:
    return F.transform(keys, lambda x: F.struct(x.alias("key"), F.lit(distance).alias("d")))


def symspell(queries: DataFrame, words: DataFrame, most: int = 2) -> DataFrame:
    """Deletion index: words by their single deletions and swaps, probed with the query's deletions and swaps."""
    low = F.lower("word")
    folded = words.select("lang", low.alias("word"))
    keys = F.array_distinct(F.concat(deletions(F.col("word")), _swaps(F.col("word"))))
    index = folded.withColumn("key", F.explode(keys)).where("key <> ''").where("key <> word").distinct()
    q = F.lower("query")
    level, seen = [F.array(q)], F.array(q)
    for _ in range(most):
        step = F.array_except(F.array_distinct(F.flatten(F.transform(level[-1], deletions))), seen)
        level.append(F.filter(step, lambda x: x != ""))
        seen = F.concat(seen, level[-1])
    steps = [_at(level[0], 1), _at(_swaps(q), 1), *[_at(level[i], i + 1) for i in range(1, most + 1)]]
    probes = queries.select("lang", "query", F.explode(F.concat(*steps)).alias("p")).select("lang", "query", "p.key", "p.d")
    from_index = probes.join(index, ["lang", "key"]).select("lang", "query", "word", F.col("d").alias("distance"))
    exact = queries.select("lang", "query", F.explode(F.concat(*[_at(level[i], i) for i in range(1, most + 1)])).alias("p"))
    direct = exact.select("lang", "query", F.col("p.key").alias("word"), F.col("p.d").alias("distance")).join(words.select("lang", low.alias("word")).distinct(), ["lang", "word"], "left_semi")
    found = from_index.unionByName(direct.select("lang", "query", "word", "distance")).where(F.lower("query") != F.col("word"))
    return _suggestions(found.groupBy("lang", "query", "word").agg(F.min("distance").alias("distance")), "symspell")


def _keyboard_step(word: Column) -> Column:
    """One key replaced by, or preceded by, a neighbour, or left out."""
    near = F.create_map(*[F.lit(x) for k, v in K.NEIGHBOURS.items() for x in (k, v)])

    def at(i: Column) -> Column:
        c = F.substring(word, i, F.lit(1))
        head, tail, rest = F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word)), F.substring(word, i, F.length(word))
        keys = F.coalesce(F.split(F.try_element_at(near, c), " "), F.array().cast("array<string>"))
        made = F.flatten(F.transform(keys, lambda k: F.array(F.concat(head, k, tail), F.concat(head, k, rest))))
        return F.when(F.size(keys) > 0, F.concat(made, F.array(F.concat(head, tail)))).otherwise(F.array().cast("array<string>"))

    return F.when(F.length(word) > 0, F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(word)), at)))).otherwise(F.array().cast("array<string>"))


def keyboard(queries: DataFrame, words: DataFrame, most: int = 2, min_similarity: float = 0.70, pairs: DataFrame | None = None) -> DataFrame:
    """Words that exactly two keyboard slips lead to, within two plain edits and of the similarity.

    The pairs that are near enough (``pairs``, where they are known already) come first, as they are few; the query's
    slips are then kept where they are one edit from the word, and one slip more must lead there.
    """
    near = edit_candidates(queries, words, most, swaps=False) if pairs is None else pairs
    near = near.where(F.levenshtein("query", "word", most).between(1, most) & (S.similarity(F.col("query"), F.col("word")) >= min_similarity))
    reached = near.withColumn("mid", F.explode(_keyboard_step(F.lower("query")))).where(F.levenshtein("mid", F.lower("word"), 1) >= 0)
    hit = reached.where(F.array_contains(_keyboard_step(F.col("mid")), F.lower("word"))).select("lang", "query", "word").distinct()
    return _suggestions(hit.withColumn("distance", F.levenshtein("query", "word")), "keyboard_proximity")


def quick(queries: DataFrame, words: DataFrame, prefix: int | None = None, k: int = 10) -> DataFrame:
    """Words that begin like the query (all but its last letter, three letters at least) within two plain edits."""
    size = F.lit(prefix) if prefix else F.greatest(F.length("query") - 1, F.lit(3))
    q = queries.withColumn("size", size).withColumn("key", F.substring(F.lower("query"), F.lit(1), F.col("size")))
    sizes = q.select("lang", "size").distinct()
    w = words.join(sizes, "lang").withColumn("key", F.substring(F.lower("word"), F.lit(1), F.col("size")))
    near = q.join(w, ["lang", "size", "key"]).withColumn("distance", F.levenshtein("query", "word", 2)).where("distance between 1 and 2")
    order = Window.partitionBy("lang", "query").orderBy("distance", "word")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("lang", "query", "word", "distance", "rank")


def trie_suggest(queries: DataFrame, words: DataFrame, k: int = 10) -> DataFrame:
    """Words that begin with the query first, then words within two edits; each word once."""
    q = queries.where("query <> ''").withColumn("key", F.col("query"))
    heads = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.substring("word", F.lit(1), i))
    starts = q.join(words.select("lang", "word", F.explode(heads).alias("key")), ["lang", "key"]).select("lang", "query", "word", F.lit(0).alias("part"))
    near = by_levenshtein(queries, words, 2, k).select("lang", "query", "word", F.col("distance").alias("part"))
    best = starts.unionByName(near).groupBy("lang", "query", "word").agg(F.min("part").alias("part"))
    order = Window.partitionBy("lang", "query").orderBy("part", "word")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


STRATEGIES = {
    "edit_distance": edit_distance,
    "phonetic": phonetic,
    "keyboard_proximity": keyboard,
    "ngram": ngram,
    "symspell": symspell,
}
DEFAULT = ("edit_distance", "phonetic", "keyboard_proximity", "ngram")


def register(name: str, strategy) -> None:
    """Add a strategy ``(queries, words) -> suggestions``."""
    STRATEGIES[name] = strategy


def generate(queries: DataFrame, words: DataFrame, names: tuple[str, ...] = DEFAULT, k: int = SOFT_STOP) -> DataFrame:
    """All named strategies for the queries that the dictionary lacks, as one ranked set."""
    unknown = queries.join(words.select("lang", F.col("word").alias("query")), ["lang", "query"], "left_anti")
    return R.top(R.union(*[STRATEGIES[n](unknown, words) for n in names]), k)


# --- language suggesters ----------------------------------------------------------------------------------------------

#: Letter groups that writers of a language confuse. Fixed values of this engine.
SUBSTITUTIONS = {
    "en": ("ie=ei", "ei=ie", "f=ph", "ph=f", "c=k", "k=c", "s=c", "s=z"),
    "de": ("ss=ß", "ß=ss", "ae=ä", "oe=ö", "ue=ü", "ä=e", "v=f", "f=v"),
    "fr": ("e=é", "é=e", "e=è", "c=ç", "a=à", "o=ô", "ph=f"),
    "es": ("b=v", "v=b", "n=ñ", "c=z", "z=c", "ll=y", "y=ll", "g=j"),
    "pt": ("c=ç", "a=ã", "o=õ", "s=z", "x=ch", "ch=x"),
    "ru": ("е=ё", "ё=е", "и=ы", "о=а", "а=о"),
}


def language_edits(queries: DataFrame, words: DataFrame, k: int = 10) -> DataFrame:
    """A letter doubled, a letter left out or a confusable group exchanged, where that gives a word."""
    q = F.col("query")
    double = F.transform(F.sequence(F.lit(1), F.length(q)), lambda i: F.concat(F.substring(q, F.lit(1), i), F.substring(q, i, F.length(q))))
    swaps = F.array().cast("array<string>")
    for lang, pairs in SUBSTITUTIONS.items():
        made = F.array(*[F.regexp_replace(q, p.split("=")[0], p.split("=")[1]) for p in pairs])
        swaps = F.when(F.col("lang") == lang, made).otherwise(swaps)
    tries = queries.where("query <> ''").select("lang", "query", F.explode(F.array_distinct(F.concat(double, deletions(q), swaps))).alias("word"))
    valid = tries.where("word <> query").join(words, ["lang", "word"], "left_semi").withColumn("distance", F.levenshtein("query", "word"))
    order = Window.partitionBy("lang", "query").orderBy("distance", "word")
    return valid.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("lang", "query", "word", "distance", "rank")


#: First parts that German compounds often have. Fixed values.
GERMAN_HEADS = (
    "Arbeits Baum Bau Bauern Berg Buch Dach Dollar Dorf Ein Frauen Feuer Finanz Flug Franz Frei Haupt Haus Hoch Jahr Jung Kinder Klein Konsum Land Lehr "
    "Leben Leute Mann MarktMein Milli Morgen Mutter Natur Papier Polizei Post Problem Recht Rhein Rot Sache Schule Schiff Schritt See Sozial Stadt Stein "
    "Steuer Strom Tag Teil Tier Tor Tour Typ Uhr Umwelt Unter Volk Wasser Weg Welt Zeit Wein"
).split()
#: Kana that are written for one another: what may stand for each. Fixed values.
KANA = (
    "あ=ああ い=いい う=うう え=ええ お=おお か=かが き=きぎ く=くぐ け=けげ こ=こご さ=さざ し=しじ す=すず せ=せぜ そ=そぞ た=ただ ち=ちぢ つ=つづ て=てで と=とど "
    "は=はば ひ=ひび ふ=ふぶ へ=へべ ほ=ほぼ ま=まま み=みみ む=むむ め=めめ も=もも や=やや ゆ=ゆゆ よ=よよ ら=らら り=りり る=るる れ=れれ ろ=ろろ わ=わわ を=お"
).split()


def german_compounds(queries: DataFrame, words: DataFrame) -> DataFrame:
    """``lang, query, word``: words of over ten letters that begin with a known first part, as two words, where both are
    in the dictionary."""
    spark = queries.sparkSession
    heads = spark.createDataFrame([(h,) for h in GERMAN_HEADS], "head string").distinct()
    own = words.select("lang", "word")
    heads = F.broadcast(heads.join(own.select("lang", F.col("word").alias("head")), "head"))  # at most the list above
    split = queries.where(F.length("query") > 10).join(heads, "lang").where(F.expr("startswith(query, head)"))
    split = split.withColumn("rest", F.expr("substring(query, length(head) + 1)"))
    good = split.join(own.select("lang", F.col("word").alias("rest")), ["lang", "rest"], "left_semi")
    return good.select("lang", "query", F.concat_ws(" ", "head", "rest").alias("word"))


def japanese(queries: DataFrame, words: DataFrame, k: int = 10) -> DataFrame:
    """Kana exchanged where that gives a word, then words within two edits (for two characters or more); each once."""
    near = F.create_map(*[F.lit(x) for pair in KANA for x in pair.split("=")])
    q = F.col("query")

    def at(i: Column) -> Column:
        other = F.try_element_at(near, F.substring(q, i, F.lit(1)))
        return F.concat(F.substring(q, F.lit(1), i - 1), other, F.substring(q, i + 1, F.length(q)))

    made = queries.where("query <> ''").select("lang", "query", F.posexplode(F.transform(F.sequence(F.lit(1), F.length(q)), at)).alias("place", "word"))
    made = made.where("word is not null").join(words, ["lang", "word"], "left_semi").select("lang", "query", "word", F.lit(0).alias("part"), "place")
    typed = by_levenshtein(queries.where(F.length("query") >= 2), words, 2, 2 * k).select("lang", "query", "word", F.lit(1).alias("part"), F.col("rank").alias("place"))
    once = made.unionByName(typed).groupBy("lang", "query", "word").agg(F.min(F.struct("part", "place")).alias("at"))
    order = Window.partitionBy("lang", "query").orderBy("at", "word")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("lang", "query", "word", "rank")


def chosen(settings: dict[str, dict]) -> tuple[str, ...]:
    """Names of the strategies that are enabled, by rising priority (100 where none is given), then by name.

    ``settings``: for each name ``enabled`` and ``priority``; what a name lacks has its default.
    """
    on = [n for n in STRATEGIES if settings.get(n, {}).get("enabled", n in DEFAULT)]
    return tuple(sorted(on, key=lambda n: (settings.get(n, {}).get("priority", 100), n)))
