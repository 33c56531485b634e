"""Masked pseudo-likelihood by a bidirectional window network (operator 4), trained in numpy.

Every token is predicted from the ``SIDE`` tokens on its left and on its right, never from itself. The output is a
two-level softmax: the class, then the member of the class. The ``OWN`` most frequent words are members themselves, so
their whole probability depends on the context. The other words share ``WIDTH`` members by spelling (length and last
byte); inside such a group a word's probability is its share of what the *rest* of the corpus counts for the group
(the document's own occurrences are left out), smoothed by a byte-pair model of spelling. The sum of the tokens'
log-probabilities is the document's pseudo-log-likelihood.

What is gathered covers all documents and grows with them. Word counts are a distributed table of all words, never cut:
the ``HELD`` most frequent ones travel to the workers, the rest are joined to the documents that use them. For training
one position in ``MASK``, chosen by hash, is masked in every document; the masked positions are dealt to shards by the
documents' hashes, about ``SHARD`` each, so shards and weights do not depend on how the table is split. Each round trains
every shard from the same weights, and the shards' weights are averaged by positions. Only the weights and the held
words have a fixed size.

Tokens are maximal runs of ASCII letters, digits, ``_`` and non-ASCII characters, or of other ASCII characters without
white space, lower-cased; words are told apart by 64-bit hashes.

Edge cases: a null, empty or tokenless text has no tokens, log-likelihood 0 and a null mean; repeated rows are scored
each, and count as other documents; very long texts are read whole; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import BATCH_ROWS, HashTable, Powers, checkpointed, map_batches, mix, on_workers, parts

SIDE, HIDDEN, WIDTH = 2, 16, 64
OWN = WIDTH * (WIDTH - 1)
HELD = 262_144
MASK, SHARD, ROUNDS = 8, 1_000_000, 2
BATCH, RATE = 2048, 0.1
CHUNK = 4096
FLUSH_WORDS = 400_000
BASE = 0x9E3779B97F4A7C15
STEPS = [*range(-SIDE, 0), *range(1, SIDE + 1)]
_TOKENS = re.compile(rb"[0-9a-z_\x80-\xff]+|[^0-9a-z_\x80-\xff\s]+").findall
_KIND = np.full(256, 2, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[[95, *range(48, 58), *range(97, 123), *range(128, 256)]] = 1
_POWERS = Powers(BASE)


def tokens(text: str | None) -> list[bytes]:
    return _TOKENS((text or "").lower().encode())


@dataclass
class Words:
    """The tokens of some texts, one after another: text, hash, group of spelling, and place in the bytes."""

    doc: np.ndarray
    hash: np.ndarray
    group: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray
    sizes: np.ndarray

    def __len__(self) -> int:
        return len(self.doc)


def read(texts: list[str | None]) -> Words:
    """All tokens of the texts, found and hashed in one sweep over their joined bytes."""
    raw = [(t or "").lower().encode() for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    kind = _KIND[data]
    edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    start = np.concatenate(([0], edge))
    end = np.concatenate((edge, [len(data)]))
    some = kind[start] > 0
    start, end = start[some], end[some]
    up, down = _POWERS.of(len(data) + 1)
    pre = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])))
    hashes = mix((pre[end] - pre[start]) * down[start])
    ends = np.cumsum([len(r) + 1 for r in raw])
    doc = np.searchsorted(ends, start, side="right")
    group = np.minimum((end - start) // 2, 7) * 8 + (data[end - 1] & 7)
    return Words(doc, hashes, group.astype(np.int64), start, end, data, np.bincount(doc, minlength=len(texts)))


def byte_pairs(words: Words) -> np.ndarray:
    """How often each byte follows another inside the tokens; 256 marks both ends."""
    inside = np.flatnonzero((_KIND[words.data[1:]] == _KIND[words.data[:-1]]) & (_KIND[words.data[1:]] > 0))
    pair = words.data[inside].astype(np.int64) * 257 + words.data[inside + 1]
    first, last = 256 * 257 + words.data[words.start].astype(np.int64), words.data[words.end - 1].astype(np.int64) * 257 + 256
    return np.bincount(np.concatenate((pair, first, last)), minlength=257 * 257)


class Lexicon:
    """Outputs of the network, counts of the held words, mass of the groups, and the model of spelling."""

    def __init__(self, top: list[tuple[int, int]], groups: dict[int, tuple[int, int]], pairs: np.ndarray) -> None:
        """``top``: hashes (signed) and counts by falling count; ``groups``: tokens and distinct words of each group
        among the words without an output of their own."""
        keys, counts = (np.array([x[i] for x in top], np.int64) for i in (0, 1))
        self.table = HashTable(keys.view(np.uint64), np.arange(len(keys)), -1)
        self.counts = np.append(counts, 0).astype(np.float64)  # the last one for words that aren't held
        mass = np.ones(WIDTH * WIDTH)
        own = counts[:OWN]
        mass[: len(own)] += own
        self.mass, self.kinds = np.zeros(WIDTH), np.ones(WIDTH)
        for g, (n, kinds) in groups.items():
            self.mass[g], self.kinds[g] = n, kinds + 1
        mass[OWN:] += self.mass
        self.out_mass = mass
        counted = pairs.reshape(257, 257)
        self.pairs = np.log((counted + 0.5) / (counted.sum(axis=1, keepdims=True) + 128.5)).ravel()

    def places(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each token among the held words (-1: not held), and its output."""
        rank = self.table(words.hash)
        return rank, np.where((rank >= 0) & (rank < OWN), rank, OWN + words.group)

    def spell(self, words: Words, at: np.ndarray) -> np.ndarray:
        """Log-probability of the bytes and the end of the tokens at these places."""
        data = words.data.astype(np.int64)
        within = np.concatenate(([0.0], np.cumsum(self.pairs[data[:-1] * 257 + data[1:]])))
        a, b = words.start[at], words.end[at] - 1
        return self.pairs[256 * 257 + data[a]] + within[b] - within[a] + self.pairs[data[b] * 257 + 256]


def contexts(words: Words, outputs: np.ndarray) -> np.ndarray:
    """Outputs, plus 1, of each token's neighbours in its text; 0 where there is none."""
    place = np.arange(len(words)) + SIDE * (words.doc + 1)
    padded = np.zeros(len(words) + SIDE * (len(words.sizes) + 1), np.uint16)
    padded[place] = outputs + 1
    return np.stack([padded[place + k] for k in STEPS])


class WindowNet:
    """One table of hidden contributions for each side position, tanh, and a softmax of two levels."""

    def __init__(self, mass: np.ndarray, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        mass = mass.reshape(WIDTH, WIDTH)
        draw = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
        self.p = {
            "tables": draw(len(STEPS), WIDTH * WIDTH + 1, HIDDEN),
            "w1": draw(HIDDEN, WIDTH),
            "b1": np.log(mass.sum(axis=1)).astype(np.float32),
            "w2": draw(WIDTH, HIDDEN, WIDTH),
            "b2": np.log(mass / mass.sum(axis=1, keepdims=True)).astype(np.float32),
        }
        self.p["b1"] -= np.float32(np.log(mass.sum()))
        self.sums = {k: np.full(v.shape, 1e-4, np.float32) for k, v in self.p.items()}

    def vector(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def load(self, vector: np.ndarray) -> WindowNet:
        at = 0
        for k, v in self.p.items():
            self.p[k] = vector[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size
        return self

    def _hidden(self, ctx: np.ndarray) -> np.ndarray:
        total = self.p["tables"][0][ctx[0]]
        for k in range(1, len(STEPS)):
            total += self.p["tables"][k][ctx[k]]
        return np.tanh(total, out=total)

    def log_prob(self, ctx: np.ndarray, outputs: np.ndarray) -> np.ndarray:
        """Log-probability of each output in its context."""
        out = np.empty(len(outputs))
        for i in range(0, len(outputs), 16_384):
            group, member = np.divmod(outputs[i : i + 16_384], WIDTH)
            order = np.argsort(group.astype(np.uint8), kind="stable")
            group, member = group[order], member[order]
            h = self._hidden(ctx[:, i : i + 16_384][:, order])
            s = h @ self.p["w1"]
            s += self.p["b1"]
            own = s[np.arange(len(group)), group]
            np.exp(s, out=s)
            value = own - np.log(s.sum(axis=1))
            cuts = np.searchsorted(group, np.arange(WIDTH + 1)).tolist()
            for c, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if a < b:
                    s = h[a:b] @ self.p["w2"][c]
                    s += self.p["b2"][c]
                    own = s[np.arange(b - a), member[a:b]]
                    np.exp(s, out=s)
                    value[a:b] += own - np.log(s.sum(axis=1))
            out[i + order] = value
        return out

    def _move(self, name: str, grad: np.ndarray, at: object = slice(None)) -> None:
        """A step of the size RATE over the root of all squares so far."""
        total = self.sums[name][at] + grad * grad
        self.sums[name][at] = total
        self.p[name][at] -= np.float32(RATE) * grad / np.sqrt(total)

    def train(self, ctx: np.ndarray, outputs: np.ndarray) -> None:
        """One gradient step."""
        group, member = np.divmod(outputs, WIDTH)
        order = np.argsort(group, kind="stable")
        group, member, ctx = group[order], member[order], ctx[:, order]
        n = len(group)
        h = self._hidden(ctx)
        d = np.exp(h @ self.p["w1"] + self.p["b1"])
        d /= d.sum(axis=1, keepdims=True)
        d[np.arange(n), group] -= 1
        d /= n
        back = d @ self.p["w1"].T
        cuts = np.searchsorted(group, np.arange(WIDTH + 1)).tolist()
        for c, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if a < b:
                e = np.exp(h[a:b] @ self.p["w2"][c] + self.p["b2"][c])
                e /= e.sum(axis=1, keepdims=True)
                e[np.arange(b - a), member[a:b]] -= 1
                e /= n
                back[a:b] += e @ self.p["w2"][c].T
                self._move("w2", h[a:b].T @ e, c)
                self._move("b2", e.sum(axis=0), c)
        back *= 1 - h * h
        self._move("w1", h.T @ d)
        self._move("b1", d.sum(axis=0))
        for k in range(len(STEPS)):
            turn = np.argsort(ctx[k], kind="stable")  # 16-bit ids sort by radix
            own = ctx[k][turn]
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            rows = own[first].astype(np.int64)
            grad = np.add.reduceat(back[turn], first, axis=0)
            total = self.sums["tables"][k, rows] + grad * grad
            self.sums["tables"][k, rows] = total
            self.p["tables"][k, rows] -= np.float32(RATE) * grad / np.sqrt(total)


def _group(h: np.ndarray, groups: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(h, kind="stable")
    h = h[order]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.empty(0, np.int64)
    return h[first], groups[order][first], np.add.reduceat(counts[order], first) if len(h) else counts


def word_counts(df: DataFrame, text_col: str = "text") -> tuple[DataFrame, np.ndarray]:
    """``word, grp, n`` over all documents (the word's hash, its group of spelling), and how often each byte follows
    another, 257 x 257. Each task sums its own words first."""
    names = ["word", "grp", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(h: np.ndarray, g: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(g.astype(np.int32)), pa.array(n)], names)

        pairs = np.zeros(257 * 257, np.int64)
        none = (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
        held, waiting, many = none, [], 0
        for batch in batches:
            for part in parts(batch):
                w = read(part.column(0).to_pylist())
                pairs += byte_pairs(w)
                waiting.append(_group(w.hash, w.group, np.ones(len(w), np.int64)))
                many += len(waiting[-1][0])
                if many > FLUSH_WORDS:
                    held = _group(*(np.concatenate(x) for x in zip(held, *waiting, strict=True)))
                    waiting, many = [], 0
                    if len(held[0]) > 2 * FLUSH_WORDS:
                        yield out(*held)
                        held = none
        yield out(*_group(*(np.concatenate(x) for x in zip(held, *waiting, strict=True))))
        at = np.flatnonzero(pairs)  # group -1: pairs of bytes, 257 x 257 rows a task at most
        yield out(at.astype(np.uint64), np.full(len(at), -1), pairs[at])

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    each = df.select(text_col).mapInArrow(run, "word bigint, grp int, n bigint")
    counts = checkpointed(each.groupBy("word", "grp").agg(F.sum("n").alias("n")))
    pairs = np.zeros(257 * 257, np.int64)
    for r in counts.where("grp < 0").collect():
        pairs[r["word"]] = r["n"]
    return counts.where("grp >= 0"), pairs


def most_frequent(counts: DataFrame, how_many: int) -> DataFrame:
    """The most frequent words. A histogram of counts says from where on they lie, so that no more than these and the
    ties of one bin are sorted, however many tasks hold the counts."""
    bin_ = F.floor(F.log2("n") * 64).cast("int")
    sizes = {r["bin"]: r["count"] for r in counts.groupBy(bin_.alias("bin")).count().collect()}
    seen, least = 0, 0
    for b in sorted(sizes, reverse=True):
        seen, least = seen + sizes[b], b
        if seen >= how_many:
            break
    return counts.where(bin_ >= least).orderBy(F.col("n").desc(), "word").limit(how_many)


def lexicon(df: DataFrame, text_col: str = "text") -> tuple[Lexicon, DataFrame]:
    """The lexicon and ``word, n`` of all words. The driver gets the HELD most frequent words, WIDTH groups and the
    byte pairs."""
    counts, pairs = word_counts(df, text_col)
    top = most_frequent(counts, HELD).select("word", "grp", "n").toPandas()
    groups = {r["grp"]: [r["n"], r["kinds"]] for r in counts.groupBy("grp").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).collect()}
    for g, n in zip(top["grp"][:OWN].tolist(), top["n"][:OWN].tolist(), strict=True):
        groups[g][0] -= n
        groups[g][1] -= 1
    lex = Lexicon(list(zip(top["word"].tolist(), top["n"].tolist(), strict=True)), {g: tuple(x) for g, x in groups.items()}, pairs)
    return lex, counts.select("word", "n")


def masked(df: DataFrame, lex: Lexicon, shards: int, text_col: str = "text") -> DataFrame:
    """``shard, place, examples binary``: the masked positions of each text, as rows of 16-bit numbers: the contexts
    and the output."""
    load = on_workers(df.sparkSession, lex, lambda x: x)

    def run(places: list, texts: list) -> dict[str, list]:
        lex, blobs = load(), []
        words = read(texts)
        _, outputs = lex.places(words)
        rows = np.concatenate((contexts(words, outputs), outputs[None].astype(np.uint16))).T
        ends = np.cumsum(words.sizes)
        order = np.arange(len(words)) - np.repeat(ends - words.sizes, words.sizes)
        seed = np.array(places, np.int64).view(np.uint64)[words.doc]
        chosen = mix(seed + order.astype(np.uint64) * np.uint64(BASE)) % np.uint64(MASK) == 0
        rows, many = np.ascontiguousarray(rows[chosen]), np.bincount(words.doc[chosen], minlength=len(texts))
        cuts = np.concatenate(([0], np.cumsum(many))).tolist()
        blobs = [rows[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
        return {"shard": [p % shards for p in places], "place": places, "examples": blobs}

    place = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    slim = df.select(place.alias("place"), F.col(text_col).alias("text"))
    return map_batches(slim, run, ["place", "text"], "shard bigint, place bigint, examples binary").where(F.length("examples") > 0)


def train(df: DataFrame, lex: Lexicon, text_col: str = "text") -> WindowNet:
    """Rounds over all shards, from weights that give each output its share of the corpus."""
    net = WindowNet(lex.out_mass)
    spark, total = df.sparkSession, lex.out_mass.sum()
    shards = max(1, round(total / MASK / SHARD))
    examples = masked(df, lex, shards, text_col).repartition(shards, "shard").sortWithinPartitions("shard", "place")
    examples = checkpointed(examples)
    for _ in range(ROUNDS):
        load = on_workers(spark, (lex.out_mass, net.vector()), lambda x: x)

        def run(batches: Iterator[pa.RecordBatch], load=load) -> Iterator[pa.RecordBatch]:
            mass, vector = load()
            shard = own = None
            left, n = np.empty((0, len(STEPS) + 1), np.uint16), 0

            def out() -> Iterator[pa.RecordBatch]:
                if own is not None and n + len(left):
                    if len(left):
                        own.train(np.ascontiguousarray(left[:, :-1].T), left[:, -1].astype(np.int64))
                    new, size = own.vector(), n + len(left)
                    for k, at in enumerate(range(0, len(new), CHUNK)):
                        v = new[at : at + CHUNK].astype("<f4").tobytes()
                        yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([size]), pa.array([v])], ["k", "n", "v"])

            for batch in batches:
                for s, blob in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    if s != shard:
                        yield from out()
                        shard, own, left, n, waiting, many = s, WindowNet(mass).load(vector), left[:0], 0, [], 0
                    waiting.append(np.frombuffer(blob, np.uint16).reshape(-1, len(STEPS) + 1))
                    many += len(waiting[-1])
                    if many >= 16 * BATCH:
                        rows = np.concatenate([left, *waiting])
                        whole = len(rows) // BATCH * BATCH
                        for at in range(0, whole, BATCH):
                            own.train(np.ascontiguousarray(rows[at : at + BATCH, :-1].T), rows[at : at + BATCH, -1].astype(np.int64))
                        left, n, waiting, many = rows[whole:], n + whole, [], 0
                if shard is not None and waiting:
                    left, waiting, many = np.concatenate([left, *waiting]), [], 0
                    while len(left) >= BATCH:
                        own.train(np.ascontiguousarray(left[:BATCH, :-1].T), left[:BATCH, -1].astype(np.int64))
                        left, n = left[BATCH:], n + BATCH
            yield from out()

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            sizes: dict[int, int] = {}
            for batch in batches:
                for k, n, v in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    new = np.frombuffer(v, "<f4").astype(np.float64) * n
                    sums[k], sizes[k] = sums[k] + new if k in sums else new, sizes.get(k, 0) + n
            for k, v in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([(v / sizes[k]).tobytes()])], ["k", "v"])

        each = examples.mapInArrow(run, "k bigint, n bigint, v binary")
        means = each.repartition("k").mapInArrow(merge, "k bigint, v binary").collect()  # the weights, once
        if not means:
            break
        net.load(np.concatenate([np.frombuffer(r["v"], np.float64) for r in sorted(means, key=lambda r: r["k"])]))
    return net


_PARTS = "id {}, n_tokens bigint, total double, n_unseen bigint, rare array<struct<word: bigint, k: int, mass: double, spell: double>>"


def _inside(rank: np.ndarray, n: np.ndarray, k: np.ndarray, group: np.ndarray, spell: np.ndarray, lex: Lexicon) -> np.ndarray:
    """Log-probability within the group: counts of the rest of the corpus, smoothed by spelling."""
    kinds = lex.kinds[group]
    return np.log(np.maximum(n - k, 0) + kinds * np.exp(spell)) - np.log(np.maximum(lex.mass[group] - k, 0) + kinds)


def score(
    df: DataFrame, lex: Lexicon, counts: DataFrame, net: WindowNet, id_col: str = "doc_id", text_col: str = "text", counted: bool = True
) -> DataFrame:
    """``id, n_tokens, log_likelihood, mean_log_likelihood, n_unseen`` for every row; ``n_unseen`` is the number of
    tokens whose word no other document of the corpus has. ``counted``: the rows are part of the corpus."""
    load = on_workers(df.sparkSession, (lex, net.vector()), lambda x: (x[0], WindowNet(x[0].out_mass).load(x[1])))

    def some(keys: list, texts: list) -> dict[str, list]:
        lex, net = load()
        words = read(texts)
        rank, outputs = lex.places(words)
        total = np.bincount(words.doc, net.log_prob(contexts(words, outputs), outputs), len(texts))
        grouped = np.flatnonzero(outputs >= OWN)
        order = grouped[np.lexsort((words.hash[grouped], words.doc[grouped]))]
        doc, h = words.doc[order], words.hash[order]
        first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])))) if len(order) else order
        k = np.diff(np.append(first, len(order)))
        at, doc = order[first], doc[first]
        own, spell = rank[at], lex.spell(words, at)
        less = k * counted
        value = k * _inside(own, lex.counts[own], less, words.group[at], spell, lex)
        held = own >= 0
        total += np.bincount(doc[held], value[held], len(texts))
        unseen = np.bincount(doc[held], (k * (lex.counts[own] <= less))[held], len(texts)).astype(np.int64)
        at, k, doc, spell = at[~held], k[~held], doc[~held], spell[~held]
        kinds = lex.kinds[words.group[at]]
        mass = np.log(np.maximum(lex.mass[words.group[at]] - k * counted, 0) + kinds)
        cuts = np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32)
        fields = [pa.array(words.hash[at].view(np.int64)), pa.array(k.astype(np.int32)), pa.array(mass), pa.array(np.log(kinds) + spell)]
        rare = pa.ListArray.from_arrays(pa.array(cuts), pa.StructArray.from_arrays(fields, ["word", "k", "mass", "spell"]))
        return {"id": keys, "n_tokens": words.sizes.tolist(), "total": total.tolist(), "n_unseen": unseen.tolist(), "rare": rare}

    kind = dict(df.dtypes)[id_col]
    rows = map_batches(df, some, [id_col, text_col], _PARTS.format(kind))
    rows = checkpointed(rows.withColumn("row", F.monotonically_increasing_id()))
    rare = rows.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.k", "r.mass", "r.spell").join(counts, "word", "left")
    others = F.greatest(F.coalesce("n", F.lit(0)) - (F.col("k") if counted else F.lit(0)), F.lit(0))
    rare = rare.groupBy("row").agg(
        F.sum(F.col("k") * (F.log(others + F.exp("spell")) - F.col("mass"))).alias("more"), F.sum(F.when(others == 0, F.col("k")).otherwise(0)).alias("new")
    )
    likelihood = F.col("total") + F.coalesce("more", F.lit(0.0))
    return rows.join(rare, "row", "left").select(
        F.col("id").alias(id_col),
        "n_tokens",
        likelihood.alias("log_likelihood"),
        F.when(F.col("n_tokens") > 0, likelihood / F.col("n_tokens")).alias("mean_log_likelihood"),
        (F.col("n_unseen") + F.coalesce("new", F.lit(0))).alias("n_unseen"),
    )


def pseudo_likelihood(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Count, train and score in one call."""
    lex, counts = lexicon(df, text_col)
    return score(df, lex, counts, train(df, lex, text_col), id_col, text_col)
