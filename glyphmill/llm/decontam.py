"""Benchmark decontamination by size-partitioned MinHash containment search (operator 9).

Items are partitioned by size (distinct word shingles) into classes whose bounds double. An item's sketch is its
smallest hashes under one random permutation; how many depends on the class: one more than the shingles that an item
of the class may miss at the threshold. So a document that contains the item holds at least one hash of the sketch,
whatever the document's length: no candidate is lost. A document's shingles probe the sketches of all classes,
candidates with too few sketch hits for their class are dropped, and the rest are verified on the shingles themselves.

How it scales: documents are read once and never shuffled; the items go to the workers as a broadcast of at most
``BLOCK_CHARS`` characters, and a larger benchmark is searched block by block.

Words are maximal runs of letters and digits, lower-cased, so punctuation between them does not hide a copy. A text
with fewer words than a shingle is one shingle; null, empty and wordless texts have none and match nothing. Repeated
items and documents are reported each; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import filter_batches, map_batches, on_workers

BLOCK_CHARS = 32_000_000
WORD_CACHE = 300_000
_WORDS = regex.compile(r"[\p{L}\p{N}]+").findall
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    return _WORDS((text or "").lower())


def shingles(toks: list[str], size: int) -> set[tuple[str, ...]]:
    return {tuple(toks[i : i + size]) for i in range(max(1, len(toks) - size + 1))} if toks else set()


class WordHashes:
    """Hashes of a text's shingles, combined from remembered hashes of its words."""

    def __init__(self, size: int) -> None:
        self.size, self.known = size, {}

    def __call__(self, toks: list) -> np.ndarray:
        return self.combine(self.of(toks), self.size)

    def of(self, toks: list) -> np.ndarray:
        """Hashes of the words (strings or bytes)."""
        known = self.known
        if len(known) > WORD_CACHE:
            known.clear()
        one = []
        for w in toks:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w)
            one.append(h)
        return np.array(one, np.uint64)

    @staticmethod
    def combine(h: np.ndarray, size: int) -> np.ndarray:
        if not len(h):
            return h
        n, width = max(1, len(h) - size + 1), min(size, len(h))
        out = np.full(n, width, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(width):
                out = (out ^ h[i : i + n]) * _ODD
                out ^= out >> np.uint64(29)
        return out


class SketchIndex:
    """The items of one block: sketches by size class, and the shingles to verify with."""

    def __init__(self, items: list[tuple], threshold: float, size: int) -> None:
        self.items, hashes = [], WordHashes(size)
        owners: dict[int, list[int]] = defaultdict(list)
        for key, text in items:
            toks = words(text)
            exact = shingles(toks, size)
            if not exact:
                continue
            values = np.unique(hashes(toks))
            upper = 1 << (len(exact) - 1).bit_length()  # of the size class
            sketch = np.sort(values)[: math.floor((1 - threshold) * upper + 1e-9) + 1].tolist()
            may_miss = math.floor((1 - threshold) * len(exact) + 1e-9)
            at = len(self.items)
            self.items.append((key, exact, max(1, len(sketch) - may_miss)))
            for value in sketch:
                owners[value].append(at)
        self.probes = np.array(sorted(owners), np.uint64)
        self.owners = [owners[v] for v in self.probes.tolist()]

    def candidates(self, values: np.ndarray) -> list[int]:
        if not len(self.probes) or not len(values):
            return []
        at = np.minimum(np.searchsorted(self.probes, values), len(self.probes) - 1)
        hits: dict[int, int] = defaultdict(int)
        for p in np.unique(at[self.probes[at] == values]).tolist():
            for item in self.owners[p]:
                hits[item] += 1
        return [i for i, n in sorted(hits.items()) if n >= self.items[i][2]]


def _verified(index: SketchIndex, hashes: WordHashes, text: str | None, threshold: float) -> list[tuple]:
    """``(item, its shingles, shared)`` for every item that the text holds."""
    toks, rows = words(text), []
    if found := index.candidates(hashes(toks)):
        own = shingles(toks, hashes.size)
        for i in found:
            item, exact, _ = index.items[i]
            both = len(exact & own)
            if both >= threshold * len(exact) - 1e-9:
                rows.append((item, len(exact), both))
    return rows


def _blocks(items: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple]]:
    """The items, at most about BLOCK_CHARS characters at a time."""
    slim = items.select(F.col(item_col).alias("item"), F.col(text_col).alias("text"))
    chars = slim.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = math.ceil(chars / BLOCK_CHARS) or 1
    for b in range(blocks):
        part = slim if blocks == 1 else slim.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        yield [(r["item"], r["text"]) for r in part.collect()]


def search(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = 0.8,
    shingle: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``id, item, item_shingles, shared, containment`` for each document that holds at least ``threshold`` of an item."""
    kind, item_type, found = dict(docs.dtypes)[id_col], dict(items.dtypes)[item_col], None
    schema = f"id {kind}, item {item_type}, item_shingles bigint, shared bigint, containment double"
    names = ("id", "item", "item_shingles", "shared", "containment")
    for block in _blocks(items, item_col, item_text_col):
        load = on_workers(docs.sparkSession, block, lambda x: (SketchIndex(x, threshold, shingle), WordHashes(shingle)))

        def run(ids: list, texts: list, load=load) -> dict[str, list]:
            index, hashes = load()
            rows = [
                (key, item, n, both, both / n)
                for key, text in zip(ids, texts, strict=True)
                for item, n, both in _verified(index, hashes, text, threshold)
            ]
            return {name: [r[i] for r in rows] for i, name in enumerate(names)}

        hits = map_batches(docs, run, [id_col, text_col], schema)
        found = hits if found is None else found.unionByName(hits)
    return found.withColumnRenamed("id", id_col).withColumnRenamed("item", item_col)


def keep_clean(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = 0.8,
    shingle: int = 5,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """The documents, with all their columns, that hold no item."""
    for block in _blocks(items, item_col, item_text_col):
        load = on_workers(docs.sparkSession, block, lambda x: (SketchIndex(x, threshold, shingle), WordHashes(shingle)))

        def keep(texts: list, load=load) -> list[bool]:
            index, hashes = load()
            return [not _verified(index, hashes, t, threshold) for t in texts]

        docs = filter_batches(docs, keep, text_col)
    return docs
