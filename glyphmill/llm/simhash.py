"""SimHash near-duplicates over a Gray-order hierarchical index (operator 3).

A fingerprint has 64 bits; two within ``max_bits`` differing bits are linked. Five bit segments cannot all differ
when at most four bits do, so every distinct fingerprint is routed once by each of its ``max_bits + 1`` segments and
each pair meets in some group. Inside a group the fingerprints are sorted by Gray rank and indexed: the bits that all
members of a node share are factored into it, a child keeps only what its parent does not say yet, and a search adds
up the differences on the way down and drops a whole node once they exceed the limit. A search also drops a node whose
members are all in the searcher's component already, so a group of copies costs no more than its size.

How it scales: copies share one fingerprint and are reduced to it before anything else. A group with more than
``GROUP_ROWS`` fingerprints is routed again by the segments of the remaining bits, and what is still larger is dealt
as pairs of blocks, so no task gets an unbounded group and no pair is lost. A group emits a forest, not its pairs.

Edge cases: a null or empty text has fingerprint zero, linked like any other; a text with fewer words than a shingle
hashes as a whole; repeated rows share a component; a null id is never a component id unless all of them are null.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import checkpointed, drop_shuffles, fresh_name, map_batches, on_workers
from glyphmill.llm.components import components
from glyphmill.llm.decontam import WordHashes

GROUP_ROWS = 2048
LEAF, FAN = 32, 8
SEED = 42


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at ASCII white space."""
    return (text or "").encode().lower().split()


def shingle_hashes(toks: list[bytes], size: int) -> np.ndarray:
    """XXH64 of each run of ``size`` words joined by spaces; of all words where there are fewer; none for none."""
    if not toks:
        return np.empty(0, np.uint64)
    n, whole = max(1, len(toks) - size + 1), b" ".join(toks)
    ends = np.cumsum([len(t) + 1 for t in toks]) - 1
    starts = (np.concatenate(([-1], ends[:-1])) + 1)[:n].tolist()
    stops = ends[size - 1 :].tolist() if len(toks) >= size else [len(whole)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(whole[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64)


def majority_bits(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes, as an unsigned integer."""
    if not len(hashes):
        return 0
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(hashes)).tobytes(), "big")


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(df: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fp bigint`` for every row (the 64 bits as a signed long)."""

    def run(ids: list, texts: list) -> dict[str, list]:
        return {"id": ids, "fp": [signed(majority_bits(shingle_hashes(words(t), shingle))) for t in texts]}

    return map_batches(df, run, [id_col, text_col], f"id {dict(df.dtypes)[id_col]}, fp bigint")


# --- the index of one group -------------------------------------------------------------------------------------------


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Place of each code word in Gray order."""
    rank = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """A tree over fingerprints in Gray order; level 0 are leaves of LEAF values, above each FAN nodes one."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = values[np.argsort(gray_rank(values), kind="stable")]
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        starts = np.arange(0, len(values), LEAF)
        ones = np.bitwise_and.reduceat(self.values, starts)
        zeros = np.bitwise_and.reduceat(~self.values, starts)
        levels = [(ones | zeros, ones)]
        while len(levels[-1][0]) > FAN:
            at = np.arange(0, len(levels[-1][0]), FAN)
            ones = np.bitwise_and.reduceat(levels[-1][1], at)
            zeros = np.bitwise_and.reduceat(levels[-1][0] & ~levels[-1][1], at)
            levels.append((ones | zeros, ones))
        self.levels = []  # (mask of bits that the parent leaves open, their values)
        for k, (mask, ones) in enumerate(levels):
            up = levels[k + 1][0].repeat(FAN)[: len(mask)] if k + 1 < len(levels) else np.zeros(len(mask), np.uint64)
            self.levels.append((mask & ~up & full, ones))

    def forest(self, max_bits: int, queries: int = 512) -> list[tuple[int, int]]:
        """Pairs of linked values that connect every component of the group, a spanning forest."""
        vals, n = self.values, len(self.values)
        root = np.arange(n)
        edges: list[tuple[int, int]] = []
        starts = np.arange(0, n, LEAF)
        for at in range(0, n, queries):
            q = np.arange(at, min(at + queries, n))
            lo, hi = [np.minimum.reduceat(root, starts)], [np.maximum.reduceat(root, starts)]
            for mask, _ in self.levels[1:]:
                step = np.arange(0, len(lo[-1]), FAN)
                lo.append(np.minimum.reduceat(lo[-1], step))
                hi.append(np.maximum.reduceat(hi[-1], step))
            top = len(self.levels[-1][0])
            who, node = q.repeat(top), np.tile(np.arange(top), len(q))
            gone = np.zeros(len(who), np.int64)
            for k in range(len(self.levels) - 1, -1, -1):
                mask, ones = self.levels[k]
                gone = gone + np.bitwise_count((vals[who] ^ ones[node]) & mask[node])
                live = (gone <= max_bits) & ~((lo[k][node] == root[who]) & (hi[k][node] == root[who]))
                who, node, gone = who[live], node[live], gone[live]
                if k:
                    width = len(self.levels[k - 1][0])
                    who, gone = who.repeat(FAN), gone.repeat(FAN)
                    node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                    inside = node < width
                    who, node, gone = who[inside], node[inside], gone[inside]
            for part in range(0, len(who), 8192):
                left = who[part : part + 8192].repeat(LEAF)
                right = (node[part : part + 8192, None] * LEAF + np.arange(LEAF)).ravel()
                inside = right < n
                left, right = left[inside], right[inside]
                near = (root[left] != root[right]) & (np.bitwise_count(vals[left] ^ vals[right]) <= max_bits)
                self._join(root, left[near], right[near], edges)
        return edges

    def _join(self, root: np.ndarray, left: np.ndarray, right: np.ndarray, edges: list) -> None:
        """Merge the components of each pair, keeping one pair for each merge."""
        while len(left):
            a, b = root[left], root[right]
            split = a != b
            left, right, a, b = left[split], right[split], a[split], b[split]
            if not len(left):
                return
            high, low = np.maximum(a, b), np.minimum(a, b)
            _, first = np.unique(high, return_index=True)  # each root moves under one other root
            root[high[first]] = low[first]
            edges.extend(zip(self.values[left[first]].tolist(), self.values[right[first]].tolist(), strict=True))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root[:] = up


# --- routing ----------------------------------------------------------------------------------------------------------


def _segments(bits: int, parts: int) -> list[tuple[int, int]]:
    """(offset from the top, width) of near-equal segments."""
    cuts = [round(i * bits / parts) for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _slice(value: Column, offset: int, width: int) -> Column:
    return F.shiftrightunsigned(F.shiftleft(value, offset), 64 - width)


def forest(points: DataFrame, max_bits: int = 4) -> DataFrame:
    """``t, a, b``: linked fingerprints of each table, enough to connect all that are linked.

    ``points`` has ``t int`` (which table of fingerprints) and ``fp bigint``, without repeats.
    """
    parts = _segments(64, max_bits + 1)
    routed = points.select(
        "t",
        "fp",
        F.explode(F.array(*[F.struct(F.lit(i).alias("s"), _slice(F.col("fp"), o, w).alias("v")) for i, (o, w) in enumerate(parts)])).alias("r"),
    ).select("t", "fp", "r.s", F.xxhash64("t", "r.s", "r.v").alias("key"))
    # At most tables x segments x 2 ** width keys, whatever the data.
    hot = [r["key"] for r in routed.groupBy("key").count().where(F.col("count") > GROUP_ROWS).select("key").collect()]
    cold = routed
    if hot:
        is_hot = F.broadcast(points.sparkSession.createDataFrame([(k,) for k in hot], "key bigint"))
        cold = routed.join(is_hot, "key", "left_anti").select("t", "fp", "s", "key")
        cold = cold.unionByName(_again(routed.join(is_hot, "key", "left_semi"), parts, max_bits))
    grouped = cold.select("key", "t", "fp").repartition("key").sortWithinPartitions("key", "t", "fp")
    return grouped.mapInArrow(_grouped(max_bits), "t int, a bigint, b bigint")


def _again(rows: DataFrame, parts: list[tuple[int, int]], max_bits: int) -> DataFrame:
    """Large groups, dealt by segments of the bits that they do not share; what is still large, by pairs of blocks."""
    turned = F.lit(None).cast("bigint")
    for i, (o, w) in enumerate(parts):
        left = o + w
        turn = F.col("fp") if left == 64 else F.shiftleft("fp", left).bitwiseOR(F.shiftrightunsigned("fp", 64 - left))
        turned = F.when(F.col("s") == i, turn).otherwise(turned)
    rest = _segments(64 - max(w for _, w in parts), max_bits + 1)
    # The shortest rest decides the cuts; a segment of 12 bits leaves one bit more, which takes part in no cut but in
    # the comparison. With it the pigeonhole still holds: the cut bits alone differ in at most max_bits places.
    deep = (
        rows.withColumn("turned", turned)
        .select(
            "t", "fp", "s", "key",
            F.explode(F.array(*[F.struct(F.lit(i).alias("j"), _slice(F.col("turned"), o, w).alias("v")) for i, (o, w) in enumerate(rest)])).alias("r"),
        )
        .select("t", "fp", "s", F.xxhash64("key", "r.j", "r.v").alias("key"))
    )
    sizes = deep.groupBy("key").count().select("key", F.ceil(F.col("count") / (GROUP_ROWS // 2)).cast("int").alias("blocks"))
    sized = deep.join(sizes, "key").withColumn(
        "mine", F.when(F.col("blocks") <= 2, F.lit(0)).otherwise(F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    )
    return sized.select(
        "t", "fp", "s", "key", "mine",
        F.explode(F.when(F.col("blocks") <= 2, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("other"),
    ).select("t", "fp", "s", F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"))


def _grouped(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if held is not None:
                now = tuple(np.concatenate(x) for x in zip(held, now, strict=True))
            last = np.searchsorted(now[0], now[0][-1])
            held = tuple(x[last:] for x in now)
            if last:
                yield _search(*(x[:last] for x in now), max_bits)
        if held is not None and len(held[0]):
            yield _search(*held, max_bits)

    return run


def _search(keys: np.ndarray, tables: np.ndarray, fps: np.ndarray, max_bits: int) -> pa.RecordBatch:
    """All whole groups of a batch: leaf-sized ones compared directly and together, larger ones by their own index."""
    t, fps = tables.astype(np.int32), fps.astype(np.int64).view(np.uint64)
    cuts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.concatenate((cuts, [len(keys)])))
    small = np.repeat(sizes <= LEAF, sizes)
    out_t, out_a, out_b = [], [], []
    k, tt, ff = keys[small], t[small], fps[small]
    for d in range(1, LEAF):
        same = k[d:] == k[:-d]
        if not same.any():
            break
        near = same & (tt[d:] == tt[:-d]) & (np.bitwise_count(ff[d:] ^ ff[:-d]) <= max_bits)
        out_t.append(tt[d:][near])
        out_a.append(ff[d:][near])
        out_b.append(ff[:-d][near])
    for at, n in zip(cuts[sizes > LEAF].tolist(), sizes[sizes > LEAF].tolist(), strict=True):
        for table in np.unique(t[at : at + n]).tolist():
            own = np.unique(fps[at : at + n][t[at : at + n] == table])
            if pairs := GrayIndex(own).forest(max_bits):
                a, b = zip(*pairs, strict=True)
                out_t.append(np.full(len(a), table, np.int32))
                out_a.append(np.array(a, np.uint64))
                out_b.append(np.array(b, np.uint64))
    join = lambda xs, kind: np.concatenate(xs) if xs else np.empty(0, kind)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(join(out_t, np.int32), pa.int32()),
            pa.array(join(out_a, np.uint64).view(np.int64), pa.int64()),
            pa.array(join(out_b, np.uint64).view(np.int64), pa.int64()),
        ],
        names=["t", "a", "b"],
    )


# --- the operator -----------------------------------------------------------------------------------------------------


def near_duplicates(df: DataFrame, shingle: int = 4, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fingerprint, component_id`` for every row: the smallest id that links reach, the row's own included."""
    rows = checkpointed(fingerprints(df, shingle, id_col, text_col))
    by_fp = checkpointed(rows.groupBy("fp").agg(F.min("id").alias("least")))
    edges = forest(by_fp.select(F.lit(0).alias("t"), "fp"), max_bits)
    comp = components(edges.select("a", "b"))
    rooted = by_fp.join(comp, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("fp", "root").join(named, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


# --- filtering by similarity ------------------------------------------------------------------------------------------

#: Shingles taken as common, from a sample of the rows: they come last in the order of prefixes. This bounds a
#: broadcast and changes only how many candidates there are, not what is found.
COMMON, SAMPLE, COMMON_LEAST = 50_000, 16, 3
#: Rows of a shingle that meet each other directly; where there are more, they meet by what sets them off from a center.
DIRECT = 64
#: Columns of posts that tell whether two of them leave room for enough others.
LENGTHS = ("n", "at", "away")
#: Words of 64 bits in a long fingerprint. Its first word goes through the Gray-order index.
LONG, FEW = 4, 32
#: Tables of nodes, roots or keys of up to so many rows (two or three longs each) are sent to all executors; larger ones are joined by shuffling.
BROADCAST_ROWS = 1_000_000


def most_bits(similarity: float) -> int:
    """Differing bits of long fingerprints beyond which a pair is not tested. Two sets of this Jaccard similarity differ
    in a bit with a probability of acos(2s / (1 + s)) / pi at most; eight standard deviations of 64 x LONG bits above
    that lie beyond any pair to be met (under 1e-14 each)."""
    n, p = 64 * LONG, math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(n * p + 8 * math.sqrt(n * p * (1 - p)))


def prefix_length(n: int, similarity: float) -> int:
    """Two sets of at least this Jaccard similarity share one of so many first elements, in any one order of all."""
    return n - math.ceil(similarity * n - 1e-9) + 1


def long_fingerprint(hashes: np.ndarray) -> list[int]:
    """LONG words of SimHash of a set of shingle hashes, as signed integers."""
    out = []
    for _ in range(LONG):
        out.append(signed(majority_bits(hashes)))
        hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        hashes ^= hashes >> np.uint64(29)
    return out


def _common(texts: DataFrame, shingle: int) -> np.ndarray:
    """Hashes of the shingles that most sampled rows share, by rising count."""
    hashes = WordHashes(shingle)

    def run(texts: list) -> dict[str, list]:
        return {"h": np.concatenate([np.empty(0, np.uint64), *(np.unique(hashes(words(t))) for t in texts)]).view(np.int64).tolist()}

    sampled = map_batches(texts.where(F.pmod("node", F.lit(SAMPLE)) == 0), run, ["text"], "h bigint")
    often = sampled.groupBy("h").count().where(F.col("count") >= COMMON_LEAST)
    top = often.orderBy(F.col("count").desc(), "h").limit(COMMON).collect()
    return np.array([r["h"] for r in reversed(top)], np.int64).view(np.uint64)


def _by_rank(hashes: np.ndarray, known: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of some hashes that are not common, as they come, and the common ones by rising count."""
    if not len(known):
        return hashes, hashes[:0]
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    hit = known[at] == hashes
    return hashes[~hit], hashes[hit][np.argsort(rank[at[hit]], kind="stable")]


def prints(texts: DataFrame, similarity: float, shingle: int, common: np.ndarray) -> DataFrame:
    """Of ``node, text``: ``node, n, fp array<bigint>, keys array<bigint>``: how many distinct shingles, the long
    fingerprint, and the prefix of the shingles' hashes, common ones last. Wordless texts have no row."""
    order = np.argsort(common, kind="stable")
    load = on_workers(texts.sparkSession, (common[order], order), lambda x: (WordHashes(shingle), *x))

    def run(nodes: list, texts: list) -> dict[str, list]:
        hashes, known, rank = load()
        out: dict[str, list] = {"node": [], "n": [], "fp": [], "keys": []}
        for node, t in zip(nodes, texts, strict=True):
            own = np.unique(hashes(words(t)))
            if not len(own):
                continue
            first = np.concatenate(_by_rank(own, known, rank))
            out["node"].append(node)
            out["n"].append(len(own))
            out["fp"].append(long_fingerprint(own))
            out["keys"].append(first[: prefix_length(len(own), similarity)])
        return out | {"keys": _lists(out["keys"])}

    return map_batches(texts, run, ["node", "text"], "node bigint, n int, fp array<bigint>, keys array<bigint>")


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """``node, parts array<bigint>``: the hashes of a row's distinct shingles."""
    hashes = WordHashes(shingle)

    def run(nodes: list, texts: list) -> dict[str, list]:
        return {"node": nodes, "parts": _lists([np.unique(hashes(words(t))) for t in texts])}

    return map_batches(texts, run, ["node", "text"], "node bigint, parts array<bigint>")


def residuals(pairs: DataFrame, similarity: float, common: np.ndarray) -> DataFrame:
    """Of ``node, center, parts, parts_center``: ``node, center, n, away, near, keys array<bigint>``: the set's size, the
    size of its symmetric difference with the center's set, whether both are near duplicates, and the difference's first
    hashes.

    Of two sets x and y, what sets x and y apart is what sets their differences with the center apart: |x ^ y| =
    |dx| + |dy| - 2 |dx & dy|. So near duplicates share so many hashes of both differences, and the first of them lies
    among the first (1 - s) / s * n + 1 in any one order of a center's hashes. If they need not share any, both are near
    duplicates of the center. The order puts first what few differences hold: hashes that are not common and not the
    center's, then common ones of the center, from the most common on; last come common ones that the center lacks, then
    what only it has.
    """
    order = np.argsort(common, kind="stable")
    load = on_workers(pairs.sparkSession, (common[order], order), lambda x: x)

    def run(nodes: list, centers: list, sets: list, middles: list) -> dict[str, list]:
        known, rank = load()
        out: dict[str, list] = {"node": nodes, "center": centers, "n": [], "away": [], "near": [], "keys": []}
        for x, c in zip(sets, middles, strict=True):
            own, mid = np.array(x, np.int64).view(np.uint64), np.array(c, np.int64).view(np.uint64)
            more, often_more = _by_rank(np.setdiff1d(own, mid, assume_unique=True), known, rank)
            less, often_less = _by_rank(np.setdiff1d(mid, own, assume_unique=True), known, rank)
            first = np.concatenate((more, often_less[::-1], often_more, less))
            both = len(own) - len(more) - len(often_more)
            out["n"].append(len(own))
            out["away"].append(len(first))
            out["near"].append(both >= similarity * (len(own) + len(mid) - both) - 1e-9)
            out["keys"].append(first[: math.floor(len(own) * (1 - similarity) / similarity + 1e-9) + 1])
        return out | {"keys": _lists(out["keys"])}

    schema = "node bigint, center bigint, n int, away int, near boolean, keys array<bigint>"
    return map_batches(pairs, run, ["node", "center", "parts", "parts_center"], schema)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    flat = np.concatenate([np.empty(0, np.uint64), *arrays]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _small(nodes: DataFrame) -> DataFrame:
    """The (checkpointed) rows, marked for sending to all executors where their count allows it."""
    return F.broadcast(nodes) if nodes.count() <= BROADCAST_ROWS else nodes


class _Verifier:
    """Which pairs of nodes have at least the similarity: first by their long fingerprints, then by their sets."""

    def __init__(self, texts: DataFrame, rows: DataFrame, similarity: float, shingle: int) -> None:
        self.texts, self.similarity, self.shingle = texts, similarity, shingle
        self.rows = rows.select("node", "n", "fp")

    def passed(self, pairs: DataFrame) -> DataFrame:
        """``a, b`` of the pairs that pass. Only nodes of pairs that the fingerprints let through have their sets built
        and moved."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
        for side in ("a", "b"):
            own = self.rows.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("fp").alias(f"fp_{side}"))
            pairs = pairs.join(own, side)
        apart = sum((F.bit_count(F.col("fp_a")[i].bitwiseXOR(F.col("fp_b")[i])) for i in range(LONG)), F.lit(0))
        fits = F.least("n_a", "n_b") >= self.similarity * F.greatest("n_a", "n_b") - F.lit(1e-9)
        like = (apart <= most_bits(self.similarity)) | (F.least("n_a", "n_b") < FEW)  # few shingles make coarse bits
        pairs = checkpointed(pairs.where(fits & like).select("a", "b"))
        sets = self.sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")))
        for side in ("a", "b"):
            pairs = pairs.join(sets.select(F.col("node").alias(side), F.col("parts").alias(f"parts_{side}")), side)
        both = F.size(F.array_intersect("parts_a", "parts_b"))
        near = both >= self.similarity * (F.size("parts_a") + F.size("parts_b") - both) - F.lit(1e-9)
        return checkpointed(pairs.where(near).select("a", "b"))

    def sets(self, nodes: DataFrame) -> DataFrame:
        """``node, parts`` of some nodes."""
        nodes = checkpointed(nodes.distinct())
        own = self.texts.join(_small(nodes), "node", "left_semi").dropDuplicates(["node"])
        return checkpointed(shingle_sets(own, self.shingle))


def _by_fingerprint(rows: DataFrame, max_bits: int) -> DataFrame:
    """``a, b``: candidates of the Gray-order index over the first words of the fingerprints: of rows with one
    fingerprint each with the least node, and of linked fingerprints their least nodes."""
    rows = rows.select("node", F.col("fp")[0].alias("fp"))
    by_fp = checkpointed(rows.groupBy("fp").agg(F.min("node").alias("least")))
    same = rows.join(by_fp, "fp").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    edges = forest(by_fp.select(F.lit(0).alias("t"), "fp"), max_bits).select(F.col("a").alias("fp"), F.col("b").alias("other"))
    linked = edges.join(by_fp, "fp").select(F.col("least").alias("a"), F.col("other").alias("fp"))
    return same.union(linked.join(by_fp, "fp").select("a", F.col("least").alias("b")))


def similar_roots(texts: DataFrame, similarity: float, shingle: int, max_bits: int = 4) -> DataFrame:
    """``node, root`` of the components that pairs of at least this similarity make, roots themselves left out.

    The index over fingerprints gives the first candidates, which join the great mass of near copies. Its limit in bits
    is too tight for pairs close to the similarity, so an exact search follows: every pair that shares a shingle of both
    prefixes, at places that leave room for enough others, is a candidate too. One is left out only once its ends are
    joined by pairs that have passed the exact test: the rows of a shingle are tested with its least node; then, where
    their components still differ, every row outside the shingle's largest component meets all rows of other components.
    Rows of a shingle that many have are variants of one text, most of which share most of their shingles and are still
    not similar enough; they are posted anew by their ``residuals``, with the root of the largest component as center.
    """
    common = _common(texts, shingle)
    rows = checkpointed(prints(texts, similarity, shingle, common).dropDuplicates(["node"]))
    verifier = _Verifier(texts, rows, similarity, shingle)
    roots = components(verifier.passed(_by_fingerprint(rows, max_bits)))

    def rooted(df: DataFrame, node: str, root: str) -> DataFrame:
        own = roots.select(F.col("node").alias(node), F.col("root").alias(root))
        return df.join(_small(own), node, "left").withColumn(root, F.coalesce(root, node))

    def joined(new: DataFrame) -> DataFrame:
        """Roots after some more pairs; what is joined already takes part as stars, so a few rounds do."""
        return roots if new.isEmpty() else components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(new))

    def shared(posts: DataFrame, key: list[str]) -> DataFrame:
        """Posts whose key others have too, with the number of their rows."""
        keys = checkpointed(posts.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"))
        return checkpointed(posts.join(keys, key))

    def mixed(posts: DataFrame, key: list[str]) -> DataFrame:
        """Posts of keys whose rows are in several components, each with its root and that of the largest."""
        live = rooted(posts.drop("root", "main"), "node", "root")
        each = live.groupBy(*key, "root").agg(F.count(F.lit(1)).alias("many"))
        main = each.groupBy(*key).agg(F.max(F.struct("many", "root")).alias("top"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
        return checkpointed(live.join(_small(checkpointed(main.select(*key, F.col("top.root").alias("main")))), key))

    def with_heads(live: DataFrame, key: list[str], first: str, room: Callable[[str, str], Column]) -> DataFrame:
        """``a, b``: the rows of each key with its head, the least by a column."""
        told = [first, *[c for c in live.columns if c in ("node", "root", *LENGTHS) and c != first]]
        heads = live.groupBy(*key).agg(F.min(F.struct(*told)).alias("y")).select(*key, *[F.col(f"y.{c}").alias(f"{c}_y") for c in told])
        pairs = live.select(*key, *[F.col(c).alias(f"{c}_x") for c in told]).join(heads, key)
        return pairs.where((F.col("root_x") != F.col("root_y")) & room("x", "y")).select(F.col("node_x").alias("a"), F.col("node_y").alias("b"))

    def with_all(live: DataFrame, key: list[str], room: Callable[[str, str], Column]) -> DataFrame:
        """``a, b``: rows outside the main component with the key's rows of other components, each pair of a key once."""

        def side(df: DataFrame, x: str) -> DataFrame:
            return df.select(*key, *[F.col(c).alias(f"{c}_{x}") for c in live.columns if c in ("node", "root", "main", *LENGTHS)])

        once = (F.col("root_y") == F.col("main_x")) | (F.col("node_x") < F.col("node_y"))
        apart = F.col("root_x") != F.col("root_y")
        pairs = side(live.where("root <> main"), "x").join(side(live, "y"), key).where(apart & once & room("x", "y"))
        return pairs.select(F.col("node_x").alias("a"), F.col("node_y").alias("b"))

    def set_room(x: str, y: str) -> Column:
        """Whether two sets that share the elements at these places of their prefixes first can be similar enough."""
        most = F.least(F.col(f"n_{x}") - F.col(f"at_{x}"), F.col(f"n_{y}") - F.col(f"at_{y}"))
        return most * (1 + similarity) >= similarity * (F.col(f"n_{x}") + F.col(f"n_{y}")) - F.lit(1e-9)

    def gap_room(x: str, y: str) -> Column:
        """The same of the places in what sets them off from a center."""
        most = F.least(F.col(f"away_{x}") - F.col(f"at_{x}"), F.col(f"away_{y}") - F.col(f"at_{y}"))
        apart = (F.col(f"n_{x}") + F.col(f"n_{y}")) * ((1 - similarity) / (1 + similarity))
        return most * 2 >= F.col(f"away_{x}") + F.col(f"away_{y}") - apart - F.lit(1e-6)

    own = ["key"]
    live = mixed(shared(rows.select("node", "n", F.posexplode("keys").alias("at", "key")), own), own)
    roots = joined(verifier.passed(with_heads(live, own, "node", set_room)))
    live = mixed(live.where("rows > 2"), own)  # of two rows one is the head
    if live.isEmpty():
        return roots

    around = checkpointed(live.where((F.col("rows") > DIRECT) & (F.col("node") != F.col("main"))).select("node", F.col("main").alias("center")).distinct())
    middles = verifier.sets(around.select(F.col("center").alias("node"))).select(F.col("node").alias("center"), F.col("parts").alias("parts_center"))
    if (middles.agg(F.sum(F.size("parts_center"))).first()[0] or 0) <= BROADCAST_ROWS:
        middles = F.broadcast(middles)
    centers = _small(checkpointed(around.groupBy("node").agg(F.collect_list("center").alias("centers"))))
    sets = shingle_sets(texts.join(centers, "node", "left_semi"), shingle)
    whole = sets.join(centers, "node").select("node", "parts", F.explode("centers").alias("center")).join(middles, "center")
    gaps = checkpointed(residuals(whole, similarity, common).dropDuplicates(["node", "center"]))  # of repeated rows
    roots = joined(gaps.where("near").select(F.col("node").alias("a"), F.col("center").alias("b")))

    off = ["center", "key"]
    gaps = mixed(shared(gaps.select("center", "node", "n", "away", F.posexplode("keys").alias("at", "key")), off), off)
    roots = joined(verifier.passed(with_heads(gaps, off, "away", gap_room)))
    gaps, live = mixed(gaps.where("rows > 2"), off), mixed(live.where(F.col("rows") <= DIRECT), own)
    return joined(verifier.passed(with_all(live, own, set_room).union(with_all(gaps, off, gap_room))))


def keep_one(
    df: DataFrame, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row, with all its columns, of each group of near duplicates.

    Rows are near duplicates when their shingle sets have at least this Jaccard similarity. Candidates come from the
    Gray-order index over their fingerprints, then from prefixes of the sets; the exact similarity of the sets decides.
    Rows that repeat id and text stay or go together; null, empty and wordless texts have no shingles and always stay;
    a text with fewer words than a shingle is one shingle; an empty table gives an empty result; extra columns may have
    any name.
    """
    drop_shuffles(df.sparkSession)  # each of the many steps ends in a checkpoint
    node = fresh_name("node")
    marked = df.withColumn(node, F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))))
    texts = marked.select(F.col(node).alias("node"), F.col(text_col).alias("text"))
    gone = checkpointed(similar_roots(texts, similarity, shingle).select(F.col("node").alias(node)))
    return marked.join(_small(gone), node, "left_anti").drop(node)
