"""Removal of long repeated byte strings (operator 10).

A byte goes when a string of ``LENGTH`` bytes that covers it starts somewhere else too, in the same document or
another. Beside it stands how many words lie in passages of ``WORDS`` words that another document holds too, which
differs where words are short or white space is not the same. Both are found in the same passes: a text is a sequence
of bytes, and a sequence of word hashes.

A full suffix array of a corpus fits no machine, so minimisers stand in for it. Anchors are the positions where the
hash of a ``GRAM``-byte string (``WORD_GRAM`` words) is least among all such strings inside some string of full length;
equal strings have equal anchors, and every string of full length holds at least one. Where a gram occurs once, no
longer string over it repeats. Where all its occurrences have the same surroundings, all strings over it repeat.
Otherwise the distinct surroundings of the gram are ordered by hash once for each distance from the anchor to the
string's start, and the runs of equal entries tell which strings have a match: the places where a
longest-previous-factor array, taken in both directions, reaches the full length.

How it scales: the first pass shuffles one row for each anchor (about 1 in 70 bytes and 1 in 16 words), reduced in
each task first; the second joins the anchors to the repeated grams; texts are shuffled once, and only surroundings of
repeated grams travel with them. A gram with many different surroundings (a passage in a third of all documents) is
dealt as pairs of blocks, so tasks stay bounded; copies of one surrounding are summed in the tasks that meet them, and
the join that brings matches back to the anchors splits a passage that many hold.

Strings count as equal when the 64-bit hashes of their grams, and the hashes of the rest, are. Edge cases: null and
empty texts have no bytes, texts under ``LENGTH`` bytes lose none; repeated rows are copies of each other, but not
another document; empty tables give an empty result; only the id and the text are read, other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import BATCH_ROWS, Powers, checkpointed, map_batches, mix, on_workers, parts

LENGTH, GRAM = 400, 256
WORDS, WORD_GRAM = 51, 20
#: Repeated grams of up to so many are sent to the workers as a bit table of a fixed size, so that the second pass
#: leaves out anchors that occur once before they are shuffled; more of them only meet in the join.
TABLE_ROWS, TABLE_BITS = 4_000_000, 1 << 26
#: Texts with repeated grams, if no more than so many, are told to all executors (12 bytes each), so that the others are
#: not shuffled; more of them only meet in the join.
KEY_ROWS = 2_000_000
BLOCK_ROWS, BLOCKS, MOST_ROWS = 1024, 8, 20_000
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


_POWERS = tuple(Powers(b) for b in BASES)


def _sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    f, span = (np.minimum if least else np.maximum), 1
    while span * 2 <= width:
        x = f(x[:-span], x[span:])
        span *= 2
    return f(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def byte_codes(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_codes(codes: np.ndarray) -> np.ndarray:
    """Hashes of the words, maximal runs without ASCII white space, of a text given as its byte codes."""
    space = np.concatenate(([True], _SPACE[codes.astype(np.int64) - 1], [True]))
    edge = np.flatnonzero(space[1:] != space[:-1])
    start, end = edge[::2], edge[1::2]
    up, down = _POWERS[0].of(len(codes) + 1)
    pre = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * up[: len(codes)])))
    return mix((pre[end] - pre[start]) * down[start])


def anchors(codes: np.ndarray, length: int, gram_size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of a sequence's anchors, hashes of their grams and of their surroundings."""
    n, side = len(codes), length - gram_size
    if n < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    up, down = _POWERS[0].of(n + 1)
    pre = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * up[:n])))
    gram = mix((pre[gram_size:] - pre[:-gram_size]) * down[: n - gram_size + 1])
    least = _sliding(gram, side + 1, True)
    edge = np.zeros(side, np.uint64)
    pos = np.flatnonzero(_sliding(np.concatenate((edge, least, edge)), side + 1, False) == gram)
    up, down = _POWERS[1].of(n + 1)
    pre = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * up[:n])))
    start, end = np.maximum(pos - side, 0), np.minimum(pos + length, n)
    around = mix((pre[end] - pre[start]) * down[start])
    shape = ((pos - start) * 1024 + (end - pos)).astype(np.uint64)
    return pos, gram[pos], mix(around ^ (shape * np.uint64(BASES[0])))


def all_anchors(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Anchors of the bytes, then of the words, and how many are of bytes; the lowest bit of a gram's hash says which."""
    codes, one = byte_codes((text or "").encode()), np.uint64(1)
    raw = anchors(codes, LENGTH, GRAM)
    named = anchors(word_codes(codes), WORDS, WORD_GRAM)
    h = np.concatenate((raw[1] & ~one, named[1] | one))
    return np.concatenate((raw[0], named[0])), h, np.concatenate((raw[2], named[2])), len(raw[0])


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _grams(texts: DataFrame) -> DataFrame:
    """``h, c, u`` of every anchor; ``u`` names the document of an anchor of words, and is null for one of bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                found = [all_anchors(t) for t in part.column(1).to_pylist()]
                h, c = (_signed(np.concatenate([x[i] for x in found])) for i in (1, 2))
                u = np.repeat(part.column(0).to_numpy(), [len(x[0]) for x in found])
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c), pa.array(u, mask=h & 1 == 0)], ["h", "c", "u"])

    return texts.select("u1", "text").mapInArrow(run, "h bigint, c bigint, u bigint")


def _bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two places in the bit table for each hash."""
    return tuple((mix(h.view(np.uint64) ^ np.uint64(b)) % np.uint64(TABLE_BITS)).astype(np.int64) for b in BASES)


def _table(repeated: DataFrame) -> np.ndarray | None:
    """Bits of the repeated grams, if they are few enough."""
    if repeated.count() > TABLE_ROWS:
        return None

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.column(0).to_numpy().tobytes()], pa.binary())], ["v"])

    table = np.zeros(TABLE_BITS, bool)
    for r in repeated.select("h").mapInArrow(packed, "v binary").toLocalIterator():  # 8 bytes a gram
        for at in _bits(np.frombuffer(r["v"], np.int64)):
            table[at] = True
    return np.packbits(table)


def _few(rows: DataFrame) -> DataFrame | None:
    """The texts of some anchors, marked for a broadcast, if they are few enough for one."""
    keys = checkpointed(rows.select("u1", "u2").distinct())
    return F.broadcast(keys) if keys.count() <= KEY_ROWS else None


def _placed(texts: DataFrame, table: np.ndarray | None) -> DataFrame:
    """``u1, u2, pos, h, c`` of the anchors of texts ``u1, u2, text`` that the bit table lets through."""
    load = on_workers(texts.sparkSession, table, lambda x: x)

    def let_through(found: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        bits = load()
        if bits is None:
            return found[:3]
        two = [(bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 for at in _bits(found[1])]
        ok = (two[0] & two[1]) > 0
        return tuple(x[ok] for x in found[:3])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                found = [let_through(all_anchors(t)) for t in part.column(2).to_pylist()]
                many = [len(x[0]) for x in found]
                u1, u2 = (np.repeat(part.column(i).to_numpy(), many) for i in (0, 1))
                pos = np.concatenate([x[0] for x in found]).astype(np.int32)
                h, c = (_signed(np.concatenate([x[i] for x in found])) for i in (1, 2))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (u1, u2, pos, h, c)], ["u1", "u2", "pos", "h", "c"])

    return texts.select("u1", "u2", "text").mapInArrow(run, "u1 bigint, u2 int, pos int, h bigint, c bigint")


_CONTEXT = "h bigint, c bigint, seen bigint, low bigint, high bigint, blocks int, l binary, r binary"


def _surroundings(rows: DataFrame) -> DataFrame:
    """What stands left and right of the wanted anchors of each text, bytes or 32 bits of each word's hash; repeats
    inside a task are summed, with the least and the greatest name of their documents."""
    names = [x.split()[0] for x in _CONTEXT.split(", ")]

    def batch_of(held: dict) -> pa.RecordBatch:
        cols = [[k[i] for k in held] for i in (0, 1)]
        cols += [list(x) for x in zip(*held.values(), strict=True)] if held else [[] for _ in names[2:]]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            for part in parts(batch):
                for u, text, want in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    data = (text or "").encode()
                    named = None
                    for w in want:
                        p, key = w["pos"], (w["h"], w["c"])
                        old = held.get(key)
                        if old:
                            old[:3] = old[0] + 1, min(old[1], u), max(old[2], u)
                        elif w["h"] & 1:
                            if named is None:
                                named = word_codes(byte_codes(data)).astype("<u4").tobytes()
                            left, right = named[4 * max(0, p - WORDS + WORD_GRAM) : 4 * p], named[4 * (p + WORD_GRAM) : 4 * (p + WORDS)]
                            held[key] = [1, u, u, w["blocks"], left, right]
                        else:
                            held[key] = [1, u, u, w["blocks"], data[max(0, p - LENGTH + GRAM) : p], data[p + GRAM : p + LENGTH]]
                if len(held) > 50_000:
                    yield batch_of(held)
                    held = {}
        yield batch_of(held)

    return rows.select("u1", "text", "want").mapInArrow(run, _CONTEXT)


def _matrix(values: list[bytes], side: int, kind: str, turn: bool) -> np.ndarray:
    """Rows of ``side`` codes, shifted by 1 so that 0 is none; left sides turned so that both run away from the gram."""
    out = np.zeros((len(values), side), np.uint64)
    lengths = np.empty(len(values), np.int64)
    for i, v in enumerate(values):
        row = np.frombuffer(v, kind)
        lengths[i] = len(row)
        out[i, : len(row)] = row[::-1] if turn else row
    out += np.uint64(1)
    out[np.arange(side) >= lengths[:, None]] = 0
    return out


def _match(rows: list[tuple], named: bool) -> tuple[np.ndarray, ...]:
    """For whole groups of bytes or of words, rows ``key, h, c, seen, low, high, l, r``: ``h, c`` of each surrounding,
    and how far to the left and right matches reach (-1: none)."""
    side, kind = (WORDS - WORD_GRAM, "<u4") if named else (LENGTH - GRAM, "u1")
    keys, hs, cs, seen, low, high = (np.array([r[i] for r in rows], np.int64) for i in range(6))
    order = np.lexsort((cs, keys))
    first = np.flatnonzero(np.concatenate(([True], (keys[order][1:] != keys[order][:-1]) | (cs[order][1:] != cs[order][:-1]))))
    at = order[first]
    n = len(at)
    if named:  # another document holds it
        low, high = np.minimum.reduceat(low[order], first), np.maximum.reduceat(high[order], first)
    else:  # it stands somewhere else, in another surrounding or in the same one
        low = 2 * np.arange(n)
        high = low + (np.add.reduceat(seen[order], first) > 1)
    lm, rm = (_matrix([rows[i][k] for i in at.tolist()], side, kind, k == 6) for k in (6, 7))
    ll, rl = ((m > 0).sum(axis=1) for m in (lm, rm))
    hashes = np.empty((side + 1, n), np.uint64)  # of the first r codes on the right
    hashes[0] = 1
    for r in range(side):
        hashes[r + 1] = (hashes[r] ^ rm[:, r]) * np.uint64(BASES[0])
        hashes[r + 1] ^= hashes[r + 1] >> np.uint64(31)
    most, least = np.full(n, -1), np.full(n, side + 1)
    lh = mix(keys[at].view(np.uint64))
    for a in range(side + 1):  # strings that start so far before the gram
        if a:
            lh = (lh ^ lm[:, a - 1]) * np.uint64(BASES[1])
            lh = lh ^ (lh >> np.uint64(31))
        able = np.flatnonzero((ll >= a) & (rl >= side - a))
        if len(able):
            key = mix(lh[able] + hashes[side - a][able] * np.uint64(BASES[0]))
            able = able[np.argsort(key, kind="stable")]
            key.sort()
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            two = np.minimum.reduceat(low[able], starts) != np.maximum.reduceat(high[able], starts)
            hit = able[np.repeat(two, np.diff(np.append(starts, len(able))))]
            most[hit] = a
            least[hit] = np.minimum(least[hit], a)
    return hs[at], cs[at], most, np.where(most >= 0, side - least, -1)


_KEYED = ("key", "h", "c", "seen", "low", "high", "l", "r")


def _reaches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups come sorted by key; whole groups are matched together."""
    held: list[tuple] = []

    def out(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        for named in (False, True):
            if own := [r for r in rows if (r[1] & 1) == named]:
                h, c, left, right = _match(own, named)
                ok = left >= 0
                cols = (h[ok], c[ok], left[ok].astype(np.int32), right[ok].astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["h", "c", "reach_l", "reach_r"])

    for batch in batches:
        held += zip(*(batch.column(i).to_pylist() for i in range(len(_KEYED))), strict=True)
        if len(held) >= 8192:
            last = held[-1][0]
            cut = next((i for i in range(len(held) - 1, -1, -1) if held[i][0] != last), -1) + 1
            if cut:
                yield from out(held[:cut])
                held = held[cut:]
    if held:
        yield from out(held)


def _covered(n: int, spans: list[dict], length: int, gram: int) -> np.ndarray:
    """Which of n places lie in a string that has a match."""
    change = np.zeros(n + 1, np.int32)
    for s in spans:
        p, left, right = s["pos"], s["reach_l"], s["reach_r"]
        a, b = (p - left, p + gram + right) if left >= 0 else (max(0, p - length + gram), min(n, p + length))
        if b - a >= length:
            change[a] += 1
            change[b] -= 1
    return np.cumsum(change[:n]) > 0


def _cut(data: bytes, spans: list[dict] | None) -> tuple[int, int, str, int]:
    """Bytes removed, runs of them, the digest of the rest, and words in passages that another document holds too."""
    spans = spans or []
    raw, named = ([s for s in spans if s["named"] == k] for k in (False, True))
    words = int(_covered(len(word_codes(byte_codes(data))), named, WORDS, WORD_GRAM).sum()) if named else 0
    if not raw:
        return 0, 0, hashlib.sha256(data).hexdigest(), words
    gone = _covered(len(data), raw, LENGTH, GRAM)
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return int(gone.sum()), runs, hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest(), words


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, kept_sha256, n_shared_words`` for every row."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = df.select(
        F.col(id_col).alias("id"),
        F.xxhash64(F.col(id_col), text).alias("u1"),
        F.hash(F.lit(1), F.col(id_col), text).alias("u2"),
        text.alias("text"),
    )
    least, most = F.min("c"), F.max("c")
    repeated = checkpointed(
        _grams(texts)
        .groupBy("h")
        .agg(F.count(F.lit(1)).alias("n"), (least == most).alias("alike"), F.min("u").alias("low"), F.max("u").alias("high"))
        .where("n > 1 and (low is null or low <> high)")
        .select("h", "alike", "n")
    )
    placed = checkpointed(_placed(texts, _table(repeated)).join(repeated, "h"))
    blocks = F.greatest(F.least(F.lit(BLOCKS), F.ceil(F.col("n") / BLOCK_ROWS)), F.ceil(F.col("n") / MOST_ROWS)).cast("int")
    open_ = placed.where("not alike").withColumn("blocks", blocks)
    wanted = open_.groupBy("u1", "u2").agg(F.collect_set(F.struct("pos", "h", "c", "blocks")).alias("want"))
    some = _few(open_)
    asked = texts if some is None else texts.join(some, ["u1", "u2"], "left_semi")
    around = _surroundings(asked.join(wanted, ["u1", "u2"]).select("u1", "text", "want"))
    mine = F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int")
    dealt = around.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn(
        "key",
        F.when(F.col("blocks") == 1, F.col("h")).otherwise(F.xxhash64("h", F.least("mine", "other"), F.greatest("mine", "other"))),
    ).select(*_KEYED)
    reach = checkpointed(  # so that the join below deals both sides anew and can split a passage that many hold
        dealt.repartition("key")
        .sortWithinPartitions("key")
        .mapInArrow(_reaches, "h bigint, c bigint, reach_l int, reach_r int")
        .groupBy("h", "c")
        .agg(F.max("reach_l").alias("reach_l"), F.max("reach_r").alias("reach_r"))
    )
    named = (F.col("h").bitwiseAND(F.lit(1)) == 1).alias("named")
    spans = (
        placed.where("alike")
        .select("u1", "u2", named, "pos", F.lit(-1).alias("reach_l"), F.lit(-1).alias("reach_r"))
        .unionByName(open_.join(reach, ["h", "c"]).select("u1", "u2", named, "pos", "reach_l", "reach_r"))
        .groupBy("u1", "u2")
        .agg(F.collect_set(F.struct("named", "pos", "reach_l", "reach_r")).alias("spans"))
    )

    def run(ids: list, all_texts: list, all_spans: list) -> dict[str, list]:
        data = [t.encode() for t in all_texts]
        cuts = [_cut(d, s) for d, s in zip(data, all_spans, strict=True)]
        return {
            "id": ids,
            "n_bytes": [len(d) for d in data],
            **{name: [c[i] for c in cuts] for i, name in enumerate(("n_removed", "n_spans", "kept_sha256", "n_shared_words"))},
        }

    some = _few(placed)
    if some is None:
        cut = texts.join(spans, ["u1", "u2"], "left").select("id", "text", "spans")
    else:  # the others have no spans and stay where they are
        alone = texts.join(some, ["u1", "u2"], "left_anti").select("id", "text")
        cut = texts.join(some, ["u1", "u2"], "left_semi").join(spans, ["u1", "u2"], "left").select("id", "text", "spans")
        cut = cut.unionByName(alone, allowMissingColumns=True)
    schema = f"id {dict(df.dtypes)[id_col]}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_shared_words bigint"
    return map_batches(cut, run, ["id", "text", "spans"], schema).withColumnRenamed("id", id_col)
