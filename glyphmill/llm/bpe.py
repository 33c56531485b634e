"""Byte-level BPE encoding and decoding (operator 1).

Pre-tokens are merged with a rank queue: a bitmap of two levels says which merge ranks have entries, the lowest set
bit of each level (find-first-set) gives the next rank, and a rank's bucket holds positions in a linked list of tokens.
Entries that a later merge has made wrong stay in their bucket and are skipped when they come up.

A long pre-token has a queue of its own, whose buckets are heaps: n bytes cost O(n log n), so one of a megabyte is no
problem. The short pre-tokens of a batch that are not remembered share one queue over their joined bytes. Merges never
cross pre-tokens, so a step takes the lowest group of ranks that has entries and merges, in every pre-token that has
some there, its lowest rank's leftmost position: the same merges in the same order as one by one, in numpy.

Edge cases: a null or empty text has no ids (digest of the empty string); repeated rows are encoded each; an empty
table gives an empty result; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from heapq import heappop, heappush
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from glyphmill.llm.common import map_batches

#: Distinct pre-tokens a worker remembers before it starts anew.
CACHE_ENTRIES = 400_000
#: Pre-tokens of up to so many bytes are merged together; longer ones are not remembered.
SHORT = 64
#: Ranks under one bit of the shared queue's upper bitmap.
GROUP_BITS = 9
_ODD = np.uint64(0x9E3779B97F4A7C15)


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from the text of a ``.tiktoken`` file."""
    return {base64.b64decode(tok): int(rank) for tok, rank in (line.split() for line in data.splitlines() if line)}


class PairTable:
    """Rank of each pair of tokens that merges, as an open-addressing hash table; ``none`` for the others."""

    def __init__(self, ranks: dict[bytes, int], none: int) -> None:
        keys, values = [], []
        get = ranks.get
        for tok, rank in ranks.items():
            for cut in range(1, len(tok)):
                left, right = get(tok[:cut]), get(tok[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        self.none = none
        self.shift = np.uint64(64 - max(4, (4 * len(keys)).bit_length()))
        self.keys = np.full(1 << (64 - int(self.shift)), -1, np.int64)
        self.values = np.full(len(self.keys), none, np.int32)
        key, value = np.array(keys, np.int64), np.array(values, np.int32)
        slot = self._slot(key)
        while len(key):
            _, first = np.unique(slot, return_index=True)
            first = first[self.keys[slot[first]] < 0]
            self.keys[slot[first]], self.values[slot[first]] = key[first], value[first]
            left = np.ones(len(key), bool)
            left[first] = False
            key, value, slot = key[left], value[left], (slot[left] + 1) & (len(self.keys) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * _ODD) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        slot = self._slot(key)
        held = self.keys[slot]
        out = np.where(held == key, self.values[slot], self.none)
        at = np.flatnonzero((held != key) & (held >= 0))
        while len(at):
            slot[at] = (slot[at] + 1) & (len(self.keys) - 1)
            held = self.keys[slot[at]]
            hit = held == key[at]
            out[at[hit]] = self.values[slot[at[hit]]]
            at = at[~hit & (held >= 0)]
        return out


class RankQueueBpe:
    """Encoder and decoder for one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for tok, rank in ranks.items():
            self.tokens[rank] = tok
        self.split = regex.compile(pattern).findall
        self.words = [0] * ((len(self.tokens) >> 8) + 1)
        self.buckets: dict[int, int | list[int]] = {}  # one position, or a heap of them
        self.known: dict[str, bytes] = {}
        self.none = ((len(self.tokens) >> GROUP_BITS) + 1) << GROUP_BITS
        self.bytes = np.array([ranks.get(bytes([b]), 0) for b in range(256)], np.int32)
        self.pairs = PairTable(ranks, self.none)
        self.blob = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        get = self.ranks.get
        whole = get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        nxt = list(range(1, n + 1))
        prv = list(range(-1, n - 1))
        pair = [-1] * n
        words, buckets, top = self.words, self.buckets, 0
        for i in range(n - 1):
            rank = get(piece[i : i + 2], -1)
            if rank >= 0:
                pair[i] = rank
                held = buckets.get(rank)
                if held is None:
                    buckets[rank] = i
                    w = rank >> 8
                    words[w] |= 1 << (rank & 255)
                    top |= 1 << w
                elif held.__class__ is int:
                    buckets[rank] = [held, i]
                else:
                    held.append(i)
        while top:
            w = (top & -top).bit_length() - 1
            word = words[w]
            low = word & -word
            rank = (w << 8) + low.bit_length() - 1
            i = buckets[rank]
            if i.__class__ is not int:
                held, i = i, heappop(i)
            else:
                held = None
            if not held:
                del buckets[rank]
                word ^= low
                words[w] = word
                if not word:
                    top &= top - 1
            if pair[i] != rank:
                continue  # stale
            j = nxt[i]
            end = nxt[j]
            nxt[i] = end
            pair[j] = -1
            at, stop = i, 0
            if end < n:
                prv[end] = i
                stop = nxt[end]
            else:
                pair[i] = -1
            while True:  # the pair that now starts here, then the one before
                if stop:
                    fresh = get(piece[at:stop], -1)
                    pair[at] = fresh
                    if fresh >= 0:
                        held = buckets.get(fresh)
                        if held is None:
                            buckets[fresh] = at
                            w = fresh >> 8
                            words[w] |= 1 << (fresh & 255)
                            top |= 1 << w
                        elif held.__class__ is int:
                            buckets[fresh] = [held, at] if held < at else [at, held]
                        else:
                            heappush(held, at)
                if at != i:
                    break
                at, stop = prv[i], end
                if at < 0:
                    break
        out, at, ranks = [], 0, self.ranks
        while at < n:
            out.append(ranks[piece[at : nxt[at]]])
            at = nxt[at]
        return out

    def encode_short(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of many pre-tokens as little-endian unsigned 32-bit integers, merged over one queue."""
        sizes = np.array([len(x) for x in pieces], np.int64)
        owner = np.append(np.repeat(np.arange(len(pieces)), sizes), -1)
        tok = np.append(self.bytes[np.frombuffer(b"".join(pieces), np.uint8)], 0)
        n = len(tok) - 1
        nxt, prv = np.arange(1, n + 2), np.arange(-1, n)
        pair = np.full(n + 1, self.none, np.int32)
        pair[: n - 1] = np.where(owner[: n - 1] == owner[1:n], self.pairs(tok[: n - 1], tok[1:n]), self.none)
        live = np.ones(n, bool)
        buckets: dict[int, list[np.ndarray]] = {}
        top = 0

        def push(at: np.ndarray) -> None:
            nonlocal top
            at = at[pair[at] < self.none]
            if not len(at):
                return
            groups = (pair[at] >> GROUP_BITS).astype(np.uint16)
            order = np.argsort(groups, kind="stable")
            at, groups = at[order], groups[order]
            cuts = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1]))).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(at)], strict=True):
                g = int(groups[a])
                buckets.setdefault(g, []).append(at[a:b])
                top |= 1 << g

        push(np.arange(n))
        low_bits = (1 << GROUP_BITS) - 1
        while top:
            g = (top & -top).bit_length() - 1
            at = np.concatenate(buckets.pop(g))
            rank = pair[at]
            fresh = rank >> GROUP_BITS == g  # the others are stale
            at = at[fresh]
            if not len(at):
                top &= top - 1
                continue
            # By pre-token, rank and position; entries that came twice are equal, and the second is stale later.
            order = np.sort((owner[at] << 44) | ((rank[fresh] & low_bits).astype(np.int64) << 32) | at)
            first = np.concatenate(([True], order[1:] >> 44 != order[:-1] >> 44))
            left = order[~first] & 0xFFFFFFFF
            if len(left):
                buckets[g] = [left]
            else:
                top &= top - 1
            i = order[first] & 0xFFFFFFFF
            j = nxt[i]
            end = nxt[j]
            tok[i] = pair[i]
            nxt[i] = end
            pair[j] = self.none
            live[j] = False
            inside = owner[end] == owner[i]
            prv[end[inside]] = i[inside]
            pair[i] = np.where(inside, self.pairs(tok[i], tok[end]), self.none)
            before = prv[i]
            has = owner[before] == owner[i]  # the last entry's owner is no pre-token
            before = before[has]
            pair[before] = self.pairs(tok[before], tok[i[has]])
            push(np.concatenate((i, before)))
        ids = tok[:n][live].astype("<u4").tobytes()
        ends = (np.cumsum(np.bincount(owner[:n][live], minlength=len(pieces))) * 4).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers."""
        split = [self.split(t or "") for t in texts]
        if len(self.known) > CACHE_ENTRIES:
            self.known = {}
        known, ranks = self.known, self.ranks
        fresh: set[str] = set()
        for toks in split:
            fresh.update(toks)
        names, data, lasting = [], [], {}
        for tok in fresh.difference(known):
            raw = tok.encode()
            whole = ranks.get(raw)
            if whole is not None:
                known[tok] = whole.to_bytes(4, "little")
            elif len(raw) <= SHORT:
                names.append(tok)
                data.append(raw)
            else:
                lasting[tok] = known[tok] = array("I", self.encode_piece(raw)).tobytes()
        if data:
            known.update(zip(names, self.encode_short(data), strict=True))
        out = [b"".join(map(known.__getitem__, toks)) for toks in split]
        for tok in lasting:
            del known[tok]
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode_all(self, ids: list[bytes]) -> list[bytes]:
        """The bytes that each text's ids stand for, gathered from the tokens' joined bytes."""
        if not ids:
            return []
        every = np.frombuffer(b"".join(ids), "<u4").astype(np.int64)
        sizes = self.sizes[every]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        out = self.blob[np.repeat(self.starts[every] - (ends - sizes), sizes) + np.arange(total)].tobytes()
        cuts = np.concatenate(([0], ends))[np.cumsum([0, *[len(x) // 4 for x in ids]])].tolist()
        return [out[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def decode(self, ids: bytes) -> bytes:
        return self.decode_all([ids])[0]


_LOADED: dict[tuple, RankQueueBpe] = {}


def _coder(key: tuple, data: bytes, pattern: str) -> RankQueueBpe:
    if key not in _LOADED:
        _LOADED[key] = RankQueueBpe(read_ranks(data), pattern)
    return _LOADED[key]


def _prepared(df: DataFrame, ranks_path: str, pattern: str | None):
    """The vocabulary file (about a megabyte, whatever the data) goes to the workers as a broadcast."""
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    data = Path(ranks_path).read_bytes()
    shared = df.sparkSession.sparkContext.broadcast(data)
    key = (hashlib.sha256(data).hexdigest(), pattern)
    return lambda: _coder(key, shared.value, pattern)


def _lists(ids: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *[len(x) // 4 for x in ids]], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))


def encode(df: DataFrame, ranks_path: str, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, ids array<int>``: the ids of each whole text."""
    coder = _prepared(df, ranks_path, pattern)

    def run(ids: list, texts: list) -> dict[str, list]:
        bpe = coder()
        return {"id": ids, "ids": _lists(bpe.encode_all(texts))}

    kind = dict(df.dtypes)[id_col]
    return map_batches(df, run, [id_col, text_col], f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(df: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id, decoded binary``: the bytes that the ids stand for; null ids count as none."""
    coder = _prepared(df, ranks_path, "(?s).+")

    def run(keys: list, ids: list) -> dict[str, list]:
        bpe = coder()
        return {"id": keys, "decoded": bpe.decode_all([array("I", x or []).tobytes() for x in ids])}

    kind = dict(df.dtypes)[id_col]
    return map_batches(df, run, [id_col, ids_col], f"id {kind}, decoded binary").withColumnRenamed("id", id_col)


def round_trip(
    df: DataFrame,
    ranks_path: str,
    pattern: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Encode and decode in one pass over the text, without a shuffle: ``id, n_tokens, ids_sha256, decoded_sha256,
    n_bytes``: counts and digests of the ids and of the decoded bytes, and ``ids array<int>`` if asked for.
    """
    coder = _prepared(df, ranks_path, pattern)

    def run(keys: list, texts: list) -> dict[str, list]:
        bpe = coder()
        ids = bpe.encode_all(texts)
        back = bpe.decode_all(ids)
        more = {"ids": _lists(ids)} if with_ids else {}
        return more | {
            "id": keys,
            "n_tokens": [len(x) // 4 for x in ids],
            "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in back],
            "n_bytes": [len(x) for x in back],
        }

    kind = dict(df.dtypes)[id_col]
    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_bytes bigint" + ", ids array<int>" * with_ids
    return map_batches(df, run, [id_col, text_col], schema).withColumnRenamed("id", id_col)
