"""Toxicity by a bidirectional GRU with attention pooling (operator 8), trained in numpy.

A text is a sequence of words. A word's input joins word features (smoothed log-odds of the word between toxic and
clean training documents, a learned embedding) and character features (the same for the character 4- and 5-grams of the
marked word). A GRU reads the text in both directions, and attention pools the states of every overlapping window of
``WINDOW`` words, one from every word on, into one logit; a document's score is the calibrated logit of its most toxic
window. Windows share the states of the words they share, so each word is read once in each direction. To read long
texts side by side they are cut into segments of ``SEGMENT`` words, each begun ``WARM`` words earlier, after which the
state no longer shows where reading began. Training is by multiple instances: a toxic document teaches through its
highest window, a clean one through its highest and a few others, each read with ``CONTEXT`` words around it.

The model is fitted on the driver on at most ``MAX_DOCS`` labelled documents of each class, those with the smallest id
hashes (a documented bound; labels are learnt only from rows that the caller's filter admits). Scoring covers every row
and the whole text, in one pass without a shuffle; the model is a broadcast of fixed size.

Edge cases: a null, empty or wordless text scores the share of toxic training documents; without labels of both kinds
every score is that share (0 without any); very long texts are read whole, segment by segment; of several labels of an
id the highest counts, and of several rows with a labelled id the text with the smallest hash is learnt, so the model
doesn't depend on how the tables are split; repeated rows are scored each; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import filter_batches, map_batches, on_workers

MAX_DOCS = 1500
WINDOW, CONTEXT = 16, 16
SEGMENT, WARM, SIDE_BY_SIDE = 64, 32, 2048
HIDDEN, EMBED, ATT = 8, 4, 8
VOCAB, GRAMS, MIN_DOCS, LEAST_Z = 4096, 8192, 4, 2.5
CACHE_WORDS = 200_000
_BASE, _ODD = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
_WORDS = re.compile(r"\w+").findall


def words(text: str | None) -> list[str]:
    return _WORDS((text or "").lower())


def grams(word: str) -> list[str]:
    w = f"<{word}>"
    return [w[i : i + n] for n in (4, 5) for i in range(len(w) - n + 1)]


def _gram_hashes(text: str, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` characters."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    n = max(0, len(codes) - size + 1)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = out * _BASE + codes[i : i + n]
    return out * _ODD


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Model:
    """Weights and the two vocabularies; rows 0 of the embeddings stand for what is unknown."""

    words: dict[str, tuple[int, float]] = field(default_factory=dict)
    grams: dict[str, tuple[int, float]] = field(default_factory=dict)
    p: dict[str, np.ndarray] = field(default_factory=dict)
    base: float = 0.0
    scale: float = 1.0
    shift: float = 0.0
    table: tuple | None = None

    # -- inputs of words

    def _gram_table(self) -> tuple[np.ndarray, ...]:
        """Sorted hashes of the grams with their indices and log-odds, and which leading 16 bits occur."""
        if self.table is None:
            names = list(self.grams)
            codes = np.array([_gram_hashes(g, len(g))[0] for g in names], np.uint64)
            order = np.argsort(codes)
            seen = np.zeros(1 << 16, bool)
            seen[codes >> np.uint64(48)] = True
            values = [self.grams[names[i]] for i in order.tolist()]
            self.table = codes[order], np.array([v[0] for v in values], np.int64), np.array([v[1] for v in values], np.float32), seen
        return self.table

    def features(self, toks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each word: index of its embedding, four statistics of log-odds, and, as one list with the offsets of the
        words, indices of its known grams."""
        pairs = [self.words.get(w, (0, 0.0)) for w in toks]
        stats = np.zeros((len(toks), 4), np.float32)
        stats[:, 0] = [v for _, v in pairs]
        keys, index, odds, seen = self._gram_table()
        owner = np.repeat(np.arange(len(toks)), [len(w) + 2 for w in toks])
        marked, found, of = "".join(f"<{w}>" for w in toks), [], []
        for n in (4, 5):
            codes = _gram_hashes(marked, n)
            at = np.flatnonzero((owner[: len(codes)] == owner[n - 1 :]) & seen[codes >> np.uint64(48)]) if len(codes) else np.empty(0, np.int64)
            if len(at) and len(keys):
                place = np.minimum(np.searchsorted(keys, codes[at]), len(keys) - 1)
                hit = keys[place] == codes[at]
                found.append(place[hit])
                of.append(owner[at[hit]])
        place, of = (np.concatenate([np.empty(0, np.int64), *x]) for x in (found, of))
        order = np.argsort(of, kind="stable")
        place, of = place[order], of[order]
        if len(of):
            first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            own, value = of[first], odds[place]
            stats[own, 1] = np.maximum.reduceat(value, first)
            stats[own, 2] = np.minimum.reduceat(value, first)
            stats[own, 3] = np.add.reduceat(value, first) / np.diff(np.append(first, len(of)))
        return np.array([i for i, _ in pairs], np.int64), stats, index[place], np.searchsorted(of, np.arange(len(toks) + 1))

    def inputs(self, at: np.ndarray, stats: np.ndarray, grams: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        out = np.zeros((len(at), 4 + 2 * EMBED), np.float32)
        out[:, :4] = stats
        out[:, 4 : 4 + EMBED] = self.p["word"][at]
        some = np.flatnonzero(cuts[1:] > cuts[:-1])
        if len(some):
            total = np.add.reduceat(self.p["gram"][grams], cuts[some], axis=0)
            out[some, 4 + EMBED :] = total / (cuts[some + 1] - cuts[some])[:, None]
        return out

    def project(self, toks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Inputs of words as both directions take them."""
        x = self.inputs(*self.features(toks))
        return x @ self.p["wf"] + self.p["bf"], x @ self.p["wx"] + self.p["bx"]

    # -- the network on windows

    def forward(self, xf: np.ndarray, xb: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        """Logits of windows from the projected inputs (batch, time, 3 x hidden) of both directions."""
        b, t, _ = xf.shape
        states = np.empty((b, t, 2 * HIDDEN), np.float32)
        tape = []
        for x, u, order, cols in (
            (xf, self.p["uf"], range(t), slice(0, HIDDEN)),
            (xb, self.p["ub"], range(t - 1, -1, -1), slice(HIDDEN, 2 * HIDDEN)),
        ):
            h, steps = np.zeros((b, HIDDEN), np.float32), []
            for i in order:
                g = h @ u
                xi = x[:, i]
                zr = _sigmoid(xi[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
                z, r, gn = zr[:, :HIDDEN], zr[:, HIDDEN:], g[:, 2 * HIDDEN :]
                n = np.tanh(xi[:, 2 * HIDDEN :] + r * gn)
                new = n + z * (h - n)
                if keep:
                    steps.append((i, h, z, r, n, gn))
                h = new
                states[:, i, cols] = h
            tape.append(steps)
        a = np.tanh(states.reshape(-1, 2 * HIDDEN) @ self.p["a"] + self.p["ab"])
        s = (a @ self.p["v"]).reshape(b, t) + mask
        s = np.exp(s - s.max(axis=1, keepdims=True))
        alpha = s / s.sum(axis=1, keepdims=True)
        pooled = np.einsum("bt,bth->bh", alpha, states)
        return pooled @ self.p["w"] + self.p["wb"][0], (states, a, alpha, pooled, tape)

    def backward(self, dlogit: np.ndarray, saved: tuple, grad: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Add to the weights' gradients; those of the projected inputs are returned."""
        states, a, alpha, pooled, tape = saved
        b, t, _ = states.shape
        grad["w"] += pooled.T @ dlogit
        grad["wb"] += dlogit.sum()
        dpool = dlogit[:, None] * self.p["w"]
        dstates = alpha[:, :, None] * dpool[:, None, :]
        dalpha = np.einsum("bh,bth->bt", dpool, states)
        ds = alpha * (dalpha - (alpha * dalpha).sum(axis=1, keepdims=True))
        grad["v"] += a.T @ ds.ravel()
        da = ds.reshape(-1, 1) * self.p["v"] * (1 - a * a)
        grad["a"] += states.reshape(-1, 2 * HIDDEN).T @ da
        grad["ab"] += da.sum(axis=0)
        dstates += (da @ self.p["a"].T).reshape(b, t, -1)
        out = []
        for name, steps, cols in (("uf", tape[0], slice(0, HIDDEN)), ("ub", tape[1], slice(HIDDEN, 2 * HIDDEN))):
            u, dx, dh = self.p[name], np.zeros((b, t, 3 * HIDDEN), np.float32), np.zeros((b, HIDDEN), np.float32)
            for i, h, z, r, n, gn in reversed(steps):
                dh = dh + dstates[:, i, cols]
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (h - n) * z * (1 - z)
                dr = dn * gn * r * (1 - r)
                dx[:, i] = np.concatenate((dz, dr, dn), axis=1)
                dg = np.concatenate((dz, dr, dn * r), axis=1)
                grad[name] += h.T @ dg
                dh = dh * z + dg @ u.T
            out.append(dx)
        return out[0], out[1]


def _around(ids: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of the window from ``start`` on with CONTEXT more on each side, 0 where there are none, and the mask
    that leaves the window to the attention."""
    rows = np.zeros(2 * CONTEXT + WINDOW, np.int64)
    low, high = max(0, start - CONTEXT), min(len(ids), start + WINDOW + CONTEXT)
    rows[low - start + CONTEXT : high - start + CONTEXT] = ids[low:high]
    mask = np.full(len(rows), -30, np.float32)
    mask[CONTEXT : CONTEXT + min(WINDOW, len(ids) - start)] = 0
    return rows, mask


def _odds(docs: Iterable[set[str]], labels: list[int], most: int) -> dict[str, tuple[int, float]]:
    """Index and clipped log-odds of what occurs in at least MIN_DOCS documents and differs by LEAST_Z deviations."""
    sides, totals = (Counter(), Counter()), [0, 0]
    for own, y in zip(docs, labels, strict=True):
        sides[y].update(own)
        totals[y] += 1
    value, z = {}, {}
    for k in sides[0] | sides[1]:
        a, b = sides[1][k], sides[0][k]
        if a + b >= MIN_DOCS:
            odds = math.log((a + 0.5) / (totals[1] + 1)) - math.log((b + 0.5) / (totals[0] + 1))
            z[k] = odds / math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
            if abs(z[k]) >= LEAST_Z:
                value[k] = odds
    top = sorted(value, key=lambda k: (-abs(z[k]), k))[:most]
    return {k: (i + 1, max(-4.0, min(4.0, value[k]))) for i, k in enumerate(top)}


def fit(texts: list[str], labels: list[int], share: float, rounds: int = 8, seed: int = 7) -> Model:
    """Train on labelled texts; ``share`` is the share of toxic ones among all that are labelled."""
    model = Model(base=share)
    if len(set(labels)) < 2:
        return model
    rng, nrng = random.Random(seed), np.random.default_rng(seed)
    toks = [words(t) for t in texts]
    model.words = _odds((set(x) for x in toks), labels, VOCAB)
    model.grams = _odds(({g for w in set(x) for g in grams(w)} for x in toks), labels, GRAMS)
    width, h3 = 4 + 2 * EMBED, 3 * HIDDEN
    init = lambda *s: (nrng.standard_normal(s) * 0.3).astype(np.float32)
    model.p = {
        "word": init(len(model.words) + 1, EMBED) * 0.1, "gram": init(len(model.grams) + 1, EMBED) * 0.1,
        "wf": init(width, h3), "bf": np.zeros(h3, np.float32), "uf": init(HIDDEN, h3),
        "wx": init(width, h3), "bx": np.zeros(h3, np.float32), "ub": init(HIDDEN, h3),
        "a": init(2 * HIDDEN, ATT), "ab": np.zeros(ATT, np.float32), "v": init(ATT), "w": init(2 * HIDDEN), "wb": np.zeros(1, np.float32),
    }
    vocab = {w: i + 1 for i, w in enumerate(sorted({w for x in toks for w in x}))}
    at_all, stats_all, grams_all, cuts_all = model.features(["", *vocab])
    at_all[0], stats_all[0] = 0, 0
    numbers = [np.array([vocab[w] for w in x]) for x in toks if x]
    y_all = [y for x, y in zip(toks, labels, strict=True) if x]
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}

    def tables() -> tuple[np.ndarray, np.ndarray]:
        x = model.inputs(at_all, stats_all, grams_all, cuts_all)
        return x @ model.p["wf"] + model.p["bf"], x @ model.p["wx"] + model.p["bx"]

    step = 0
    for turn in range(rounds):
        picked = [(_around(d, int(np.argmax(x))), y) for d, x, y in zip(numbers, window_logits(model, tables(), numbers), y_all, strict=True)]
        picked += [(_around(d, rng.randrange(max(1, len(d) - WINDOW + 1))), 0) for d, y in zip(numbers, y_all, strict=True) if y == 0 for _ in range(2)]
        rng.shuffle(picked)
        for start in range(0, len(picked), 128):
            part = picked[start : start + 128]
            rows, mask = (np.array([w[i] for w, _ in part]) for i in (0, 1))
            y = np.array([y for _, y in part], np.float32)
            used, back = np.unique(rows, return_inverse=True)
            back = back.reshape(rows.shape)
            many = cuts_all[used + 1] - cuts_all[used]
            cuts = np.concatenate(([0], np.cumsum(many)))
            grams_used = grams_all[np.repeat(cuts_all[used] - cuts[:-1], many) + np.arange(cuts[-1])]
            x = model.inputs(at_all[used], stats_all[used], grams_used, cuts)
            logits, saved = model.forward((x @ model.p["wf"] + model.p["bf"])[back], (x @ model.p["wx"] + model.p["bx"])[back], mask, keep=True)
            weight = np.where(y > 0, 1.0, 0.5).astype(np.float32)
            grad = {k: np.zeros_like(v) for k, v in model.p.items()}
            dxf, dxb = model.backward((_sigmoid(logits) - y) * weight / len(y), saved, grad)
            dx = np.zeros_like(x)
            order = np.argsort(back.ravel(), kind="stable")
            runs = np.searchsorted(back.ravel()[order], np.arange(len(used)))
            for d, w_name, b_name in ((dxf, "wf", "bf"), (dxb, "wx", "bx")):
                each = np.add.reduceat(d.reshape(-1, h3)[order], runs, axis=0)
                grad[w_name] += x.T @ each
                grad[b_name] += each.sum(axis=0)
                dx += each @ model.p[w_name].T
            np.add.at(grad["word"], at_all[used], dx[:, 4 : 4 + EMBED])
            np.add.at(grad["gram"], grams_used, np.repeat(dx[:, 4 + EMBED :] / np.maximum(many, 1)[:, None], many, axis=0))
            step += 1
            for k, g in grad.items():
                g = np.clip(g, -1, 1) + 1e-4 * model.p[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                rate = 0.01 * (1 - turn / (rounds + 1))
                model.p[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    tops = np.array([x.max() for x in window_logits(model, tables(), numbers)])
    _calibrate(model, tops, np.array(y_all), share)
    return model


def _calibrate(model: Model, tops: np.ndarray, y: np.ndarray, share: float) -> None:
    """Logistic scale and shift of the top logit, classes weighted as among all labelled rows."""
    weight = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum()))
    a, b = 1.0, 0.0
    for _ in range(200):
        p = _sigmoid(a * tops + b)
        g = np.array([(weight * (p - y) * tops).sum() + 1e-3 * (a - 1), (weight * (p - y)).sum()])
        k = weight * p * (1 - p)
        hess = np.array([[(k * tops * tops).sum() + 1e-3, (k * tops).sum()], [(k * tops).sum(), k.sum() + 1e-6]])
        d = np.linalg.solve(hess, g)
        a, b = a - 0.5 * d[0], b - 0.5 * d[1]
    model.scale, model.shift = float(a), float(b)


def _read(model: Model, tables: tuple[np.ndarray, np.ndarray], flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Attention energies and the states' shares of the logit, (SEGMENT, segments), for the words from ``starts`` on."""
    p, m = model.p, len(starts)
    states = np.empty((SEGMENT, 2 * HIDDEN, m), np.float32)
    forth = range(-WARM, SEGMENT), slice(0, HIDDEN)
    back = range(SEGMENT + WARM - 1, -1, -1), slice(HIDDEN, 2 * HIDDEN)
    for table, name, (order, rows) in ((tables[0], "uf", forth), (tables[1], "ub", back)):
        u = np.ascontiguousarray(p[name].T, np.float32)
        u[: 2 * HIDDEN] *= 0.5  # a sigmoid is a tanh of half its argument
        h = np.zeros((HIDDEN, m), np.float32)
        for k in order:
            x = np.ascontiguousarray(table[flat[starts + k]].T)
            g = u @ h
            zr, c = g[: 2 * HIDDEN], g[2 * HIDDEN :]
            x[: 2 * HIDDEN] *= 0.5
            zr += x[: 2 * HIDDEN]
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            c *= zr[HIDDEN:]
            c += x[2 * HIDDEN :]
            np.tanh(c, out=c)
            h -= c
            h *= zr[:HIDDEN]
            h += c
            if 0 <= k < SEGMENT:
                states[k, rows] = h
    a = np.matmul(np.ascontiguousarray(p["a"].T), states)
    a += p["ab"][:, None]
    np.tanh(a, out=a)
    return np.matmul(p["v"], a), np.matmul(p["w"], states)


def window_logits(model: Model, tables: tuple[np.ndarray, np.ndarray], docs: list[np.ndarray]) -> list[np.ndarray]:
    """Logits of all windows of each document, given as its words' rows in the tables of projected inputs; row 0 stands
    for no word. A text shorter than a window is one window."""
    if not docs:
        return []
    sizes = np.array([len(d) for d in docs])
    segments = -(-sizes // SEGMENT)
    room = 2 * WARM + segments * SEGMENT
    begins = np.cumsum(room) - room + WARM
    flat = np.zeros(int(room.sum()), np.int64)
    for d, at in zip(docs, begins.tolist(), strict=True):
        flat[at : at + len(d)] = d
    many = np.cumsum(segments) - segments
    starts = np.repeat(begins, segments) + (np.arange(int(segments.sum())) - np.repeat(many, segments)) * SEGMENT
    weight, share = np.zeros(len(flat), np.float32), np.zeros(len(flat), np.float32)
    for i in range(0, len(starts), SIDE_BY_SIDE):
        own = starts[i : i + SIDE_BY_SIDE]
        energy, value = _read(model, tables, flat, own)
        at = own + np.arange(SEGMENT)[:, None]
        weight[at] = np.where(flat[at] > 0, np.exp(energy), np.float32(0))
        share[at] = weight[at] * value
    span = 1
    while span < WINDOW:  # sums over windows; between two texts are more empty places than a window has
        weight, share = weight[:-span] + weight[span:], share[:-span] + share[span:]
        span *= 2
    bias = model.p["wb"][0]
    cuts = [(a, a + max(1, n - WINDOW + 1)) for a, n in zip(begins.tolist(), sizes.tolist(), strict=True)]
    return [share[a:b] / weight[a:b] + bias for a, b in cuts]


class Scorer:
    """A model with the projected inputs of the words met so far."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, int] = {}
        self.size = 1
        if self.model.p:
            self.tables = [np.repeat(x, 4096, axis=0) for x in self.model.project([""])]

    def _learn(self, fresh: list[str]) -> None:
        need = self.size + len(fresh)
        self.known.update(zip(fresh, range(self.size, need), strict=True))
        for k, new in enumerate(self.model.project(fresh)):
            while need > len(self.tables[k]):
                self.tables[k] = np.concatenate((self.tables[k], self.tables[k]))
            self.tables[k][self.size : need] = new
        self.size = need

    def __call__(self, texts: list[str | None]) -> list[float]:
        m = self.model
        if not m.p:
            return [m.base] * len(texts)
        if len(self.known) > CACHE_WORDS:
            self._reset()
        toks = [words(t) for t in texts]
        if fresh := set().union(*toks).difference(self.known):
            self._learn(list(fresh))
        where = [i for i, x in enumerate(toks) if x]
        number = self.known.__getitem__
        docs = [np.fromiter(map(number, toks[i]), np.int64, len(toks[i])) for i in where]
        out = [m.base] * len(texts)
        for i, logits in zip(where, window_logits(m, tuple(self.tables), docs), strict=True):
            out[i] = float(_sigmoid(np.float64(m.scale * float(logits.max()) + m.shift)))
        return out


def train(docs: DataFrame, labels: DataFrame, admit: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on labelled documents that ``admit`` (a condition on the labels' id) lets in."""
    own = labels.where(admit & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    n = {r["y"]: r["count"] for r in own.groupBy("y").count().collect()}
    share = n.get(1, 0) / max(1, sum(n.values()))
    ids = None
    for y in (0, 1):  # at most MAX_DOCS ids each
        part = own.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(MAX_DOCS)
        ids = part if ids is None else ids.unionByName(part)
    rows = (
        docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .join(F.broadcast(ids), "id")
        .groupBy("id", "y")
        .agg(F.min_by("text", F.xxhash64("text")).alias("text"))
        .collect()
    )
    rows.sort(key=lambda r: r["id"])
    return fit([r["text"] or "" for r in rows], [int(r["y"]) for r in rows], share)


def score(df: DataFrame, model: Model, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score, predicted`` for every row."""
    load = on_workers(df.sparkSession, model, Scorer)

    def run(ids: list, texts: list) -> dict[str, list]:
        scorer, values = load(), []
        for at in range(0, len(texts), 128):
            values += scorer(texts[at : at + 128])
        return {"id": ids, "score": values, "predicted": [int(v >= threshold) for v in values]}

    kind = dict(df.dtypes)[id_col]
    return map_batches(df, run, [id_col, text_col], f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)


def keep_clean(df: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that score under the threshold."""
    load = on_workers(df.sparkSession, model, Scorer)

    def keep(texts: list) -> list[bool]:
        scorer = load()
        return [v < threshold for at in range(0, len(texts), 128) for v in scorer(texts[at : at + 128])]

    return filter_batches(df, keep, text_col)


def held_out(id_col: str = "doc_id") -> Column:
    """The third of the ids whose labels are never learnt."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
