"""Secret scans with a randomness test battery (operator 6).

Three fixed patterns give the base spans, which always stay. Besides them every run of 20 or more token characters is a
candidate: its encoding is inferred (decimal, hexadecimal, base 32, letters, base 64), and three tests ask how far it
is from what text-like tokens of that encoding show: chi-squared uniformity over the alphabet, the number of runs of
character classes, and serial correlation. The p-values are joined by the Cauchy combination, which holds under
dependence, and a Benjamini-Hochberg rule over all candidates of the table, weighted by length because longer tokens
carry more evidence, controls the false-discovery rate. Letters of one case are held against words by their turns
between vowel and consonant and their usual pairs.

How it scales: texts are read once, in place. Only candidates are kept, next to their document; the rule needs counts
per (length class, p-value bin), a table of fixed size, and its threshold is applied by column functions.

Edge cases: null and empty texts have no spans; positions are code points, ends exclusive; repeated rows are scanned
each; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import checkpointed, map_batches

ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # maximal runs, so the same as runs of any length with the short ones dropped
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}(?:={1,2}(?![A-Za-z0-9+/_=-]))?")  # "=" pads, and else parts name and value
SPLITS = re.compile(r"[^+/]+"), re.compile(r"[^_-]+")  # of a run that mixes the separators of two alphabets
KINDS = ("assign", "access", "hex", "random")

#: Encodings in the order they are tried: characters, and how uneven text-like tokens are (size x sum of squared
#: shares, less 1).
ENCODINGS = (
    ("decimal", "0123456789", 0.8),
    ("hex", "0123456789abcdef", 1.0),
    ("HEX", "0123456789ABCDEF", 1.0),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 1.1),
    ("letters", "abcdefghijklmnopqrstuvwxyz", 0.7),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 3.0),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", 3.0),
)
TEXT_SWITCH, TEXT_SERIAL = 0.15, 0.5
#: Of adjacent letters of words, at least about these shares change between vowel and consonant, or are in PAIRS.
TEXT_TURNS, TEXT_PAIRS = 0.55, 0.4
PAIRS = frozenset(
    "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic "
    "ne ea ra ce li ch ll be ma si om ur ei ie ge un da el la qu ue os ad do ci ca ta na mi no lo il us ui ai sc ss tr "
    "pr pe po di et em ac ab id ig im ol op ot ow ut wi ho so su sa sp wa we".split()
)
LENGTH_CLASSES, P_BINS, P_STEP = 8, 3000, 0.01


def _normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _binomial_tail(n: int, p: float, k: int) -> float:
    """P(X >= k), summed exactly for short tokens, by the normal law for long ones."""
    if k <= 0:
        return 1.0
    if n > 200:
        return _normal_cdf(-(k - 0.5 - n * p) / math.sqrt(n * p * (1 - p)))
    return min(1.0, sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1)))


def infer(token: str) -> tuple[str, str, float] | None:
    used = set(token)
    return next((e for e in ENCODINGS if used <= set(e[1])), None)


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def _even(token: str) -> bool:
    """Whether the letters can be uniform: a run of few letters is neither words nor random."""
    chi = 26 / len(token) * sum(v * v for v in Counter(token).values()) - len(token)
    return chi <= 25 + 3.1 * math.sqrt(50)


def _unlike_words(token: str) -> list[float]:
    """How likely words have so few turns between vowel and consonant, and so few of the usual pairs of letters."""
    n = len(token) - 1
    turns = sum((a in "aeiouy") != (b in "aeiouy") for a, b in zip(token, token[1:], strict=False))
    usual = sum(token[i : i + 2] in PAIRS for i in range(n))
    return [_binomial_tail(n, 1 - p, n - k) for p, k in ((TEXT_TURNS, turns), (TEXT_PAIRS, usual))]


def p_value(token: str) -> float:
    """How likely a text-like token looks at least as random as this one."""
    token = token.rstrip("=")
    found = infer(token)
    if found is None or len(token) < 8:
        return 1.0
    name, alphabet, uneven = found
    n, size = len(token), len(alphabet)
    counts = Counter(token)
    chi = size / n * sum(v * v for v in counts.values()) - n
    mean, var = (size - 1) + n * uneven, 2 * (size - 1 + 2 * n * uneven)
    tests = [_normal_cdf((chi - mean) / math.sqrt(var))]
    core = [c for c in token if c.isalnum()]  # separators join words, they say nothing about order
    kinds = [_kind(c) for c in core]
    if len(set(kinds)) > 1 and len(core) > 4:
        switches = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False))
        tests.append(_binomial_tail(len(core) - 1, TEXT_SWITCH, switches))
        place = {c: i for i, c in enumerate(alphabet)}
        codes = [place[c] for c in core]
        mid = sum(codes) / len(core)
        spread = sum((c - mid) ** 2 for c in codes)
        serial = sum((a - mid) * (b - mid) for a, b in zip(codes, codes[1:], strict=False)) / spread if spread else 1.0
        serial = max(-0.999, min(0.999, serial))
        tests.append(_normal_cdf((math.atanh(serial) - math.atanh(TEXT_SERIAL)) * math.sqrt(len(core) - 3)))
    elif name != "decimal":  # letters of one case: words alternate vowels and consonants, so order says little
        if name in ("letters", "base32") and _even(token):
            tests += _unlike_words(token.lower())
        else:
            tests = [max(tests[0], 0.05), 1.0]
    joined = sum(math.tan((0.5 - min(max(p, 1e-15), 1 - 1e-15)) * math.pi) for p in tests) / len(tests)
    return min(1.0, max(1e-15, 0.5 - math.atan(joined) / math.pi if joined < 1e6 else 1 / (joined * math.pi)))


def candidates(token: str) -> list[tuple[int, int, float]]:
    """``start, end, p-value`` of a run, or of its parts where it mixes the separators of two alphabets. Both ways to
    split are tried, for which the p-values are doubled."""
    bare = token.rstrip("=")
    if not (set(bare) & set("+/") and set(bare) & set("_-")):
        return [(0, len(token), p_value(token))]
    ways = []
    for split in SPLITS:
        parts = [m.span() for m in split.finditer(bare) if m.end() - m.start() >= 20]
        ways.append([(a, len(token) if b == len(bare) else b, min(1.0, 2 * p_value(bare[a:b]))) for a, b in parts])
    best = min(ways, key=lambda way: min((p for _, _, p in way), default=2.0))
    return best or [(0, len(token), 1.0)]


def length_class(n: int) -> int:
    return min(LENGTH_CLASSES - 1, int(math.log2(n / 20) * 2)) if n >= 20 else 0


def scan_text(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int]]]:
    """Base spans ``(start, kind, end)`` in order, and candidates ``(start, end, length class, p-value bin)``."""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base.sort()
    more = []
    for m in TOKEN.finditer(text):
        for first, last, p in candidates(m.group()):
            a, b = m.start() + first, m.start() + last
            if not any(s < b and a < e for s, _, e in base):
                more.append((a, b, length_class(b - a), min(P_BINS - 1, int(-math.log10(p) / P_STEP))))
    return base, more


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def weights(totals: dict[int, int]) -> dict[int, float]:
    """Weight of each length class, 1 on average over the candidates."""
    raw = {c: float(1 + c) for c in totals}
    mean = sum(raw[c] * n for c, n in totals.items()) / max(1, sum(totals.values()))
    return {c: w / mean for c, w in raw.items()}


def cutoffs(counts: dict[tuple[int, int], int], rate: float) -> dict[int, int]:
    """Smallest p-value bin (bins count upwards as p falls) that is a discovery, for each length class."""
    totals: Counter = Counter()
    for (c, _), n in counts.items():
        totals[c] += n
    w, m = weights(totals), sum(totals.values())
    weighted = sorted((10 ** (-b * P_STEP) / w[c], n) for (c, b), n in counts.items())  # the upper end of each bin
    limit, seen = 0.0, 0
    for p, n in weighted:
        seen += n
        if p <= rate * seen / m:
            limit = p
    out = {}
    for c in totals:
        bins = [b for (k, b) in counts if k == c and 10 ** (-b * P_STEP) / w[c] <= limit]
        if bins:
            out[c] = min(bins)
    return out


def scan(df: DataFrame, rate: float = 0.001, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_assign, n_access, n_hex, base_sha256, spans, n_random`` for every row."""

    def run(ids: list, texts: list) -> dict[str, list]:
        found = [scan_text(t or "") for t in texts]
        base = [b for b, _ in found]
        struct = lambda spans: [{"s": s, "k": k, "e": e} for s, k, e in spans]
        return {
            "id": ids,
            **{f"n_{KINDS[k]}": [sum(x[1] == k for x in b) for b in base] for k in range(3)},
            "base_sha256": [hashlib.sha256(_joined(b).encode()).hexdigest() for b in base],
            "base": [struct(b) for b in base],
            "more": [[{"s": s, "e": e, "c": c, "p": p} for s, e, c, p in m] for _, m in found],
        }

    schema = (
        f"id {dict(df.dtypes)[id_col]}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, "
        "base array<struct<s:int,k:int,e:int>>, more array<struct<s:int,e:int,c:int,p:int>>"
    )
    found = checkpointed(map_batches(df, run, [id_col, text_col], schema))
    rows = found.select(F.explode("more").alias("m")).groupBy("m.c", "m.p").count().collect()
    cut = cutoffs({(r[0], r[1]): r[2] for r in rows}, rate)

    def chosen(m: Column) -> Column:
        hit = F.lit(False)
        for c, p in cut.items():
            hit = hit | ((m["c"] == c) & (m["p"] >= p))
        return hit

    added = F.transform(
        F.filter("more", chosen), lambda m: F.struct(m["s"].alias("s"), F.lit(3).alias("k"), m["e"].alias("e"))
    )
    names = F.array(*[F.lit(k) for k in KINDS])
    spans = F.transform(
        F.sort_array(F.concat("base", added)),
        lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string")),
    )
    return found.select(
        F.col("id").alias(id_col), "n_assign", "n_access", "n_hex", "base_sha256",
        F.array_join(spans, ",").alias("spans"), F.size(added).cast("bigint").alias("n_random"),
    )
