"""Words against an affix dictionary, one at a time: forms, compounds, break points and corrections.

``operators.morphology`` checks whole tables by joins. What a join cannot say (compounds of any number of parts, rules
over flags of the parts, corrections that depend on those found before) is done here, for each distinct word, by
workers that hold the dictionary (see ``operators.spelling``).
"""

from __future__ import annotations

import itertools
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

from glyphmill.functions import metrics as M

NUMBER = re.compile(r"\d+(\.\d+)?")
MOST, MOST_SOUNDS, MOST_ROOTS, MOST_GUESSES = 15, 2, 100, 200
#: Kinds of correction after which no similar words are sought.
GOOD = {"spaceword", "uppercase", "replchars"}
TURKIC = ("tr", "az", "crh")


class Affix(NamedTuple):
    kind: str
    flag: str
    cross: bool
    strip: str
    add: str
    cond: re.Pattern | None
    flags: frozenset


class Entry(NamedTuple):
    stem: str
    flags: frozenset
    morph: tuple = ()


class Form(NamedTuple):
    """A reading of a word: a stem with affixes, the outer ones last."""

    text: str
    stem: str
    prefixes: tuple = ()
    suffixes: tuple = ()
    entry: Entry | None = None

    @property
    def affixes(self) -> tuple:
        return self.prefixes + self.suffixes

    @property
    def flags(self) -> frozenset:
        """Of the entry and of the innermost affixes."""
        own = self.entry.flags if self.entry else frozenset()
        for side in (self.prefixes, self.suffixes):
            if side:
                own = own | side[0].flags
        return own


class Conversion:
    """ICONV or OCONV: at each place the longest input that fits is replaced; ``_`` ties it to an end of the word."""

    def __init__(self, pairs: list[tuple[str, str]]) -> None:
        rows = [(a.replace("_", ""), a.startswith("_"), a.endswith("_"), b.replace("_", " ")) for a, b in pairs]
        self.rows = sorted(rows, key=lambda r: -len(r[0]))

    def __call__(self, word: str) -> str:
        out, at = [], 0
        while at < len(word):
            for text, first, last, new in self.rows:
                if text and word.startswith(text, at) and not (first and at) and not (last and at + len(text) < len(word)):
                    out.append(new)
                    at += len(text)
                    break
            else:
                out.append(word[at])
                at += 1
        return "".join(out)


class CompoundRule:
    """A pattern over the parts' flags, such as ``A*B?C`` or ``(aa)(bb)*``."""

    def __init__(self, text: str) -> None:
        self.items = [(a or b, many) for a, b, many in re.findall(r"(?:\(([^)]+)\)|([^*?()]))([*?]?)", text)]

    def _states(self, states: set[int]) -> set[int]:
        """Places reachable without another part."""
        todo, seen = list(states), set(states)
        while todo:
            i = todo.pop()
            if i < len(self.items) and self.items[i][1] and i + 1 not in seen:
                seen.add(i + 1)
                todo.append(i + 1)
        return seen

    def step(self, states: set[int], flags: frozenset) -> set[int]:
        after = set()
        for i in self._states(states):
            if i < len(self.items) and self.items[i][0] in flags:
                after.add(i if self.items[i][1] == "*" else i + 1)
        return after

    def complete(self, states: set[int]) -> bool:
        return len(self.items) in self._states(states)


class Sounds:
    """A PHONE table: rules ``letters(any of these)letters-- < ^ $`` with what they are replaced by."""

    _RULE = re.compile(r"([^(\-<0-9^$]*)(?:\(([^)]*)\))?([^(\-<0-9^$]*)(-*)<?([0-9]?)(\^{0,2})(\$?)")

    def __init__(self, rows: list[tuple[str, str]]) -> None:
        self.rules = defaultdict(list)
        for rule, new in rows:
            before, group, after, keep, _, start, end = self._RULE.match(rule).groups()
            parts = re.escape(before) + (f"[{re.escape(group)}]" if group else "") + re.escape(after)
            first = before[:1] or (group or "")
            for c in first:
                self.rules[c].append((re.compile(parts + ("$" if end else "")), bool(start), len(keep), "" if new == "_" else new))

    def __call__(self, word: str) -> str:
        word, out, at = word.upper(), [], 0
        while at < len(word):
            for pattern, start, keep, new in self.rules.get(word[at], ()):
                hit = pattern.match(word, at)
                if hit and not (start and at):
                    out.append(new)
                    at += max(1, hit.end() - at - keep)
                    break
            else:
                at += 1
        return "".join(out)


def overlap(size: int, a: str, b: str, weighted: bool = False, any_mismatch: bool = False, longer_worse: bool = False) -> int:
    """``metrics.ngram_score`` of two strings."""
    if not b:
        return 0
    total = 0
    for n in range(1, size + 1):
        runs = [a[i : i + n] in b for i in range(len(a) - n + 1)]
        score = sum(runs)
        if weighted:
            score -= len(runs) - sum(runs) + sum(not runs[i] for i in {0, len(runs) - 1} if runs)
        total += score
        if score < 2 and not weighted:
            break
    gap = len(b) - len(a)
    return total - max(0, (gap if longer_worse else abs(gap) if any_mismatch else 0) - 2)


def common_start(a: str, b: str) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


# --- candidates that differ by one slip ---------------------------------------------------------------------------------


def _swaps(w: str) -> Iterator[str]:
    for i in range(len(w) - 1):
        yield w[:i] + w[i + 1] + w[i] + w[i + 2 :]
    if len(w) in (4, 5):  # two pairs at once, at both ends or next to them
        middle = w[2] if len(w) == 5 else ""
        yield w[1] + w[0] + middle + w[-1] + w[-2]
        if len(w) == 5:
            yield w[0] + w[2] + w[1] + w[-1] + w[-2]


def _far_swaps(w: str) -> Iterator[str]:
    for i, j in ((i, i + d) for i in range(len(w)) for d in (2, 3)):
        if j < len(w):
            yield w[:i] + w[j] + w[i + 1 : j] + w[i] + w[j + 1 :]


def _near_keys(w: str, layout: str) -> Iterator[str]:
    for i, c in enumerate(w):
        put = lambda x, i=i: w[:i] + x + w[i + 1 :]
        if c != c.upper():
            yield put(c.upper())
        for at in (m.start() for m in re.finditer(re.escape(c), layout)):
            yield from (put(layout[k]) for k in (at - 1, at + 1) if 0 <= k < len(layout) and layout[k] != "|")


def _moves(w: str) -> Iterator[str]:
    n = len(w)
    for i in range(n):
        yield from (w[:i] + w[i + 1 : k] + w[i] + w[k:] for k in (i + 3, i + 4) if k < n)
    for i in reversed(range(n)):
        yield from (w[:k] + w[i] + w[k:i] + w[i + 1 :] for k in range(min(max(0, i - 3), i - 1), -1, -1))


def _mapped(w: str, groups: list[list[str]], start: int = 0) -> Iterator[str]:
    if start >= len(w):
        return
    for group in groups:
        for old in group:
            at = w.find(old, start)
            if at >= 0:
                for new in group:
                    if new != old:
                        made = w[:at] + new + w[at + len(old) :]
                        yield made
                        yield from _mapped(made, groups, at + 1)


def _replaced(w: str, rows: list[tuple[str, str]]) -> Iterator[str]:
    if len(w) >= 2:
        for pattern, new in rows:
            for hit in re.finditer(pattern, w):
                yield w[: hit.start()] + new.replace("_", " ") + w[hit.end() :]


def slips(w: str, o: dict) -> Iterator[tuple[str | tuple, str]]:
    """Candidates with their kinds in the order in which they are tried; a tuple is several words."""
    tries, dash = o.get("TRY", ""), "-" in o.get("TRY", "") or "a" in o.get("TRY", "")
    halves = [(w[:i], w[i:]) for i in range(1, len(w))]
    yield from ((x, "uppercase") for x in [w.upper()])
    for x in _replaced(w, o.get("REP", [])):
        yield x, "replchars"
        if " " in x:
            yield tuple(x.split(" ")), "replchars"
    for a, b in halves:
        yield f"{a} {b}", "spaceword"
        if dash:
            yield f"{a}-{b}", "spaceword"
    one = len(w) >= 2
    groups = (
        (_mapped(w, o.get("MAP", [])) if one else (), "mapchars"),
        (_swaps(w), "swapchar"),
        (_far_swaps(w), "longswapchar"),
        (_near_keys(w, o.get("KEY", "")), "badcharkey"),
        ((w[:i] + w[i + 1 :] for i in range(len(w)) if one), "extrachar"),
        ((w[:i] + c + w[i:] for c in tries for i in range(len(w) + 1)), "forgotchar"),
        (_moves(w) if one else (), "movechar"),
        ((w[:i] + c + w[i + 1 :] for c in tries for i in reversed(range(len(w))) if w[i] != c), "badchar"),
        ((w[: i - 1] + w[i + 1 :] for i in range(2, len(w)) if len(w) >= 5 and w[i - 2] == w[i] and w[i - 3] == w[i - 1]), "doubletwochars"),
    )
    for made, kind in groups:
        yield from ((x, kind) for x in made)
    if not o.get("NOSPLITSUGS"):
        yield from ((x, "twowords") for x in halves)


class Speller:
    """One dictionary: options and rules of its affix file, entries of its word file."""

    def __init__(self, options: dict, rules: list[Affix], entries: list[Entry]) -> None:
        self.o = o = dict(options)
        self.rules = {"SFX": defaultdict(list), "PFX": defaultdict(list)}
        self.by_flag = {"SFX": defaultdict(list), "PFX": defaultdict(list)}
        for r in rules:
            self.rules[r.kind][r.add].append(r)
            self.by_flag[r.kind][r.flag].append(r)
        self.longest = {k: max(map(len, v), default=0) for k, v in self.rules.items()}
        self.entries, self.low = defaultdict(list), defaultdict(list)
        rep = list(o.get("REP", []))
        self.other: dict[str, list[str]] = defaultdict(list)  # spellings given with a word as what people write for it
        for e in entries:
            self.entries[e.stem].append(e)
            if e.stem != e.stem.lower():
                self.low[e.stem.lower()].append(e)
            for ph in (m[3:] for m in e.morph if m.startswith("ph:")):
                if ph.endswith("*"):
                    pair = ph[:-2], e.stem[:-1]
                elif "->" in ph:
                    pair = tuple(ph.split("->", 1))
                else:
                    pair = ph, e.stem
                    self.other[e.stem].append(ph)
                if all(pair):
                    rep.append(pair)
        o["REP"] = rep
        self.convert = Conversion(o["ICONV"]) if o.get("ICONV") else str
        self.show = Conversion(o["OCONV"]) if o.get("OCONV") else str
        self.patterns = [CompoundRule(x) for x in o.get("COMPOUNDRULE", [])]
        self.sounds = Sounds(o["PHONE"]) if o.get("PHONE") else None
        self.breaks = [re.compile(f"^({re.escape(b[1:])})" if b.startswith("^") else f"({re.escape(b[:-1])})$" if b.endswith("$") else f".({re.escape(b)}).") for b in o.get("BREAK", ["-", "^-", "-$"])]
        bad = {o.get(k) for k in ("FORBIDDENWORD", "NOSUGGEST", "ONLYINCOMPOUND")}
        self.roots = [e for e in entries if not e.flags & bad]
        self.good = lru_cache(20_000)(self._good)

    # -- letter case

    def lower(self, w: str) -> str:
        if self.o.get("LANG", "")[:2] in TURKIC:
            w = w.replace("İ", "i").replace("I", "ı")
        return w.lower().replace("i̇", "i")

    def upper(self, w: str) -> str:
        if self.o.get("LANG", "")[:2] in TURKIC:
            w = w.replace("i", "İ").replace("ı", "I")
        return w.upper()

    def title(self, w: str) -> str:
        return self.upper(w[:1]) + self.lower(w[1:])

    def case(self, w: str) -> str:
        low, up = self.lower(w), self.upper(w)
        if self.o.get("CHECKSHARPS") and "ß" in w:  # has no capital of its own
            up = self.upper(w.replace("ß", "")) if w.replace("ß", "") == self.upper(w.replace("ß", "")) else up
            if w.replace("ß", "") == up:
                return "ALL"
        if w == low:
            return "NO"
        if w == up:
            return "ALL"
        starts = w[0] == self.upper(w[0])
        return ("INIT" if w[1:] == self.lower(w[1:]) else "HUHINIT") if starts else "HUH"

    def sharp(self, w: str) -> list[str]:
        """Readings of a word in capitals with some SS as ß, in lower case."""
        if not (self.o.get("CHECKSHARPS") and "SS" in w):
            return []
        parts = self.lower(w).split("ss")
        made = ["".join(itertools.chain(*zip(parts, [*seps, ""], strict=True))) for seps in itertools.product(("ß", "ss"), repeat=min(len(parts) - 1, 5))] if len(parts) <= 6 else []
        return [x for x in made if "ß" in x]

    def variants(self, w: str) -> list[str]:
        kind, low = self.case(w), self.lower(w)
        more = {"INIT": [low], "ALL": [low, self.title(w), *(y for x in self.sharp(w) for y in (x, self.title(x)))], "HUHINIT": [low[:1] + w[1:]]}
        return list(dict.fromkeys([w, *more.get(kind, [])]))

    def corrections(self, w: str) -> list[str]:
        kind, low = self.case(w), self.lower(w)
        more = {"INIT": [low], "ALL": [low, self.title(w)], "HUHINIT": [low[:1] + w[1:], low, self.title(w)], "HUH": [low]}
        return list(dict.fromkeys([w, *more.get(kind, [])]))

    def coerce(self, text: str, kind: str) -> str:
        return self.upper(text) if kind == "ALL" else self.upper(text[:1]) + text[1:] if kind in ("INIT", "HUHINIT") else text

    # -- single words

    def _has(self, flags: frozenset, name: str) -> bool:
        return self.o.get(name) is not None and self.o[name] in flags

    def _stem_has(self, word: str, name: str, every: bool = False) -> bool:
        held = self.entries.get(word, [])
        return bool(held) and (all if every else any)(self._has(e.flags, name) for e in held)

    def _stripped(self, form: Form, kind: str, need: frozenset = frozenset(), ban: frozenset = frozenset()) -> Iterator[Form]:
        """The form with one more affix taken off; an affix between two must carry the outer one's flag."""
        word, suffix = form.stem, kind == "SFX"
        for n in range(min(len(word), self.longest[kind]) + 1):
            piece = (word[len(word) - n :] if suffix else word[:n]) if n else ""
            for r in self.rules[kind].get(piece, ()):
                if not need <= r.flags or ban & r.flags:
                    continue
                rest = word[: len(word) - n] + r.strip if suffix else r.strip + word[n:]
                if (n or r.strip or piece == r.add) and (r.cond is None or r.cond.search(rest)):
                    side = (form.suffixes if suffix else form.prefixes)
                    if side and side[0].flag not in r.flags:
                        continue
                    yield form._replace(stem=rest, **{"suffixes" if suffix else "prefixes": (r, *side)})

    def readings(self, word: str, pos: str | None = None) -> Iterator[Form]:
        """All ways to take affixes off; inside a compound only with affixes that may stand there."""
        permit = frozenset(x for x in [self.o.get("COMPOUNDPERMITFLAG")] if x)
        ban = frozenset(x for x in [self.o.get("COMPOUNDFORBIDFLAG")] if x) if pos else frozenset()
        bare = Form(word, word)
        yield bare
        after = permit if pos in ("begin", "middle") else frozenset()
        before = permit if pos in ("middle", "end") else frozenset()
        ends = pos in (None, "end") or bool(permit)
        starts = pos in (None, "begin") or bool(permit)

        def suffixed(form: Form) -> Iterator[Form]:
            for one in self._stripped(form, "SFX", after, ban):
                yield one
                yield from self._stripped(one, "SFX", frozenset(), ban)

        if ends:
            yield from suffixed(bare)
        if starts:
            for one in self._stripped(bare, "PFX", before, ban):
                inner = [one]
                if self.o.get("COMPLEXPREFIXES"):
                    inner += self._stripped(one, "PFX", frozenset(), ban)
                for p in inner:
                    yield p
                    if ends and all(x.cross for x in p.prefixes):
                        yield from (f for f in suffixed(p) if all(x.cross for x in f.suffixes))

    def _valid(self, f: Form, case: str, nosuggest: bool, pos: str | None) -> bool:
        root, flags = f.entry.flags, f.flags
        if not nosuggest and self._has(root, "NOSUGGEST"):
            return False
        if self._has(root, "KEEPCASE") and case != self.case(f.entry.stem) and not (self.o.get("CHECKSHARPS") and "ß" in f.entry.stem):
            return False
        if self._has(root, "NEEDAFFIX") and not f.affixes:
            return False
        if f.affixes and all(self._has(x.flags, "NEEDAFFIX") for x in f.affixes):
            return False
        if any(side and side[0].flag not in flags for side in (f.prefixes, f.suffixes)):
            return False
        around = [bool(side) and self._has(side[-1].flags | side[0].flags, "CIRCUMFIX") for side in (f.prefixes, f.suffixes)]
        if around[0] != around[1]:
            return False
        if pos is None:
            return not self._has(flags, "ONLYINCOMPOUND")
        return self._has(flags, "COMPOUNDFLAG") or self._has(flags, {"begin": "COMPOUNDBEGIN", "middle": "COMPOUNDMIDDLE", "end": "COMPOUNDEND"}[pos])

    def words(self, word: str, case: str, nosuggest: bool = True, pos: str | None = None) -> Iterator[Form]:
        """Readings whose stem is an entry that allows them."""
        for r in self.readings(word, pos):
            held = self.entries.get(r.stem, [])
            if (pos or r.affixes) and any(self._has(e.flags, "FORBIDDENWORD") for e in held):
                continue
            if pos == "begin" and case == "INIT" and self.o.get("FORCEUCASE"):
                held = [*held, *self.entries.get(self.lower(r.stem), [])]
            found = [f for f in (r._replace(entry=e) for e in held) if self._valid(f, case, nosuggest, pos)]
            yield from found
            if not found and pos is None and case == "ALL" and self.case(word) == "NO":
                for e in self.low.get(self.lower(r.stem), []):  # entries with capitals, typed in capitals
                    f = r._replace(entry=e)
                    if not (r.affixes and self._has(e.flags, "FORBIDDENWORD")) and self._valid(f, case, nosuggest, None):
                        yield f

    # -- compounds

    def by_flags(self, rest: str, case: str, nosuggest: bool, depth: int = 0) -> Iterator[tuple[Form, ...]]:
        least, most = self.o.get("COMPOUNDMIN", 3), self.o.get("COMPOUNDWORDMAX")
        if depth:
            yield from ((f,) for f in self.words(rest, case, nosuggest, "end"))
        if len(rest) < 2 * least or (most and depth >= most):
            return
        pos = "middle" if depth else "begin"
        for cut in range(least, len(rest) - least + 1):
            left, right = rest[:cut], rest[cut:]
            heads = list(self.words(left, case, nosuggest, pos))
            if self.o.get("SIMPLIFIEDTRIPLE") and left[-1] == right[0]:
                heads += [f._replace(text=left) for f in self.words(left + left[-1], case, nosuggest, pos)]
            if heads:
                for tail in self.by_flags(right, case, nosuggest, depth + 1):
                    yield from ((h, *tail) for h in heads)

    def by_rules(self, rest: str, states: list[set[int]] | None = None, depth: int = 0) -> Iterator[tuple[Form, ...]]:
        least, most = self.o.get("COMPOUNDMIN", 3), self.o.get("COMPOUNDWORDMAX")
        states = [{0} for _ in self.patterns] if states is None else states
        if depth:
            for e in self.entries.get(rest, []):
                if any(p.complete(p.step(s, e.flags)) for p, s in zip(self.patterns, states, strict=True)):
                    yield (Form(rest, rest, entry=e),)
        if len(rest) < 2 * least or (most and depth >= most):
            return
        for cut in range(least, len(rest) - least + 1):
            for e in self.entries.get(rest[:cut], []):
                after = [p.step(s, e.flags) for p, s in zip(self.patterns, states, strict=True)]
                if any(after):
                    yield from ((Form(rest[:cut], rest[:cut], entry=e), *tail) for tail in self.by_rules(rest[cut:], after, depth + 1))

    def _spoilt(self, parts: tuple[Form, ...], case: str) -> bool:
        """Whether the dictionary's checks forbid the compound."""
        o = self.o
        if o.get("FORCEUCASE") and case not in ("ALL", "INIT") and self._stem_has(parts[-1].text, "FORCEUCASE"):
            return True
        for k, (a, b) in enumerate(itertools.pairwise(parts)):
            left, right = a.text, b.text
            known = lambda w: any(self.words(w, case))
            edge = left[-1:], right[:1]
            if (
                self._stem_has(left, "COMPOUNDFORBIDFLAG")
                or known(f"{left} {right}")
                or (o.get("CHECKCOMPOUNDREP") and any(known(x) for x in _replaced(left + right, o["REP"])))
                or (o.get("CHECKCOMPOUNDTRIPLE") and (len(set(left[-2:] + right[0])) == 1 or len(set(left[-1] + right[:2])) == 1))
                or (o.get("CHECKCOMPOUNDCASE") and "-" not in edge and any(c == c.upper() for c in edge))
                or (o.get("CHECKCOMPOUNDDUP") and left == right and k == len(parts) - 2)
                or any(self._clash(p, a, b) for p in o.get("CHECKCOMPOUNDPATTERN", []))
            ):
                return True
        return False

    def _clash(self, pattern: tuple[str, str], a: Form, b: Form) -> bool:
        """``end/flag begin/flag``; 0 stands for an unchanged stem."""
        for rule, part, ends in zip(pattern, (a, b), (True, False), strict=True):
            text, _, flag = rule.partition("/")
            if text == "0":
                text = ""
                if not part.affixes:
                    return False
            if not (part.stem.endswith(text) if ends else part.stem.startswith(text)) or (flag and flag not in part.flags):
                return False
        return True

    def compounds(self, word: str, case: str, nosuggest: bool = True) -> Iterator[tuple[Form, ...]]:
        if self._stem_has(word, "FORBIDDENWORD"):
            return
        if self.o.get("COMPOUNDFLAG") or self.o.get("COMPOUNDBEGIN"):
            yield from (c for c in self.by_flags(word, case, nosuggest) if not self._spoilt(c, case))
        if self.patterns:
            yield from (c for c in self.by_rules(word) if not self._spoilt(c, case))

    # -- lookup

    def forms(self, word: str, cased: bool = True, nosuggest: bool = True, affixed: bool = True, compound: bool = True) -> Iterator[tuple[Form, ...]]:
        """Readings as one part, or as the parts of a compound."""
        case = self.case(word) if word else "NO"
        for v in self.variants(word) if cased else [word]:
            if affixed:
                for f in self.words(v, case, nosuggest):
                    if case == "ALL" and "ß" in word and "ß" in f.stem and self.o.get("CHECKSHARPS") and self._has(f.flags, "KEEPCASE"):
                        continue
                    yield (f,)
            if compound:
                yield from self.compounds(v, case, nosuggest)

    def _good(self, word: str, cased: bool, nosuggest: bool, affixed: bool, compound: bool) -> bool:
        return next(self.forms(word, cased, nosuggest, affixed, compound), None) is not None

    def pieces(self, text: str, depth: int = 0) -> Iterator[list[str]]:
        """The text whole, then split at break points, ten at most."""
        if depth > 10:
            return
        yield [text]
        for b in self.breaks:
            at = 0
            while hit := b.search(text, at):
                yield from ([text[: hit.start(1)], *more] for more in self.pieces(text[hit.end(1) :], depth + 1))
                at = hit.end()

    def correct(self, word: str) -> bool:
        if self._stem_has(word, "FORBIDDENWORD", every=True):
            return False
        word = self.convert(word)
        word = word.translate({ord(c): None for c in self.o.get("IGNORE") or ""})
        if NUMBER.fullmatch(word):
            return True
        return any(all(not p or self.good(p, True, True, True, True) for p in parts) for parts in self.pieces(word))

    def stems(self, word: str) -> list[str]:
        """Stems of the word's readings, each once."""
        return list(dict.fromkeys(f.entry.stem for parts in self.forms(word) for f in parts if f.entry))

    # -- corrections

    def suggest(self, word: str) -> list[tuple[str, str]]:
        """Corrections with their kinds, best first, each once."""
        case, seen = (self.case(word) if word else "NO"), {}
        plain = lambda w: self.good(w, False, False, True, True)
        if self.o.get("CHECKSHARPS") and case == "ALL" and "ß" in word and self.good(word.replace("ß", "SS"), True, False, True, True):
            return [(word.replace("ß", "SS"), "checksharps")]
        if self.o.get("FORCEUCASE") and case == "NO" and plain(self.title(word)):
            return [(self.title(word), "forceucase")]
        done = False
        for k, variant in enumerate(self.corrections(word)):
            if k and plain(variant):
                self._keep(variant, "case", word, case, seen)
            whole_only = False
            for compound, most in ((False, MOST), (True, self.o.get("MAXCPDSUGS", 3))):
                if compound and whole_only:
                    break
                for text, kind in self._tried(variant, compound, most):
                    if self._keep(text, kind, word, case, seen):
                        done |= kind in GOOD
                        whole_only |= kind in ("uppercase", "replchars", "mapchars")
                        if kind == "spaceword" and not compound:
                            return list(seen.items())
        if done:
            return list(seen.items())
        if "-" in word and not any("-" in s for s in seen):
            parts = word.split("-")
            at = next((i for i, p in enumerate(parts) if not plain(p)), None)
            if at is not None:
                made = ("-".join([*parts[:at], s, *parts[at + 1 :]]) for s, _ in self.suggest(parts[at]))
                seen.update({x: "dashes" for x in made if x not in seen and self.correct(x)})
        for guesses, kind, most in ((self._similar(word, seen), "ngram", self.o.get("MAXNGRAMSUGS", 4)), (self._sounding(word), "phonet", MOST_SOUNDS)):
            n = 0
            for text in guesses:
                if n >= most:
                    break
                n += self._keep(text, kind, word, case, seen, apart=True)
        return list(seen.items())

    def _tried(self, word: str, compound: bool, most: int) -> Iterator[tuple[str, str]]:
        ok = lambda w: self.good(w, False, False, not compound, compound)
        tries, n = self.o.get("TRY", ""), 0
        for made, kind in slips(word, self.o):
            if n > most:
                return
            if isinstance(made, str):
                out = [made] if ok(made) else []
            else:
                out = [" ".join(made)] if all(map(ok, made)) else []
                if out and kind == "twowords" and ("-" in tries or "a" in tries):
                    out.append("-".join(made))
            for text in out:
                yield text, kind
                n += 1

    def _keep(self, text: str, kind: str, word: str, case: str, seen: dict, apart: bool = False) -> bool:
        """Add a correction in the typed word's case, unless it is forbidden or there already."""
        if not (self._stem_has(text, "KEEPCASE") and not (self.o.get("CHECKSHARPS") and "ß" in text)):
            cased = self.coerce(text, case)
            cased = text if cased != text and self._stem_has(cased, "FORBIDDENWORD") else cased
            at = cased.find(" ")
            if case in ("HUH", "HUHINIT") and 0 < at < len(word) and cased[at + 1 : at + 2] != word[at] and cased[at + 1 : at + 2].upper() == word[at]:
                cased = cased[: at + 1] + word[at] + cased[at + 2 :]
            text = cased
        if self._stem_has(text, "FORBIDDENWORD"):
            return False
        text = self.show(text)
        if text in seen or (apart and any(s.lower() in text.lower() for s in seen)):
            return False
        seen[text] = kind
        return True

    def _root_score(self, word: str, e: Entry) -> int:
        score = lambda s: overlap(3, word, s, longer_worse=True) + common_start(word, s)
        return max(score(s.lower()) for s in (e.stem, *self.other.get(e.stem, ())))

    def _similar(self, word: str, seen: dict) -> Iterator[str]:
        """Words of the dictionary, with affixes that the typed word shows, by shared runs of letters."""
        if not self.o.get("MAXNGRAMSUGS", 4):
            return
        low, known = word.lower(), {s.lower() for s in seen}
        near = [(self._root_score(low, e), i) for i, e in enumerate(self.roots) if abs(len(e.stem) - len(low)) <= 4]
        near = sorted((x for x in near if x[0] > 0), key=lambda x: -x[0])[:MOST_ROOTS]
        masked = ["".join("*" if i >= s and (i - s) % 4 == 0 else c for i, c in enumerate(low)) for s in (1, 2, 3)]
        rough = lambda s: overlap(len(low), low, s, any_mismatch=True) + common_start(low, s)
        least = sum(overlap(len(low), low, m, any_mismatch=True) for m in masked) / 3 - 1
        guesses = []
        for _, i in near:
            e = self.roots[i]
            made = [(s, e.stem) for s in self.other.get(e.stem, ())] + [(f, f) for f in self._shown(e, low)]
            guesses += [(x, s.lower(), real) for s, real in made if (x := rough(s.lower())) > least]
        guesses = sorted(guesses, key=lambda x: -x[0])[:MOST_GUESSES]
        factor = (10 - self.o.get("MAXDIFF", 5)) / 5
        scored = sorted(((self._precise(low, s, base, factor), real) for base, s, real in guesses), key=lambda x: -x[0])
        sure, found = False, 0
        for score, real in scored:
            if sure and score <= 1000:
                return
            if score > 1000:
                sure = True
            elif score < -100:
                if found or self.o.get("ONLYMAXDIFF"):
                    return
                sure = True
            if not any(k in real for k in known):
                found += 1
                yield real

    def _precise(self, a: str, b: str, base: int, factor: float) -> float:
        common = M.lcs_length(a, b)
        if len(a) == len(b) == common:
            return base + 2000
        pairs = sum(overlap(2, x, y, any_mismatch=True, weighted=True) for x, y in ((a, b), (b, a)))
        score = 2 * common - abs(len(a) - len(b)) + common_start(a, b) + any(x == y for x, y in zip(a, b, strict=False))
        score += overlap(4, a, b, any_mismatch=True) + pairs
        return score - 1000 * (pairs < (len(b) if self.sounds else len(a) + len(b)) * factor)

    def _shown(self, e: Entry, word: str) -> list[str]:
        """The stem, and its forms with affixes that the word begins or ends with."""
        s = e.stem
        fits = lambda r, side: r.add and (word.endswith if side == "SFX" else word.startswith)(r.add) and (r.cond is None or r.cond.search(s))
        ends, starts = ([r for f in sorted(e.flags) for r in self.by_flag[side].get(f, ()) if fits(r, side)] for side in ("SFX", "PFX"))
        cut = lambda w, p, r: (p.add if p else "") + w[len(p.strip) if p else 0 : len(w) - (len(r.strip) if r else 0)] + (r.add if r else "")
        made = [s, *(cut(s, None, r) for r in ends), *(cut(s, p, None) for p in starts)]
        made += [cut(s, p, r) for p in starts for r in ends if p.cross and r.cross]
        return list(dict.fromkeys(made))

    def _sounding(self, word: str) -> Iterator[str]:
        """Words that sound alike by the dictionary's table."""
        if self.sounds is None:
            return
        low = word.lower()
        code = self.sounds(low)
        near = [e for e in self.roots if abs(len(e.stem) - len(low)) <= 3 and self._root_score(low, e) > 2]
        best = sorted(((2 * overlap(3, code, self.sounds(e.stem), longer_worse=True), e.stem) for e in near), reverse=True)[:MOST_ROOTS]
        last = lambda s: 2 * M.lcs_length(low, s) - abs(len(low) - len(s)) + common_start(low, s)
        yield from (s for _, s in sorted(((x + last(s.lower()), s) for x, s in best), key=lambda x: -x[0]))

    # -- all forms

    def expand(self, e: Entry) -> list[str]:
        """The stem and every form that its rules make (one level, and prefix with suffix)."""
        fits = lambda r: r.cond is None or r.cond.search(e.stem)
        ends, starts = ([r for f in sorted(e.flags) for r in self.by_flag[side].get(f, ()) if fits(r)] for side in ("SFX", "PFX"))
        cut = lambda p, r: (p.add if p else "") + e.stem[len(p.strip) if p else 0 : len(e.stem) - (len(r.strip) if r else 0)] + (r.add if r else "")
        made = [e.stem, *(cut(None, r) for r in ends), *(cut(p, None) for p in starts)]
        return list(dict.fromkeys([*made, *(cut(p, r) for p in starts for r in ends if p.cross and r.cross)]))
