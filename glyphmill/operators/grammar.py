"""Grammar rules over token arrays. A rule looks at a token and those near it in the same row, so no rule shuffles.

Results are rows ``doc_id, rule_id, pos, context, suggestion, message``.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import tokens as T


@dataclass(frozen=True)
class Rule:
    """One rule: which matcher, with which parameters."""

    id: str
    kind: str
    message: str
    suggestion: str = ""
    category: str = "grammar"
    severity: str = "error"
    params: dict = field(default_factory=dict)


VOWELS = ("a", "e", "i", "o", "u")
#: Words that begin with a vowel letter but a consonant sound, and the other way round. Fixed values.
CONSONANT_SOUND = ("one", "once", "unicorn", "university", "european")
VOWEL_SOUND = ("hour", "heir", "honest", "herb")
NEGATIVES = ("not", "no", "neither", "nobody", "never", "nothing", "nowhere", "hardly", "barely", "scarcely")
#: Words after "there" that keep it, and nouns that ask for "their". Fixed values.
LOCATION_VERBS = tuple("is was are be been being goes went seems appears looks remains existed stood lay came arrived".split())
POSSESSED = tuple((
    "social standing parents example birth own home house family life work job business money time way place spot location position "
    "hands feet eyes ears head face mind heart soul spirit thoughts feelings emotions beliefs opinions views names titles status role "
    "rank efforts actions deeds behavior problems troubles difficulties issues goals dreams hopes wishes desires children friends "
    "colleagues teachers students leaders members country nation world society culture history past future present moment side part "
    "portion share piece bit value worth importance significance use benefit purpose reason cause story tale account report review idea "
    "concept notion theory approach method strategy plan scheme attitude manner style nature character personality qualities skills "
    "abilities talents gifts strengths habits customs practices traditions achievements successes failures mistakes experiences "
    "adventures journeys travels background origins roots sources beginnings development growth progress changes evolution perspective "
    "view outlook stance mindset thinking feeling belief relationship connection bond tie link influence impact effect power authority "
    "control command charge leadership responsibility duty obligation task care attention concern interest focus love affection passion "
    "devotion respect admiration appreciation knowledge understanding wisdom insight ability capability capacity potential condition "
    "state situation quality characteristic feature trait problem issue challenge difficulty solution answer remedy fix result outcome "
    "consequence sign signal indicator mark evidence proof indication"
).split())
#: Wrong phrase, right phrase. Fixed values.
PHRASES = {
    "EN_COULD_OF": ("could of", "could have"),
    "EN_SHOULD_OF": ("should of", "should have"),
    "EN_WOULD_OF": ("would of", "would have"),
    "EN_MUST_OF": ("must of", "must have"),
    "EN_MIGHT_OF": ("might of", "might have"),
    "EN_IN_REGARDS_TO": ("in regards to", "in regard to"),
    "EN_ASK_FOR_ADVICE": ("an advise", "some advice"),
    "EN_SUPPOSE_TO": ("suppose to", "supposed to"),
    "EN_USE_TO": ("use to", "used to"),
    "EN_MORE_THEN": ("more then", "more than"),
    "EN_LESS_THEN": ("less then", "less than"),
    "EN_RATHER_THEN": ("rather then", "rather than"),
    "EN_OTHER_THEN": ("other then", "other than"),
    "EN_COULD_CARE_LESS": ("could care less", "couldn't care less"),
    "EN_FOR_FREE": ("for free", "free"),
    "EN_ALOT": ("alot", "a lot"),
    "EN_TO_MUCH": ("to much", "too much"),
    "EN_TO_MANY": ("to many", "too many"),
    "EN_AS_FOLLOW": ("as follow", "as follows"),
    "EN_BETWEEN_YOU_AND_I": ("between you and i", "between you and me"),
    "EN_A_PART": ("apart of", "a part of"),
    "EN_IN_SPITE": ("inspite", "in spite"),
    "EN_ALRIGHT": ("alright", "all right"),
}
#: Possessive, contraction, tags and words after it that ask for the contraction. Fixed values.
CONTRACTIONS = {
    "EN_ITS_IT_S": ("its", "it's", ("ADJ", "ADV"), "been going getting becoming appearing seeming looking feeling sounding tasting smelling"),
    "EN_YOUR_YOURE": ("your", "you're", ("ADJ", "ADV"), "going getting becoming coming leaving arriving doing making saying thinking feeling looking sounding"),
    "EN_WHOSE_WHOS": ("whose", "who's", ("VERB",), "coming going here there talking speaking calling looking watching working doing making been got"),
}
PROPER = (
    "Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April June July August September October November "
    "December English Spanish French German Italian Russian Chinese Japanese Korean Arabic Hebrew Hindi Portuguese Dutch Swedish Polish "
    "Turkish Greek Latin"
).split()

ENGLISH = (
    Rule("EN_A_VS_AN", "vowel", 'Use "{expected}" before "{word}"', category="articles", severity="suggestion"),
    Rule("EN_THERE_THEIR", "there", 'Did you mean "their"?', "their", "confusion", "warning"),
    Rule("EN_DOUBLE_NEGATIVE", "negative", "Double negative detected - consider rephrasing", "Consider using a single negative", "style", "style",
         {"distance": 15, "exceptions": ("not only but also", "not...without")}),
    *(Rule(k, "phrase", f'"{a}" should be "{b}"', b, params={"phrase": a}) for k, (a, b) in PHRASES.items()),
    *(Rule(k, "contraction", f'Did you mean "{b}"?', b, "confusion", "warning", {"target": a, "tags": tags, "words": tuple(w.split())})
      for k, (a, b, tags, w) in CONTRACTIONS.items()),
    Rule("EN_SENTENCE_START_CAP", "sentence", "Sentences should start with a capital letter", category="capitalization"),
    Rule("EN_PROPER_NOUN_CAP", "words", "Proper nouns should be capitalized", category="capitalization", params={"words": {w.lower(): w for w in PROPER}}),
)


def _tok(i: Column) -> Column:
    return F.get(F.col("toks"), i)


def _low(i: Column) -> Column:
    return F.lower(_tok(i))


def _tag(i: Column) -> Column:
    return F.get(F.col("tags"), i)


def _places() -> Column:
    n = F.size("toks")
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _hits(rows: DataFrame, rule: Rule, when, context, suggestion, message=None) -> DataFrame:
    """Rows for the places i where ``when(i)`` holds."""
    found = rows.withColumn("i", F.explode(F.filter(_places(), when)))
    i = F.col("i")
    return found.select(
        "doc_id", F.lit(rule.id).alias("rule_id"), T.offset(i).cast("bigint").alias("pos"), context(i).alias("context"),
        suggestion(i).alias("suggestion"), (message(i) if message else F.lit(rule.message)).alias("message"),
    )


def expected_article(word: Column) -> Column:
    low = F.lower(word)
    return (
        F.when(low.isin(*CONSONANT_SOUND), "a").when(low.isin(*VOWEL_SOUND), "an").when(F.substring(low, 1, 1).isin(*VOWELS), "an").otherwise("a")
    )


def vowel(rows: DataFrame, rule: Rule) -> DataFrame:
    """a or an against the sound of the next word; the article may be tagged DET or not at all."""
    pair = lambda i: F.concat_ws(" ", _tok(i), _tok(i + 1))
    right = lambda i: expected_article(_tok(i + 1))
    text = lambda i: F.concat(F.lit('Use "'), right(i), F.lit('" before "'), _tok(i + 1), F.lit('"'))
    when = lambda i: _low(i).isin("a", "an") & _tok(i + 1).isNotNull() & (_tag(i).isNull() | (_tag(i) == "DET")) & (_low(i) != right(i))
    return _hits(rows, rule, when, pair, right, text)


def _quoted(i: Column) -> Column:
    return F.concat(F.lit('"'), _tok(i), F.lit(" "), _tok(i + 1), F.lit('"'))


def there(rows: DataFrame, rule: Rule) -> DataFrame:
    """there before a noun or adjective, by tag or by the list of nouns, unless a verb of place follows."""
    noun = lambda i: _tag(i + 1).isin("NOUN", "NOUN_PROPER", "ADJ") | _low(i + 1).isin(*POSSESSED)
    when = lambda i: (_low(i) == "there") & _tok(i + 1).isNotNull() & ~_low(i + 1).isin(*LOCATION_VERBS) & F.coalesce(noun(i), F.lit(False))
    return _hits(rows, rule, when, _quoted, lambda i: F.lit(rule.suggestion))


def contraction(rows: DataFrame, rule: Rule) -> DataFrame:
    p = rule.params
    follows = lambda i: F.coalesce(_tag(i + 1).isin(*p["tags"]), F.lit(False)) | F.coalesce(_low(i + 1).isin(*p["words"]), F.lit(False))
    return _hits(rows, rule, lambda i: (_low(i) == p["target"]) & follows(i), _quoted, lambda i: F.lit(rule.suggestion))


def _phrase_at(i: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.coalesce(_low(i + k) == w, F.lit(False)) for k, w in enumerate(words)])


def phrases(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """All phrase rules in one pass: places where a phrase may begin, then the phrases that do."""
    split = [(r, r.params["phrase"].split()) for r in rules]
    starts = sorted({w[0] for _, w in split})
    some = rows.withColumn("i", F.explode(F.filter(_places(), lambda i: _low(i).isin(*starts))))
    i = F.col("i")
    found = [
        F.when(
            _phrase_at(i, w),
            F.struct(F.lit(r.id).alias("rule_id"), F.array_join(F.slice("toks", i + 1, len(w)), " ").alias("context"), F.lit(r.suggestion).alias("suggestion"), F.lit(r.message).alias("message")),
        )
        for r, w in split
    ]
    hit = some.withColumn("r", F.explode(F.array_compact(F.array(*found))))
    return hit.select("doc_id", "r.rule_id", T.offset(i).cast("bigint").alias("pos"), "r.context", "r.suggestion", "r.message")


def words(rows: DataFrame, rule: Rule) -> DataFrame:
    fixed = F.create_map(*[F.lit(x) for kv in rule.params["words"].items() for x in kv])
    right = lambda i: F.try_element_at(fixed, _low(i))
    when = lambda i: F.coalesce(right(i) != _tok(i), F.lit(False))
    return _hits(rows, rule, when, lambda i: F.concat(F.lit('"'), _tok(i), F.lit('"')), right)


def sentence(rows: DataFrame, rule: Rule) -> DataFrame:
    """A lower-case word at the start or right after a token that ends in . ! or ?"""
    starts = lambda i: (i == 0) | F.substring(_tok(i - 1), -1, 1).isin(".", "!", "?")
    first = lambda i: F.substring(_tok(i), 1, 1)
    lower = lambda i: (first(i) == F.lower(first(i))) & (first(i) != F.upper(first(i))) & first(i).rlike(r"^\p{L}$")
    capital = lambda i: F.when(first(i).rlike("^[A-Za-z0-9_]"), F.concat(F.upper(first(i)), F.substring(_tok(i), F.lit(2), F.length(_tok(i))))).otherwise(_tok(i))
    return _hits(rows, rule, lambda i: starts(i) & lower(i), lambda i: F.concat(F.lit('"'), _tok(i), F.lit('"')), capital)


def is_negative(word: Column) -> Column:
    return word.isin(*NEGATIVES) | word.endswith("n't")


def _regions(toks: list[str], text: str) -> list[tuple[int, int]]:
    """Ranges of token places that an excepted phrase covers, up to its far end for "head...tail"."""
    head, dots, tail = text.partition("...")
    first, last = head.split(), tail.split()
    at = lambda i, words: toks[i : i + len(words)] == words
    out = []
    for i in range(len(toks)):
        if at(i, first):
            if not dots:
                out.append((i, i + len(first)))
            elif (close := next((j for j in range(i + len(first), len(toks)) if at(j, last)), None)) is not None:
                out.append((i, close + len(last)))
    return out


def negative(rows: DataFrame, rule: Rule) -> DataFrame:
    """Two negatives in a row, no further apart than the distance in characters, outside the excepted phrases.

    Texts with fewer than two negatives never leave the JVM; the others are walked once each.
    """
    some = rows.where(F.size(F.filter("toks", lambda w: is_negative(F.lower(w)))) >= 2)
    most, exceptions = rule.params["distance"], rule.params["exceptions"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, toks, gaps in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                low = [t.lower() for t in toks]
                places, pos = [], 0
                for t, g in zip(toks, gaps, strict=False):
                    places.append(pos + len(g))
                    pos += len(g) + len(t)
                regions = [r for text in exceptions for r in _regions(low, text)]
                found = [i for i, w in enumerate(low) if w in NEGATIVES or w.endswith("n't")]
                found = [i for i in found if not any(a <= i < b for a, b in regions)]
                out += [(doc, places[i], " ".join(toks[i : j + 1])) for i, j in zip(found, found[1:], strict=False) if places[j] - places[i] <= most]
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.string())], ["doc_id", "pos", "context"]
            )

    hits = some.select("doc_id", "toks", "gaps").mapInArrow(run, "doc_id bigint, pos bigint, context string")
    return hits.select("doc_id", F.lit(rule.id).alias("rule_id"), "pos", "context", F.lit(rule.suggestion).alias("suggestion"), F.lit(rule.message).alias("message"))


MATCHERS = {
    "vowel": vowel, "there": there, "contraction": contraction, "words": words, "sentence": sentence, "negative": negative,
}


class _Marks(dict):
    """Of each distinct token, once: the matchers of rules that may begin there, whether a sentence may begin after it
    and whether it is a negative; None for most tokens. A matcher gives, of all tokens and a place, the context,
    suggestion and message, or None."""

    MOST = 1_000_000

    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.split = {r.id: r.params["phrase"].split() for r in rules if r.kind == "phrase"}
        self.heads: dict[str, list[Rule]] = {}
        for r in rules:
            p = r.params
            first = {"vowel": ("a", "an"), "there": ("there",), "contraction": (p.get("target"),), "words": p.get("words", ()), "phrase": self.split.get(r.id, [])[:1]}
            for low in first.get(r.kind, ()):
                self.heads.setdefault(low, []).append(r)

    def __missing__(self, tok: str) -> tuple | None:
        if len(self) >= self.MOST:
            self.clear()
        low = tok.lower()
        begun = tuple((r.id, self._matcher(r, low)) for r in self.heads.get(low, ()))
        stop, negates = tok[-1:] in (".", "!", "?"), low in NEGATIVES or low.endswith("n't")
        self[tok] = out = (begun, stop, negates) if begun or stop or negates else None
        return out

    def _matcher(self, r: Rule, low: str):
        p = r.params
        if r.kind == "vowel":
            return lambda t, i: _article(t[i], t[i + 1]) if i + 1 < len(t) else None
        if r.kind == "there":
            return lambda t, i: (_pair(t, i), r.suggestion, r.message) if i + 1 < len(t) and (w := t[i + 1].lower()) in POSSESSED and w not in LOCATION_VERBS else None
        if r.kind == "contraction":
            return lambda t, i: (_pair(t, i), r.suggestion, r.message) if i + 1 < len(t) and t[i + 1].lower() in p["words"] else None
        if r.kind == "phrase":
            words, n = self.split[r.id], len(self.split[r.id])
            return lambda t, i: (" ".join(t[i : i + n]), r.suggestion, r.message) if [x.lower() for x in t[i : i + n]] == words else None
        return lambda t, i: (f'"{t[i]}"', p["words"][low], r.message) if p["words"][low] != t[i] else None


def _pair(toks: list[str], i: int) -> str:
    return f'"{toks[i]} {toks[i + 1]}"'


def _article(tok: str, word: str) -> tuple[str, str, str] | None:
    low = word.lower()
    right = "a" if low in CONSONANT_SOUND else "an" if low in VOWEL_SOUND or low[:1] in VOWELS else "a"
    return (f"{tok} {word}", right, f'Use "{right}" before "{word}"') if tok.lower() != right else None


def _capital(tok: str) -> str | None:
    """The token as a sentence should begin, where it begins with a small letter."""
    c = tok[0]
    if c != c.lower() or c == c.upper() or not unicodedata.category(c).startswith("L"):
        return None
    return c.upper() + tok[1:] if c.isascii() else tok


def _negatives(toks: list[str], at: list[re.Match], found: list[int], rule: Rule) -> Iterator[tuple[int, str]]:
    low = [t.lower() for t in toks]
    regions = [r for text in rule.params["exceptions"] if text.partition("...")[0].split()[0] in low for r in _regions(low, text)]
    found = [i for i in found if not any(a <= i < b for a, b in regions)]
    for i, j in zip(found, found[1:], strict=False):
        if at[j].start() - at[i].start() <= rule.params["distance"]:
            yield i, " ".join(toks[i : j + 1])


def walked(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """All rules over texts without tags, in one pass: each text is cut into tokens once, and only tokens that some rule
    begins with are looked at."""
    find = re.compile(T.WHITESPACE, re.ASCII)
    sentences, doubles = [r for r in rules if r.kind == "sentence"], [r for r in rules if r.kind == "negative"]

    def hits(text: str, marks: _Marks) -> Iterator[tuple]:
        at = list(find.finditer(text))
        toks = [m[0] for m in at]
        negated, begins = [], 0 if toks else None
        for i, mark in enumerate(map(marks.__getitem__, toks)):
            if begins == i and (good := _capital(toks[i])):
                for r in sentences:
                    yield r.id, at[i].start(), f'"{toks[i]}"', good, r.message
            if mark is None:
                continue
            for name, match in mark[0]:
                if found := match(toks, i):
                    yield name, at[i].start(), *found
            if mark[1]:
                begins = i + 1
            if mark[2]:
                negated.append(i)
        if len(negated) > 1:
            for r in doubles:
                for i, context in _negatives(toks, at, negated, r):
                    yield r.id, at[i].start(), context, r.suggestion, r.message

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = _Marks(rules)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                rows = [(n, *hit) for n, text in enumerate(part.column(1).to_pylist()) for hit in hits(text or "", marks)]
                where, name, pos, *texts = zip(*rows, strict=True) if rows else ((),) * 6
                columns = [part.column(0).take(pa.array(where, pa.int64())), pa.array(name, pa.string()), pa.array(pos, pa.int64()), *(pa.array(x, pa.string()) for x in texts)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "rule_id", "pos", "context", "suggestion", "message"])

    key = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, rule_id string, pos bigint, context string, suggestion string, message string")


def prepare(docs: DataFrame, tags: Column | None = None) -> DataFrame:
    """``doc_id, toks, gaps, tags`` from texts; tags, an array beside the tokens, where a tagger gave some."""
    rows = T.with_arrays(docs)
    tagged = tags if tags is not None else F.array().cast("array<string>")
    return rows.select("doc_id", "toks", "gaps", tagged.alias("tags"))


def check(docs: DataFrame, rules: tuple[Rule, ...] = ENGLISH, tags: Column | None = None) -> DataFrame:
    """All rules over all documents; without tags in one pass."""
    if tags is None and all(r.kind in MATCHERS or r.kind == "phrase" for r in rules):
        return walked(docs, rules)
    rows = prepare(docs, tags)
    parts = [MATCHERS[r.kind](rows, r) for r in rules if r.kind != "phrase"]
    if fixed := [r for r in rules if r.kind == "phrase"]:
        parts.append(phrases(rows, fixed))
    return reduce(DataFrame.unionByName, parts)


# --- other languages --------------------------------------------------------------------------------------------------

_ARTICLES_DE = ("der", "die", "das", "den", "dem", "des", "ein", "eine", "einen", "einem", "einer", "eines")
_SUFFIXES_DE = ("ung", "heit", "keit", "schaft", "tion", "tät", "ismus", "chen", "lein")


def german_nouns(docs: DataFrame) -> DataFrame:
    """Words with a noun's ending, or after an article, that begin with a small letter."""
    rule = Rule("DE_NOUN_CAP", "de", "Nouns are capitalised")
    pattern = r"[A-Za-zÄÖÜäöüß]+|[^\sA-Za-zÄÖÜäöüß]"
    rows = T.with_arrays(docs, pattern=pattern).select("doc_id", "toks", "gaps", F.array().cast("array<string>").alias("tags"))
    first = lambda i: F.substring(_tok(i), 1, 1)
    small = lambda i: _tok(i).rlike("^[a-zäöüß]")
    noun = lambda i: _tok(i).rlike("(" + "|".join(_SUFFIXES_DE) + ")$") | F.coalesce(_low(i - 1).isin(*_ARTICLES_DE) & (i > 0) & (F.length(_tok(i)) > 3), F.lit(False))
    right = lambda i: F.concat(F.upper(first(i)), F.substring(_tok(i), F.lit(2), F.length(_tok(i))))
    return _hits(rows, rule, lambda i: small(i) & (F.length(_tok(i)) > 3) & noun(i), _tok, right)


def french_negation(docs: DataFrame) -> DataFrame:
    """ne without pas, plus, jamais, rien, personne, aucun or que in the next four tokens."""
    rule = Rule("FR_NEGATION", "fr", "Negation lacks its second part", "pas")
    rows = T.with_arrays(docs, pattern=r"[\p{L}]+['’]?|[^\s\p{L}]").select("doc_id", "toks", "gaps", F.array().cast("array<string>").alias("tags"))
    second = ("pas", "plus", "jamais", "rien", "personne", "aucun", "aucune", "guère", "point", "que")
    opens = lambda i: _low(i).isin("ne", "n'", "n’")
    closed = lambda i: reduce(lambda a, b: a | b, [F.coalesce(_low(i + k).isin(*second), F.lit(False)) for k in range(1, 5)])
    return _hits(rows, rule, lambda i: opens(i) & ~closed(i), _tok, lambda i: F.lit(rule.suggestion))


def spanish_marks(docs: DataFrame) -> DataFrame:
    """A closing ? or ! without its opening mark since the last sentence end."""
    rule = Rule("ES_INVERTED", "es", "Opening mark is missing")
    rows = T.with_arrays(docs, pattern=r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]").select("doc_id", "toks", "gaps", F.array().cast("array<string>").alias("tags"))

    def when(i: Column) -> Column:
        mark = _tok(i)
        before = F.reverse(F.slice("toks", F.lit(1), i))
        stop = F.array_min(F.transform(F.array(F.lit("."), F.lit("?"), F.lit("!")), lambda m: F.nullif(F.array_position(before, m), F.lit(0))))
        since = F.slice(before, F.lit(1), F.coalesce(stop, F.size(before) + 1).cast("int") - 1)
        return mark.isin("?", "!") & ~F.array_contains(since, F.when(mark == "?", F.lit("¿")).otherwise(F.lit("¡")))

    return _hits(rows, rule, when, _tok, lambda i: F.when(_tok(i) == "?", "¿").otherwise("¡"))


def portuguese_crase(docs: DataFrame) -> DataFrame:
    """a before a feminine article where the two melt."""
    rule = Rule("PT_CRASE", "pt", "Use the contracted form", "à")
    rows = T.with_arrays(docs, pattern=r"[\p{L}]+|[^\s\p{L}]").select("doc_id", "toks", "gaps", F.array().cast("array<string>").alias("tags"))
    return _hits(rows, rule, lambda i: (_low(i) == "a") & F.coalesce(_low(i + 1).isin("a", "as"), F.lit(False)), _quoted, lambda i: F.when(_low(i + 1) == "as", "às").otherwise("à"))


def japanese_mixing(docs: DataFrame) -> DataFrame:
    """Texts that mix Latin letters with kana and kanji in one word."""
    return docs.where(F.col("text").rlike("[A-Za-z][\\x{3041}-\\x{30FF}]|[\\x{3041}-\\x{30FF}][A-Za-z]")).select("doc_id", F.lit("JA_SCRIPT_MIX").alias("rule_id"))
