"""Lines of text files and archives, and the word lists, tiers, rules and settings that are read from them.

Files are read by Spark (any store it reads), one row for each file, and decoded in Python, as encodings differ from line
to line. Such files are resources of megabytes; corpora are Parquet tables.
"""

from __future__ import annotations

import codecs
import io
import json
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINES = "path string, line_no int, value string"
BOM = b"\xef\xbb\xbf"


def encoding_name(name: str) -> str:
    """A known name of the encoding; Microsoft code pages may be called ``microsoft-cp1251``."""
    name = name.strip().lower().removeprefix("microsoft-")
    try:
        return codecs.lookup(name).name
    except LookupError:
        return "iso8859-1"


def detect_encoding(content: bytes) -> str:
    """What a line ``SET`` says, else UTF-8 if all bytes are valid, else Latin-1."""
    for line in content.removeprefix(BOM).splitlines():
        if line.startswith(b"SET "):
            return encoding_name(line[4:].decode("ascii", "replace"))
    try:
        content.decode()
        return "utf-8"
    except UnicodeDecodeError:
        return "iso8859-1"


def decode(content: bytes, encoding: str = "utf-8") -> list[tuple[int, str]]:
    """``line_no, line`` of the lines that aren't blank, stripped; a line that does not decode is read as Latin-1."""
    out = []
    for number, raw in enumerate(content.removeprefix(BOM).split(b"\n"), 1):
        try:
            line = raw.decode(encoding)
        except (UnicodeDecodeError, LookupError):
            line = raw.decode("iso8859-1")
        if line := line.strip():
            out.append((number, line))
    return out


def _line_rows(files: DataFrame, encoding: str | None, entry: str | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if entry is not None:
                    content = zip_entry(content, entry)
                rows = decode(content, encoding or detect_encoding(content))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(rows), pa.string()), pa.array([n for n, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.string())],
                    ["path", "line_no", "value"],
                )

    return files.select("path", "content").mapInArrow(run, LINES)


def zip_entry(content: bytes, name: str) -> bytes:
    """One entry of an archive, by its name; an error if it isn't there."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if name not in z.namelist():
            raise FileNotFoundError(f"{name} is not in the archive")
        return z.read(name)


def read_lines(spark: SparkSession, path: str, encoding: str | None = None, pattern: str = "*") -> DataFrame:
    """``path, line_no, value`` of a file or of a folder's files; without an encoding it is found for each file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return _line_rows(files, encoding, None)


def read_zip_lines(spark: SparkSession, path: str, entry: str, encoding: str | None = None) -> DataFrame:
    """The lines of one entry of each archive."""
    return _line_rows(spark.read.format("binaryFile").load(path), encoding, entry)


def lines_of(spark: SparkSession, text: str) -> DataFrame:
    """``line_no, value`` of a text in memory."""
    return spark.createDataFrame(decode(text.encode()), "line_no int, value string")


def read_documents(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """``path, text``: a file, or the files of a folder, one text each."""
    return spark.read.option("wholetext", True).option("pathGlobFilter", pattern).text(path).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


# --- word lists -------------------------------------------------------------------------------------------------------


def word_list(lines: DataFrame, pattern: str | None = None, case_sensitive: bool = False, strip: bool = True) -> DataFrame:
    """``word`` of each line that is neither blank nor a ``#`` comment; folded unless case counts. Unix lists are read
    with ``strip=False``; a pattern leaves out what does not match it as a whole."""
    value = F.trim("value") if strip else F.col("value")
    words = lines.where((F.trim("value") != "") & ~F.trim("value").startswith("#")).select(value.alias("word"))
    if pattern:
        words = words.where(F.col("word").rlike(f"^(?:{pattern})$"))
    return words if case_sensitive else words.select(F.lower("word").alias("word"))


def custom_words(spark: SparkSession, words: list[str], case_sensitive: bool = False) -> DataFrame:
    """A list in memory: stripped, empty ones dropped, folded."""
    kept = [w.strip() if case_sensitive else w.strip().lower() for w in words if w.strip()]
    return spark.createDataFrame([(w,) for w in kept], "word string")


def code_word_list(lines: DataFrame) -> DataFrame:
    """Distinct words of a list for code checkers (a compiled trie is read as text too); the table is read-only."""
    return word_list(lines).distinct()


def first_that_exists(spark: SparkSession, paths: list[str]) -> str | None:
    """The first path that is there, in any store Spark reads."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(conf).exists(p):
            return path
    return None


#: Where systems keep word lists. Fixed values.
SYSTEM_LISTS = ("/usr/share/dict/words", "/usr/dict/words", "/usr/share/dict/web2", "/usr/share/dict/american-english", "/usr/share/dict/british-english")


def system_words(spark: SparkSession, paths: tuple[str, ...] = SYSTEM_LISTS) -> DataFrame:
    """The system's own list; an error where there is none."""
    found = first_that_exists(spark, [p if ":" in p else f"file://{p}" for p in paths])
    if found is None:
        raise FileNotFoundError("no system word list")
    return word_list(read_lines(spark, found), strip=False)


# --- tiers, vocabularies, rules ---------------------------------------------------------------------------------------

#: Bonus of each tier. Fixed values.
TIER_BONUS = {"top_50": 200, "top_200": 100, "top_1000": 50}


def _one_text(spark: SparkSession, path: str) -> str:
    if first_that_exists(spark, [path]) is None:
        return ""
    return "\n".join(r["value"] for r in spark.read.option("wholetext", True).text(path).collect())


def load(text: str, kind: str) -> dict:
    """JSON or YAML settings (YAML needs its package); empty for an empty text."""
    if not text.strip():
        return {}
    if kind == "json":
        return json.loads(text)
    import yaml

    return yaml.safe_load(text) or {}


def tiers_of(spark: SparkSession, data: dict, lang: str) -> DataFrame:
    """``lang, word, bonus`` of ``tiers``: lists of words, or of objects that have ``words``. A word in several tiers has
    the highest bonus."""
    rows = {}
    for tier, bonus in sorted(TIER_BONUS.items(), key=lambda x: x[1]):
        held = (data.get("tiers") or {}).get(tier) or []
        for w in held.get("words", []) if isinstance(held, dict) else held:
            rows[str(w)] = bonus
    return spark.createDataFrame([(lang, w, b) for w, b in rows.items()], "lang string, word string, bonus int")


def read_tiers(spark: SparkSession, path: str, lang: str) -> DataFrame:
    """Tiers from a YAML or JSON file; none if the file isn't there."""
    return tiers_of(spark, load(_one_text(spark, path), "json" if path.endswith(".json") else "yaml"), lang)


def first_tiers(*tables: DataFrame) -> DataFrame:
    """For each language the first of the tables that has words for it: cached, then bundled, then none."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t.join(out.select("lang").distinct(), "lang", "left_anti"))
    return out


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """``word, idx`` from JSON: an object of indices or an array of words."""
    data = json.loads(_one_text(spark, path) or "[]")
    rows = list(data.items()) if isinstance(data, dict) else [(w, i) for i, w in enumerate(data)]
    return spark.createDataFrame([(w, int(i)) for w, i in rows], "word string, idx int")


def vocabulary_json(words: DataFrame, as_array: bool = False) -> DataFrame:
    """``json``: one row, the vocabulary ``word, idx`` (a table that fits one value) as an object or an array."""
    order = F.sort_array(F.collect_list(F.struct("idx", "word")))
    entries = words.agg(order.alias("all"))
    if as_array:
        return entries.select(F.to_json(F.transform("all", lambda x: x["word"])).alias("json"))
    return entries.select(F.to_json(F.map_from_entries(F.transform("all", lambda x: F.struct(x["word"], x["idx"])))).alias("json"))


def read_rules(spark: SparkSession, paths: list[str]) -> list:
    """Grammar rules from the first file that is there (explicit, then from settings, then bundled); none otherwise.

    A file has ``rules``: a list of ``id, kind, message, suggestion, category, severity, params`` in YAML or JSON.
    """
    from glyphmill.operators.grammar import Rule

    path = first_that_exists(spark, [p for p in paths if p])
    data = load(_one_text(spark, path), "json" if path.endswith(".json") else "yaml") if path else {}
    names = ("id", "kind", "message", "suggestion", "category", "severity", "params")
    return [Rule(**{k: r[k] for k in names if r.get(k) is not None}) for r in data.get("rules") or []]


# --- personal and project settings ------------------------------------------------------------------------------------


def personal_add(words: DataFrame, more: DataFrame) -> DataFrame:
    return words.unionByName(more).where("word <> ''").distinct()


def personal_remove(words: DataFrame, gone: DataFrame) -> DataFrame:
    return words.join(gone, "word", "left_anti")


def personal_save(words: DataFrame, path: str) -> None:
    """One file, sorted, each word once: a personal dictionary is what one person typed."""
    words.where("word <> ''").distinct().orderBy("word").coalesce(1).write.mode("overwrite").text(path)


def project_settings(spark: SparkSession, folder: str, name: str) -> dict:
    """Settings of the nearest folder, from this one upwards, that has the file; ``words`` and ``patterns`` to ignore."""
    parts = folder.rstrip("/").split("/")
    paths = ["/".join(parts[:i]) + f"/{name}" for i in range(len(parts), 0, -1)]
    path = first_that_exists(spark, [p for p in paths if p.count("/") or p])
    data = load(_one_text(spark, path), "json" if path.endswith(".json") else "yaml") if path else {}
    return {"words": data.get("ignore_words") or [], "patterns": data.get("ignore_patterns") or []}


def not_ignored(errors: DataFrame, words: DataFrame, patterns: list[str] = ()) -> DataFrame:
    """Errors ``word, ...`` without those that a list (matched with case folded) or a pattern ignores."""
    low = words.select(F.lower("word").alias("low")).distinct()
    kept = errors.withColumn("low", F.lower("word")).join(low, "low", "left_anti").drop("low")
    for p in patterns:
        kept = kept.where(~F.col("word").rlike(p))
    return kept.select(*errors.columns)


def confusion_sets(lines: DataFrame) -> DataFrame:
    """``word, other, factor, both``: lines ``a; b; factor`` hold both ways, ``a -> b; factor`` one way; ``#`` comments."""
    value = F.trim(F.regexp_extract("value", "^([^#]*)", 1))
    two = F.split(F.regexp_replace(value, r"\s*->\s*", ";"), r"\s*;\s*")
    rows = lines.select(value.alias("v"), two.alias("p")).where((F.col("v") != "") & (F.size("p") >= 3))
    return rows.select(
        F.col("p")[0].alias("word"), F.col("p")[1].alias("other"), F.expr("try_cast(p[2] AS double)").alias("factor"), (~F.contains("v", F.lit("->"))).alias("both")
    )
