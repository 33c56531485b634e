"""Catalogues of dictionaries, languages and their resources, as tables, and small registries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CATALOG = "code string, name string, language string, region string, format string, license string, word_count bigint"


def find(catalog: DataFrame, **wanted: str) -> DataFrame:
    """Entries whose columns have these values, with case folded: ``language``, ``format``, ``code``, ..."""
    for column, value in wanted.items():
        catalog = catalog.where(F.lower(column) == value.lower())
    return catalog


def by_license(catalog: DataFrame, part: str) -> DataFrame:
    return catalog.where(F.contains(F.lower("license"), F.lit(part.lower())))


def statistics(catalog: DataFrame) -> DataFrame:
    """``what, value, n, words``: entries and words by format, by the first word of the license, by language, and in all."""
    each = catalog.select(
        F.explode(
            F.array(
                *[F.struct(F.lit(k).alias("what"), v.alias("value")) for k, v in (("format", F.col("format")), ("license", F.split("license", " ")[0]), ("language", F.col("language")), ("all", F.lit("")))]
            )
        ).alias("s"),
        "word_count",
    )
    return each.groupBy("s.what", "s.value").agg(F.count(F.lit(1)).alias("n"), F.sum("word_count").alias("words"))


def resolve_code(asked: DataFrame, known: DataFrame, fallback: str = "en") -> DataFrame:
    """``code, found, note``: a code itself, else its base code, else the fallback, and which of these it was."""
    own = known.select(F.col("code").alias("found")).distinct()
    rows = asked.select("code").distinct().withColumn("base", F.split("code", "-")[0])
    rows = rows.join(own.withColumnRenamed("found", "exact"), F.col("code") == F.col("exact"), "left")
    rows = rows.join(own.withColumnRenamed("found", "near"), F.col("base") == F.col("near"), "left")
    note = F.when(F.col("exact").isNotNull(), "exact").when(F.col("near").isNotNull(), "base").otherwise("fallback")
    return rows.select("code", F.coalesce("exact", "near", F.lit(fallback)).alias("found"), note.alias("note"))


class Registry:
    """Named classes or functions: languages, models, vocabularies, services. A name is registered once unless replaced."""

    def __init__(self) -> None:
        self._held: dict[str, object] = {}
        self._made: dict[str, object] = {}
        self._needs: dict[str, tuple[str, ...]] = {}

    def register(self, name: str, value: object, replace: bool = False, needs: tuple[str, ...] = ()) -> None:
        if name in self._held and not replace:
            raise KeyError(f"{name} is registered already")
        self._held[name], self._needs[name] = value, needs
        self._made.pop(name, None)

    def get(self, name: str) -> object:
        """By its name, or by the base of a code such as ``de-AT``."""
        for key in (name, name.split("-")[0]):
            if key in self._held:
                return self._held[key]
        raise KeyError(f"{name} is not registered; known are {', '.join(self.names())}")

    def single(self, name: str, _open: tuple[str, ...] = ()) -> object:
        """The one instance of a registered class, made with the instances that it needs; a circle is an error."""
        if name in _open:
            raise ValueError(f"{' needs '.join((*_open, name))}: a circle")
        if name not in self._made:
            self._made[name] = self._held[name](*(self.single(n, (*_open, name)) for n in self._needs[name]))
        return self._made[name]

    def names(self) -> list[str]:
        return sorted(self._held)

    def missing(self, name: str, methods: tuple[str, ...]) -> list[str]:
        """Which of the methods a registered class lacks."""
        return [m for m in methods if not callable(getattr(self._held[name], m, None))]


def setting(name: str, given: dict, environment: dict, programmatic: dict, defaults: dict, prefix: str = "GLYPHMILL_") -> object:
    """The first of: the command's value, the environment's, the program's, the default."""
    for values, key in ((given, name), (environment, prefix + name.upper()), (programmatic, name), (defaults, name)):
        if values.get(key) is not None:
            return values[key]
    return None
