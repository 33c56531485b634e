"""Documents of several formats as plain text: a registry of parsers, each a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def plain(source: Column) -> Column:
    return F.coalesce(source, F.lit(""))


def html(source: Column) -> Column:
    """What a reader sees: scripts, styles, comments and tags go, the common entities are resolved, blocks end lines."""
    text = F.regexp_replace(plain(source), r"(?is)<(script|style|head|noscript)\b.*?</\1\s*>", " ")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?i)</?(p|div|br|li|tr|h[1-6]|section|article|ul|ol|table|blockquote)\b[^>]*>", "\n")
    text = F.regexp_replace(text, r"<[^>]*>", " ")
    for name, char in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("apos", "'"), ("amp", "&")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    text = F.regexp_replace(text, r"[^\S\n]+", " ")
    return F.regexp_replace(F.regexp_replace(text, r" *\n\s*", "\n"), r"^\s+|\s+$", "")


def markdown(source: Column) -> Column:
    """Without code, links' addresses and marks."""
    text = F.regexp_replace(plain(source), r"(?s)```.*?```", " ")
    text = F.regexp_replace(text, r"`[^`]*`", " ")
    text = F.regexp_replace(text, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    return F.regexp_replace(text, r"(?m)^\s{0,3}(#{1,6}|[-*+]|\d+\.|>)\s+|[*_~]{1,3}", "")


PARSERS: dict[str, Callable[[Column], Column]] = {"plain": plain, "html": html, "markdown": markdown}


def register(name: str, parser: Callable[[Column], Column]) -> None:
    """A format's parser; the last one registered counts."""
    PARSERS[name] = parser


def parse(source: Column, name: str) -> Column:
    """By the format's parser, or as plain text if the format has none."""
    return PARSERS.get(name, plain)(source)


def text_nodes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, node, offset, text``: the lines of a text that aren't blank, with their offsets in it."""
    lines = F.split(plain(F.col(text_col)), "\n", -1)
    rows = df.select(id_col, F.posexplode(lines).alias("node", "text"), lines.alias("all"))
    from pyspark.sql.window import Window

    before = Window.partitionBy(id_col).orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0))
    return rows.drop("all").withColumn("offset", offset.cast("bigint")).where(F.trim("text") != "").select(id_col, F.col("node").cast("bigint").alias("node"), "offset", "text")


def node_at(places: DataFrame, nodes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id, at, node``: the node that holds each offset ``at`` of a text, and null between nodes. Both tables meet on
    the text only, as events of one order, so the cost is their sum."""
    from pyspark.sql.window import Window

    begin = nodes.select(id_col, F.col("offset").alias("at"), F.col("node").alias("n"), (F.col("offset") + F.length("text")).alias("stop"), F.lit(0).alias("kind"))
    asked = places.select(id_col, F.col("at").cast("bigint").alias("at"), F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("stop"), F.lit(1).alias("kind"))
    order = Window.partitionBy(id_col).orderBy("at", "kind")
    last = F.last(F.when(F.col("kind") == 0, F.struct("n", "stop")), ignorenulls=True).over(order)
    both = begin.unionByName(asked).withColumn("held", last).where("kind = 1")
    return both.select(id_col, "at", F.when(F.col("at") < F.col("held.stop"), F.col("held.n")).alias("node"))
