"""Bloom filters over a column: built by an aggregation, probed by a column expression, united bit by bit."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Shape:
    """Number of bits and of hashes."""

    bits: int
    hashes: int

    @staticmethod
    def of(expected: int, rate: float = 0.01) -> Shape:
        """m = -n ln p / (ln 2)^2 and k = ceil(m / n ln 2)."""
        bits = max(1, math.ceil(-expected * math.log(rate) / math.log(2) ** 2))
        return Shape(bits, max(1, math.ceil(bits / expected * math.log(2))))


def places(item: Column, shape: Shape) -> list[Column]:
    """The bits of an item, case folded: two hashes combined."""
    low = F.lower(item)
    a, b = F.xxhash64(low), F.xxhash64(low, F.lit(1))
    return [F.pmod(F.shiftright(a, 2) + F.lit(i) * F.shiftright(b, 16), F.lit(shape.bits)) for i in range(shape.hashes)]


def build(items: DataFrame, column: str, shape: Shape) -> DataFrame:
    """``word, mask``: the words of 32 bits that have any set. A table, so its size is no concern of one machine."""
    at = items.select(F.explode(F.array(*places(F.col(column), shape))).alias("at"))
    return at.groupBy(F.floor(F.col("at") / 32).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 32 as int))")).alias("mask"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Of two filters of one shape."""
    return a.unionByName(b).groupBy("word").agg(F.bit_or("mask").alias("mask"))


def probe(items: DataFrame, column: str, bloom: DataFrame, shape: Shape) -> DataFrame:
    """``item, maybe``: false means that the filter's items lack it."""
    asked = items.select(F.col(column).alias("item")).distinct()
    at = asked.select("item", F.explode(F.array(*places(F.col("item"), shape))).alias("at")).withColumn("word", F.floor(F.col("at") / 32))
    hit = at.join(bloom, "word", "left").withColumn("hit", F.expr("coalesce(mask & shiftleft(1L, cast(at % 32 as int)), 0L) <> 0"))
    return hit.groupBy("item").agg(F.bool_and("hit").alias("maybe"))
