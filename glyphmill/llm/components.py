"""Connected components: parts of the edges are joined in one task each, then large-star and small-star rounds on
DataFrames alternate until nothing changes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import checkpointed

#: Edges that one task joins before the rounds: 16 bytes each, so some megabytes.
LOCAL = 200_000


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of some edges that is not the least of its component, and that least node."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    left, right, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        x, y = root[left], root[right]
        apart = x != y
        if not apart.any():
            break
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (root[root] != root).any():
            root = root[root]
    own = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[own], nodes[root[own]]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in stars(a, b)], ["a", "b"])

    a, b = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        own = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
        a, b = (np.concatenate(x) for x in zip((a, b), own, strict=True))
        if len(a) > 2 * LOCAL:  # more than a task should hold; the rounds join the pieces
            yield out(a, b)
            a, b = np.empty(0, np.int64), np.empty(0, np.int64)
    yield out(a, b)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``a, b`` (longs) but the roots; the root is the smallest node.

    Each task first replaces its LOCAL edges or so by stars; if one task was enough, that is the answer. Each round then
    halves path lengths or better, so the number of rounds is logarithmic in the longest path. A round's edges are
    written to the checkpoint folder, never kept on one executor or the driver. Self-loops and edges with a null are
    ignored and repeated edges count once; without edges the result is empty.
    """
    now = checkpointed(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    tasks = max(1, math.ceil(now.count() / LOCAL))
    now = checkpointed(now.coalesce(tasks).mapInArrow(_joined, "a bigint, b bigint"))
    seen = None
    while tasks > 1:
        now = checkpointed(_small_star(_large_star(now)).where("a <> b").distinct())
        mark = now.select(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.hash("a", "b").cast("bigint"))
        ).first()
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
