"""Helpers that the training-data operators share."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows, and bytes of Arrow data, that a function gets at a time: texts can be very long, so batches stay small. One
#: row is never split.
BATCH_ROWS, BATCH_BYTES = 512, 8_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def drop_shuffles(spark: SparkSession) -> None:
    """From now on the shuffle files of a query go as soon as it ends. By default they stay until the driver happens to
    collect its garbage, which it does no more often over a large input: there those of all steps lie on disk together."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where it is unset, as in tests, one in the warehouse, which the
    driver and the executors share too."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_glyphmill").rstrip("/")


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch within the bounds in rows and bytes."""
    for at in range(0, batch.num_rows, BATCH_ROWS):
        todo = [batch.slice(at, BATCH_ROWS)]
        while todo:
            part = todo.pop()
            if part.num_rows > 1 and part.nbytes > BATCH_BYTES:
                half = part.num_rows // 2
                todo += [part.slice(half), part.slice(0, half)]
            else:
                yield part


def fresh_name(prefix: str) -> str:
    return f"{prefix}_{uuid.uuid4().hex[:12]}"


def map_batches(df: DataFrame, fn: Callable[[list], dict[str, list]], columns: list[str], schema: str) -> DataFrame:
    """Run ``fn(*column lists) -> {name: list}`` over Arrow batches of the named columns."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    arrow = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                out = fn(*(part.column(i).to_pylist() for i in range(part.num_columns)))
                yield pa.RecordBatch.from_arrays([_column(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.select(*[F.col(c) for c in columns]).mapInArrow(run, schema)


def filter_batches(df: DataFrame, keep: Callable[[list], list[bool]], column: str) -> DataFrame:
    """Rows, with all their columns, for which ``keep(values of the column)`` is true; in place, without a shuffle."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                yield part.filter(pa.array(keep(part.column(at).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def mix(x: np.ndarray) -> np.ndarray:
    """Each 64-bit number scrambled, one to one."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


class Powers:
    """Powers of an odd base and of its inverse modulo 2 ** 64, grown as texts need them."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate((self.up, self.up * np.uint64(pow(self.base, k, 1 << 64))))
            self.down = np.concatenate((self.down, self.down * np.uint64(pow(self.inverse, k, 1 << 64))))
        return self.up[:n], self.down[:n]


class HashTable:
    """Numbers of distinct 64-bit keys, by open addressing; ``none`` (negative) for other keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, none: int) -> None:
        self.shift = np.uint64(64 - max(4, (4 * len(keys)).bit_length()))
        self.none = none
        self.keys = np.zeros(1 << (64 - int(self.shift)), np.uint64)
        self.values = np.full(len(self.keys), none, np.int64)
        slot = self._slot(keys)
        while len(keys):
            _, first = np.unique(slot, return_index=True)
            first = first[self.values[slot[first]] == none]
            self.keys[slot[first]], self.values[slot[first]] = keys[first], values[first]
            left = np.ones(len(keys), bool)
            left[first] = False
            keys, values, slot = keys[left], values[left], (slot[left] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        out = self.values[slot]
        at = np.flatnonzero((self.keys[slot] != keys) & (out != self.none))
        while len(at):
            out[at] = self.none
            slot[at] = (slot[at] + 1) & (len(self.keys) - 1)
            some = self.values[slot[at]] != self.none
            hit = some & (self.keys[slot[at]] == keys[at])
            out[at[hit]] = self.values[slot[at[hit]]]
            at = at[some & ~hit]
        # An empty slot's key is 0 and its number is none already.
        return out


_HELD: dict[str, object] = {}


def on_workers(spark: SparkSession, value: object, build: Callable[[object], object]) -> Callable[[], object]:
    """Broadcast a value of fixed size; the result gives ``build(value)``, made once in each worker process."""
    sent, key = spark.sparkContext.broadcast(pickle.dumps(value)), uuid.uuid4().hex

    def get() -> object:
        if key not in _HELD:
            _HELD.clear()
            _HELD[key] = build(pickle.loads(sent.value))
        return _HELD[key]

    return get


def _column(values: list | pa.Array, kind: pa.DataType) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values, kind)


def _arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(schema))
