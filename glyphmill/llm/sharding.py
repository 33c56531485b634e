"""Sharding by a consistent-hash ring with virtual nodes and bounded loads (operator 2), DataFrame functions only.

Every shard owns many virtual nodes on a ring of cells; a row belongs to the first node clockwise of its id's hash. A
shard takes rows up to its capacity, and rows that overflow a full shard continue clockwise to the next node whose
shard has room. Capacities add up to the row count, so counts end at most one apart (the law ``rows``), and only the
overflow leaves its home shard.

How it scales: the walk needs only the number of rows in each (cell, salt) unit, a table whose size is fixed by the
parameters, never by the data. Rows get their rank inside a unit by a window over units (a hot id is spread over the
salts), and a broadcast of the fixed-size piece table turns ranks into shards and slots.

Edge cases: null and empty texts have size 1 and CRC 0; rows that repeat an id are placed one by one; a null id
hashes like any other value; an empty table gives an empty result; only the id and the text are read, so other
columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphmill.llm.common import checkpointed

CELL_BITS = 11
SALTS = 8


def ring(spark: SparkSession, shards: int, vnodes: int) -> list[int]:
    """Home shard of each cell. ``shards * vnodes`` hashes are collected, whatever the data."""
    nodes = (
        spark.range(shards * vnodes)
        .select((F.col("id") % shards).cast("int").alias("shard"), F.expr("id div %d" % shards).alias("v"))
        .select("shard", F.shiftrightunsigned(F.xxhash64(F.lit("vnode"), "shard", "v"), 64 - CELL_BITS).alias("cell"))
        .groupBy("cell")
        .agg(F.min("shard").alias("shard"))
        .collect()
    )
    at = {r["cell"]: r["shard"] for r in nodes}
    cells = 1 << CELL_BITS
    owner, home = at[min(at)], [0] * cells
    for cell in range(cells - 1, -1, -1):
        owner = at.get(cell, owner)
        home[cell] = owner
    return home


def allocate(home: list[int], counts: dict[tuple[int, int], int], shards: int) -> list[tuple]:
    """Pieces ``(cell, salt, first, last, shard, slot, home)``: which ranks of a unit go where."""
    total = sum(counts.values())
    load = [0] * shards
    for (cell, _), n in counts.items():
        load[home[cell]] += n
    room = [total // shards] * shards
    for s in sorted(range(shards), key=lambda s: (-load[s], s))[: total % shards]:
        room[s] += 1
    fill, pieces, over = [0] * shards, [], []

    def put(cell: int, salt: int, first: int, n: int, s: int) -> None:
        pieces.append((cell, salt, first, first + n - 1, s, fill[s], home[cell]))
        fill[s] += n
        room[s] -= n

    for cell, salt in sorted(counts):
        n, s = counts[cell, salt], home[cell]
        here = min(n, room[s])
        if here:
            put(cell, salt, 0, here, s)
        if here < n:
            over.append((cell, salt, here, n - here))
    for cell, salt, first, n in over:
        at = cell
        while n:
            s = home[at]
            if here := min(n, room[s]):
                put(cell, salt, first, here, s)
                first, n = first + here, n - here
            at = (at + 1) % len(home)
    return pieces


def shard(df: DataFrame, shards: int = 16, vnodes: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, size, text_crc32, law, shard, slot, grown_shard, home_shard`` for every row."""
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    hashed = F.xxhash64(F.col(id_col))
    rows = checkpointed(
        df.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + 1).cast("bigint").alias("size"),
            F.crc32(text).alias("text_crc32"),
            hashed.alias("pos"),
            F.monotonically_increasing_id().alias("row"),
        )
        .withColumn("cell", F.shiftrightunsigned("pos", 64 - CELL_BITS).cast("int"))
        .withColumn("salt", F.pmod(F.xxhash64("pos", "row"), F.lit(SALTS)).cast("int"))
    )
    counts = {(r[0], r[1]): r[2] for r in rows.groupBy("cell", "salt").count().collect()}
    pieces = spark.createDataFrame(
        allocate(ring(spark, shards, vnodes), counts, shards),
        "cell int, salt int, first bigint, last bigint, shard int, base bigint, home_shard int",
    )
    unit = Window.partitionBy("cell", "salt").orderBy("pos", "id", "row")
    ranked = rows.withColumn("rank", F.row_number().over(unit).cast("bigint") - 1).alias("r")
    return ranked.join(
        F.broadcast(pieces).alias("p"),
        (F.col("r.cell") == F.col("p.cell"))
        & (F.col("r.salt") == F.col("p.salt"))
        & F.col("rank").between(F.col("first"), F.col("last")),
    ).select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("base") + F.col("rank") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "home_shard",
    )
