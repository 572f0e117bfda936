"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns many arcs of a ring; a key falls into the arc that holds its hash. Shards have
a capacity in rows, and the capacities add up to the number of rows, so counts differ by one at
most. Rows beyond a full shard's capacity go on clockwise to the next arc whose shard has room.
All other rows stay where the plain ring puts them.

The driver handles counts per arc only (shards x replicas numbers). Rows are numbered in small
blocks of the ring; a block that one repeated key fills is split by the task that read it.
Everything is DataFrame operations. Null keys share one place on the ring. Repeated rows each
get a slot of their own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailmill.session import written

RING_BITS = 40
CELL_BITS = 12
BLOCK_ROWS = 4096


def _place(*key: Column) -> Column:
    return F.xxhash64(*key).bitwiseAND((1 << RING_BITS) - 1)


def ring_arcs(spark: SparkSession, shards: int, replicas: int) -> list[tuple[int, int, int]]:
    """(first, last, shard) of every arc in ring order; an arc ends at its virtual node."""
    nodes = sorted(
        spark.range(shards * replicas)
        .select(
            # a node's place depends on its shard and number alone, so other shards leave it there
            _place(F.lit("node"), F.col("id") % shards, F.floor(F.col("id") / shards)).alias("at"),
            (F.col("id") % shards).cast("int").alias("shard"),
        )
        .collect()  # shards x replicas rows, whatever the data
    )
    arcs, first = [], 0
    for at, shard in nodes:
        if at >= first:
            arcs.append((first, at, shard))
            first = at + 1
    if first < 1 << RING_BITS:  # from the last node to the end: clockwise that is the first node
        arcs.append((first, (1 << RING_BITS) - 1, arcs[0][2]))
    return arcs


def bounded_loads(
    arcs: list[tuple[int, int, int]], counts: dict[int, int], shards: int
) -> list[tuple[int, int, int, int]]:
    """(arc, first rank, end rank, shard): which rows of each arc go to which shard."""
    total = sum(counts.values())
    room = [total // shards + (shard < total % shards) for shard in range(shards)]
    parts, over = [], []
    for arc, (_, _, shard) in enumerate(arcs):
        n = counts.get(arc, 0)
        stay = min(n, room[shard])
        room[shard] -= stay
        if stay:
            parts.append((arc, 0, stay, shard))
        if stay < n:
            over.append((arc, stay, n))
    for arc, start, end in over:
        at = arc
        while start < end:
            at = (at + 1) % len(arcs)
            shard = arcs[at][2]
            take = min(end - start, room[shard])
            if take:
                room[shard] -= take
                parts.append((arc, start, start + take, shard))
                start += take
    return parts


def shard_rows(
    rows: DataFrame, key: str, shards: int = 24, replicas: int = 64
) -> DataFrame:
    """``rows`` with ``home_shard`` (plain ring), ``shard`` and ``slot`` (gapless from 0 in it).

    ``rows`` should be narrow: it is written once and shuffled.
    """
    spark = rows.sparkSession
    arcs = ring_arcs(spark, shards, replicas)
    shift = RING_BITS - CELL_BITS
    cells = spark.createDataFrame(
        [
            (cell, first, last, arc, shard)
            for arc, (first, last, shard) in enumerate(arcs)
            for cell in range(first >> shift, (last >> shift) + 1)
        ],
        "__cell long, __first long, __last long, __arc int, home_shard int",
    )
    placed = rows.withColumn("__at", _place(F.col(key)))
    kept = written(
        placed.withColumn("__cell", F.shiftright("__at", shift))
        .join(F.broadcast(cells), "__cell")  # at most 2^CELL_BITS + shards x replicas rows
        .where(F.col("__at").between(F.col("__first"), F.col("__last")))
        .drop("__cell", "__first", "__last")
        .withColumn("__task", F.spark_partition_id())
        .withColumn("__row", F.monotonically_increasing_id()),
        "ring",
    )
    n = kept.count()
    bits = min(RING_BITS - 1, max(0, math.ceil(math.log2(max(1, n / BLOCK_ROWS)))))
    kept = kept.withColumn("__block", F.shiftright("__at", RING_BITS - bits))
    block = ["__arc", "__block"]
    full = (
        kept.groupBy(*block)
        .agg(F.count(F.lit(1)).alias("__n"))
        .where(F.col("__n") > 8 * BLOCK_ROWS)
        .select(*block, F.lit(True).alias("__full"))
    )
    split = F.when(F.col("__full"), F.col("__task")).otherwise(-1)
    kept = kept.join(full, block, "left").withColumn("__split", split).drop("__full")
    block = [*block, "__split"]
    counts = kept.groupBy(*block).agg(F.count(F.lit(1)).alias("__n"))
    per_arc = counts.groupBy("__arc").agg(F.sum("__n").alias("n"))
    parts = bounded_loads(arcs, {r["__arc"]: r["n"] for r in per_arc.collect()}, shards)
    filled, table = [0] * shards, []
    for arc, start, end, shard in parts:
        table.append((arc, start, end, shard, filled[shard]))
        filled[shard] += end - start
    plan = spark.createDataFrame(
        table, "__arc int, __start long, __end long, shard int, __slot long"
    )
    before = Window.partitionBy("__arc").orderBy("__block", "__split")
    offsets = counts.select(*block, (F.sum("__n").over(before) - F.col("__n")).alias("__before"))
    order = Window.partitionBy(*block).orderBy("__at", key, "__row")
    rank = F.col("__before") + F.row_number().over(order) - 1
    return (
        kept.join(offsets, block)
        .withColumn("__rank", rank)
        .join(F.broadcast(plan), "__arc")  # at most arcs + shards x arcs rows
        .where((F.col("__rank") >= F.col("__start")) & (F.col("__rank") < F.col("__end")))
        .select(
            *rows.columns,
            "home_shard",
            "shard",
            (F.col("__slot") + F.col("__rank") - F.col("__start")).alias("slot"),
        )
    )


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Size, checksum, shard and slot of every document; counts per shard are at most one apart."""
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return shard_rows(rows, "doc_id", shards).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "home_shard",
    )
