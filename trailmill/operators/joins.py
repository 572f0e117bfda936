"""Left joins to a table with unique keys that stay whole and even at any size.

A table is broadcast only after its rows and bytes were measured. Beyond the bound it is
shuffled, and keys that hold a large share of the records are spread over several tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 * 1024 * 1024

SPREAD = "__spread"
_SALT = "__salt"
_HASH = "__hash"
_PARTS = "__parts"


def width_of(value: Column, kind: T.DataType) -> Column:
    """Bytes of a value: texts by their length, arrays and maps by what they hold; 8 for the rest."""
    if isinstance(kind, T.StringType | T.BinaryType):
        width = F.octet_length(value).cast("long")
    elif isinstance(kind, T.StructType):
        width = F.lit(8).cast("long")
        for field in kind.fields:
            width = width + width_of(value.getField(field.name), field.dataType)
    elif isinstance(kind, T.ArrayType):
        element = kind.elementType
        if isinstance(element, T.StringType | T.BinaryType | T.StructType | T.ArrayType | T.MapType):
            width = F.aggregate(value, F.lit(8).cast("long"), lambda sum_, x: sum_ + width_of(x, element))
        else:
            width = 8 + 8 * F.size(value).cast("long")
    elif isinstance(kind, T.MapType):
        width = width_of(F.map_keys(value), T.ArrayType(kind.keyType)) + width_of(
            F.map_values(value), T.ArrayType(kind.valueType)
        )
    else:
        return F.lit(8).cast("long")
    return F.coalesce(width, F.lit(8).cast("long"))


def fits_broadcast(
    table: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> bool:
    """Measure a table: true when both its rows and its bytes are within the bound."""
    width = F.lit(0).cast("long")
    for field in table.schema:
        width = width + width_of(F.col(f"`{field.name}`"), field.dataType)
    size = table.agg(F.count(F.lit(1)).alias("rows"), F.sum(width).alias("bytes")).first()
    return size["rows"] <= max_rows and (size["bytes"] or 0) <= max_bytes


def spread_column(df: DataFrame) -> DataFrame:
    """Number the records once, where they come straight from the files.

    The number only decides which task handles a record of a heavy key. It is kept through
    later joins: taken after a shuffle it could change when a lost task is run again.
    """
    if SPREAD in df.columns:
        return df
    return df.withColumn(SPREAD, F.monotonically_increasing_id())


def heavy_keys(counts: DataFrame, tasks: int) -> list[tuple[int, int]]:
    """(key hash, number of parts) of keys with more than one task's share of the records.

    ``counts`` has (hash, n). By counting, fewer than ``tasks`` keys can hold more than a task's
    share; so many rows of two numbers reach the driver, together with the true total.
    """
    counts = counts.select("hash", "n")
    top = counts.orderBy(F.desc("n"), "hash").limit(tasks)
    total = counts.agg(F.lit(None).cast("long").alias("hash"), F.sum("n").alias("n"))
    rows = top.unionByName(total).collect()
    records = next(row["n"] for row in rows if row["hash"] is None)
    return [
        (row["hash"], parts)
        for row in rows
        if row["hash"] is not None and (parts := -(-row["n"] * tasks // records)) > 1
    ]


def left_join_unique(
    records: DataFrame,
    table: DataFrame,
    key: str,
    counts: DataFrame | None = None,
    max_rows: int = BROADCAST_ROWS,
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``records`` left join ``table`` on ``key``; ``key`` is unique in ``table``.

    ``counts`` (hash, n) says how often a key occurs, where that is already known.
    """
    if fits_broadcast(table, max_rows, max_bytes):
        return records.join(F.broadcast(table), key, "left")
    spark = records.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if counts is None:
        counts = (
            records.where(F.col(key).isNotNull())
            .groupBy(F.xxhash64(key).alias("hash"))
            .agg(F.count(F.lit(1)).alias("n"))
        )
    heavy = spark.createDataFrame(
        heavy_keys(counts, tasks), f"{_HASH} long, {_PARTS} int"
    )  # at most one row of two numbers per task, so broadcasting it is safe at any data size

    def marked(df: DataFrame) -> DataFrame:
        return df.withColumn(_HASH, F.xxhash64(key)).join(F.broadcast(heavy), _HASH, "left")

    had_spread = SPREAD in records.columns
    parts = F.when(F.col(key).isNull(), tasks).otherwise(F.coalesce(_PARTS, F.lit(1)))
    left = marked(spread_column(records)).withColumn(_SALT, F.pmod(F.col(SPREAD), parts).cast("int"))
    right = marked(table).withColumn(
        _SALT, F.explode(F.sequence(F.lit(0), F.coalesce(_PARTS, F.lit(1)) - 1))
    )
    joined = left.drop(_HASH, _PARTS).join(right.drop(_HASH, _PARTS), [key, _SALT], "left")
    return joined.drop(_SALT) if had_spread else joined.drop(_SALT, SPREAD)
