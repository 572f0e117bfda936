"""Dense ids: each distinct value of a column becomes 1, 2, 3 ... in first-seen order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmill.functions.casts import quoted
from trailmill.operators.joins import left_join_unique
from trailmill.operators.numbering import numbered
from trailmill.session import written


def _nulls_last(*order: Column) -> Column:
    return F.struct(*[x for c in order for x in (c.isNull(), c)])


def build_dictionary(
    df: DataFrame, columns: Sequence[str], first_seen_by: Sequence[str], known: DataFrame | None = None
) -> DataFrame:
    """(column, value, id, n) for the non-null values of text columns.

    ``known`` (column, value, id) is the dictionary of earlier runs: its values keep their ids,
    new values go on after the largest id of their column.

    Values are reduced before the shuffle, so a value that fills a third of the records moves
    as one row per task. Records without an order value count as seen last; equal first
    places are told apart by the value.
    """
    order = [F.col(quoted(c)) for c in first_seen_by]
    single = len(order) == 1  # the least of one number is found by hashing, that of a struct by sorting
    seen = order[0] if single else _nulls_last(*order)
    pairs = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column"), F.col(quoted(c)).alias("value")) for c in columns])
        ).alias("pair"),
        seen.alias("seen"),
    ).select("pair.*", "seen")
    distinct = (
        pairs.where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.min("seen").alias("seen"), F.count(F.lit(1)).alias("n"))
    )
    if single:
        distinct = distinct.withColumn("seen", _nulls_last(F.col("seen")))
    if known is None:
        return numbered(distinct, ["seen", "value"], "id", "dictionary", within="column").select(
            "column", "value", "id", "n"
        )
    known = known.select("column", "value", "id")
    distinct = written(distinct, "seen")
    fresh = numbered(
        distinct.join(known, ["column", "value"], "left_anti"), ["seen", "value"], "id", "dictionary", within="column"
    )
    # one row per column
    last = F.broadcast(known.groupBy("column").agg(F.max("id").alias("last")))
    added = fresh.join(last, "column", "left").select(
        "column", "value", (F.col("id") + F.coalesce("last", F.lit(0))).alias("id"), "n"
    )
    counted = known.join(distinct.select("column", "value", "n"), ["column", "value"], "left")
    return counted.select("column", "value", "id", F.coalesce("n", F.lit(0)).alias("n")).unionByName(added)


def store_dictionary(dictionary: DataFrame, path: str, known: DataFrame | None = None) -> None:
    """Add the entries that ``known`` does not hold to the stored dictionary."""
    entries = dictionary.select("column", "value", "id")
    if known is not None:
        entries = entries.join(known, ["column", "value"], "left_anti")
    entries.write.mode("append").parquet(path)


def stored_dictionary(spark: SparkSession, path: str) -> DataFrame | None:
    """(column, value, id) of all earlier runs; None before the first one."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.schema("column string, value string, id long").parquet(path)


def encode(
    df: DataFrame, dictionary: DataFrame, column: str, target: str, **bounds: int
) -> DataFrame:
    """Add ``target``, the id of ``column``; null stays null."""
    entries = dictionary.where(F.col("column") == column)
    table = entries.select(F.col("value").alias("__value"), F.col("id").alias(target))
    counts = entries.select(F.xxhash64("value").alias("hash"), "n")
    keyed = df.withColumn("__value", F.col(quoted(column)))
    return left_join_unique(keyed, table, "__value", counts, **bounds).drop("__value")
