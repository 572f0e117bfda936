"""Rare values of text columns become one class."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmill.functions.casts import literal, quoted
from trailmill.operators.joins import left_join_unique
from trailmill.operators.numbering import numbered
from trailmill.session import written


def frequent_values(df: DataFrame, columns: Sequence[str], limit: int) -> DataFrame:
    """(column, value, n) of the ``limit`` most frequent values of each text column.

    Only columns with more values are listed. Values are counted per task before the shuffle, all
    of them exactly; equally frequent ones are taken in order of the value.
    """
    pairs = ", ".join(f"struct({literal(n)} AS column, {quoted(n)} AS value)" for n in columns)
    counts = (
        df.selectExpr(f"inline(array({pairs}))")
        .where("value IS NOT NULL")
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    counts = written(counts, "values")
    # one row per column
    large = counts.groupBy("column").agg(F.count(F.lit(1)).alias("values")).where(F.col("values") > limit)
    many = counts.join(F.broadcast(large.select("column")), "column", "left_semi")
    placed = numbered(many, [F.col("n").desc(), "value"], "place", "places", within="column")
    return placed.where(F.col("place") <= limit).select("column", "value", "n")


def fold_rare(df: DataFrame, columns: Sequence[str], limit: int, label: str, **bounds: int) -> DataFrame:
    """``df`` with all but the ``limit`` most frequent values of each column replaced by ``label``.

    Null stays null; columns with at most ``limit`` values stay as they are.
    """
    if not columns:
        return df
    kept = written(frequent_values(df, columns, limit), "frequent")
    large = {row["column"] for row in kept.select("column").distinct().collect()}  # at most ``columns``
    for name in columns:
        if name not in large:
            continue
        entries = kept.where(F.col("column") == name)
        table = entries.select(F.col("value").alias("__value"), F.lit(True).alias("__kept"))
        keyed = df.withColumn("__value", F.col(quoted(name)))
        value = F.when(F.col("__value").isNotNull() & F.col("__kept").isNull(), F.lit(label)).otherwise(F.col("__value"))
        df = left_join_unique(keyed, table, "__value", **bounds).withColumn(name, value).drop("__value", "__kept")
    return df
