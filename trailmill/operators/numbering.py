"""Consecutive numbers over a whole table without bringing it to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmill.session import written

# monotonically_increasing_id: task number above this bit, place within the task below it
_PLACE_BITS = 33


def numbered(
    df: DataFrame,
    order: Sequence[str | Column],
    name: str,
    label: str,
    within: str | None = None,
) -> DataFrame:
    """Number the rows 1, 2, 3 ... in the given order, separately per value of ``within``.

    Rows are range-partitioned and sorted once and written with their (task, place); the
    numbers then follow from the row count of each task, a table of one row per task and
    ``within`` value. ``order`` must tell every two rows apart.
    """
    keys = ([F.col(within)] if within else []) + [F.col(o) if isinstance(o, str) else o for o in order]
    sorted_rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    place = F.monotonically_increasing_id()
    stored = written(sorted_rows.withColumn("__place", place), label)
    stored = stored.withColumn("__task", F.shiftright("__place", _PLACE_BITS))
    group = ["__task"] + ([within] if within else [])
    sizes = stored.groupBy(*group).agg(
        F.count(F.lit(1)).alias("__n"), F.min("__place").alias("__first")
    )
    before = Window.partitionBy(*([within] if within else [F.lit(1)])).orderBy("__task").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = sizes.select(
        *group, "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")
    )
    # one row per shuffle task (and dictionary column): bounded by the session, not by the data
    return (
        stored.join(F.broadcast(offsets), group)
        .withColumn(name, F.col("__before") + F.col("__place") - F.col("__first") + 1)
        .drop("__place", "__task", "__first", "__before")
    )
