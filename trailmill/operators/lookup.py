"""Columns added from lookup tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmill.functions.casts import CASTS, quoted
from trailmill.operators.clean import NullMarkers, judge, status_of
from trailmill.operators.joins import left_join_unique
from trailmill.sources.lookups import LookupTable


def add_lookup(
    df: DataFrame,
    lookup: LookupTable,
    source_text: str,
    markers: NullMarkers = NullMarkers(),
    with_status: bool = False,
    **bounds: int,
) -> DataFrame:
    """Left join on the lower-cased source text; no match gives null.

    ``source_text`` is the column that holds the text of the lookup's source column.
    """
    table = lookup.latest().select(F.col("key").alias("__key"), F.col("value").alias("__value"))
    keyed = df.withColumn("__key", F.lower(F.col(quoted(source_text))))
    joined = left_join_unique(keyed, table, "__key", **bounds)
    parsed = joined.selectExpr("*", f"{CASTS[lookup.kind]('__value')} AS __parsed")
    marked = markers.hit(lookup.target, lookup.kind, "__parsed")
    value, status = judge("__value", "__parsed", marked)
    added = [f"{value} AS {quoted(lookup.target)}"]
    if with_status:
        added.append(f"{status} AS {quoted(status_of(lookup.target))}")
    return parsed.selectExpr("*", *added).drop("__key", "__value", "__parsed")
