"""A first look at the columns of an input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmill.functions.casts import quoted, to_float
from trailmill.sources.files import FILE_COLUMN

# Fixed value: sample values shown per column.
EXAMPLES = 3


def _text_at(place: int):
    return lambda row: row["texts"][place]


def column_preview(records: DataFrame, order_by: str | None = None) -> DataFrame:
    """(position, column, type, examples): guessed from the first value, with three samples.

    ``order_by`` makes "first" well defined; it is not previewed itself.
    """
    names = [c for c in records.columns if c not in (FILE_COLUMN, order_by)]
    sample = records.orderBy(order_by).limit(EXAMPLES) if order_by else records.limit(EXAMPLES)
    texts = [F.col(quoted(n)).cast("string").alias(f"t{i}") for i, n in enumerate(names)]
    place = F.col(order_by) if order_by else F.monotonically_increasing_id()
    rows = sample.select(
        F.struct(place.alias("place"), F.array(*texts).alias("texts")).alias("row")
    ).agg(F.array_sort(F.collect_list("row")).alias("rows"))
    columns = [
        F.struct(
            F.lit(i + 1).alias("position"),
            F.lit(n).alias("column"),
            F.transform("rows", _text_at(i)).alias("values"),
        )
        for i, n in enumerate(names)
    ]
    shown = rows.select(F.explode(F.array(*columns)).alias("c")).select("c.*")
    return shown.withColumn("first", F.get("values", F.lit(0))).selectExpr(
        "position",
        "column",
        "CASE WHEN coalesce(first, '') = '' THEN 'Undetermined'"
        f" WHEN ({to_float('first')}) IS NOT NULL THEN 'Float' ELSE 'String' END AS type",
        # each sample is followed by a semicolon and a blank; a missing one shows as null
        "array_join(transform(values, v -> coalesce(v, 'null') || '; '), '') AS examples",
    )


def search_columns(preview: DataFrame, text: str) -> DataFrame:
    """Rows of a preview whose column name contains the text, whatever its case."""
    return preview.where(F.contains(F.lower("column"), F.lit(text.strip().lower())))
