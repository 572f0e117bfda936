"""The profile report as lines of text, built from the small result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmill.operators.profile import cardinality_warnings, empty_columns

# Fixed value: how numbers are shown.
NUMBER = "###.###"

_EMPTY_TITLES = (
    ("string_no_data", "String columns without any data:"),
    ("number_no_data", "Number columns without any data:"),
    ("number_no_valid_data", "Number columns without any valid data:"),
)


def _number(value: Column) -> Column:
    return F.call_function("format_number", value, F.lit(NUMBER))


def _lines(df: DataFrame, section: int, order: Column, text: Column) -> DataFrame:
    return df.select(
        F.lit(section).alias("section"), order.cast("string").alias("place"), text.alias("line")
    )


def report_lines(
    totals: DataFrame,
    profiled: DataFrame,
    daily: DataFrame,
    reasons: DataFrame | None = None,
    start: str | None = None,
    end: str | None = None,
    unique_strings: int | None = None,
) -> DataFrame:
    """(section, place, line); sorted by section and place it reads as the report."""
    key = F.format_string("%05d", F.col("position"))
    files = (
        F.concat(F.lit(" from "), F.col("files").cast("string"), F.lit(" files"))
        if "files" in totals.columns else F.lit("")
    )
    parts: list[DataFrame] = [
        _lines(
            totals, 1, F.lit("0"),
            F.concat(
                F.lit("Records: "), F.col("total").cast("string"), files,
                F.lit(", written: "), F.col("written").cast("string"),
                F.lit(", rejected: "), F.col("rejected").cast("string"),
                F.lit(", outside the time bounds: "), F.col("time_gated").cast("string"),
            ),
        ),
        _lines(
            totals, 1, F.lit("1"),
            F.lit(f"Time bounds: start {start or 'none'}, end {end or 'none'}"),
        ),
    ]
    if reasons is not None:
        parts.append(
            _lines(
                reasons, 2, F.col("reject_reason"),
                F.concat(F.lit("Rejected "), F.col("reject_reason"), F.lit(": "), F.col("n").cast("string")),
            )
        )
    if unique_strings is not None:
        parts.append(
            _lines(
                cardinality_warnings(profiled, unique_strings), 3, F.col("column"),
                F.concat(
                    F.lit("WARNING: "), F.col("column"), F.lit(" has "), F.col("n_distinct").cast("string"),
                    F.lit(f" distinct strings, more than {unique_strings}"),
                ),
            )
        )
    parts.append(
        _lines(
            profiled, 4, key,
            F.concat(
                F.col("column"), F.lit(": non-null "), F.col("non_null").cast("string"),
                F.lit(", invalid "), F.col("invalid").cast("string"),
                F.lit(", null "), F.col("nulls").cast("string"),
                F.lit(", out of range "), F.col("out_of_range").cast("string"),
                F.lit(", zero "), F.col("zeros").cast("string"),
                F.lit(", type "), F.col("type"),
                F.coalesce(
                    F.concat(
                        F.lit(", min "), _number(F.col("min")), F.lit(", max "), _number(F.col("max"))
                    ),
                    F.lit(""),
                ),
                F.coalesce(
                    F.concat(F.lit(", distinct "), F.col("n_distinct").cast("string")), F.lit("")
                ),
            ),
        )
    )
    empty = empty_columns(profiled)
    for i, (finding, title) in enumerate(_EMPTY_TITLES):
        named = empty.where(F.col("finding") == finding).agg(
            F.array_join(F.array_sort(F.collect_list("column")), ", ").alias("names")
        )  # at most one name per output column
        parts.append(
            _lines(named, 5 + i, F.lit(""), F.concat(F.lit(title + " "), F.col("names")))
        )
    parts.append(
        _lines(
            daily, 9, F.coalesce("day", F.lit("")),
            F.concat(F.coalesce("day", F.lit("no day")), F.lit(": "), F.col("n").cast("string")),
        )
    )
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def ordered_text(lines: DataFrame) -> DataFrame:
    return lines.orderBy("section", "place").select(F.col("line").alias("value"))
