"""The data profile: per-column counts, ranges and distinct values, totals, days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmill.functions.casts import literal, quoted
from trailmill.operators.clean import ACCEPTED, DAY, INVALID, NULL, OUT_OF_RANGE, REASON, status_of
from trailmill.operators.schema import OutputColumn
from trailmill.sources.files import FILE_COLUMN


def profile_counts(cleaned: DataFrame, columns: Sequence[OutputColumn]) -> DataFrame:
    """One row per column over all records, rejected ones too.

    Every record becomes one row per column, counted by column and reduced per task before the
    shuffle; so the plan has the same size for any number of columns. Out-of-range coordinates
    count as null as well.
    """
    cells = []
    for i, column in enumerate(columns):
        value, status = quoted(column.name), quoted(status_of(column.name))
        numeric = column.kind != "string" and column.role not in ("encoded", "ids")
        ranged = numeric and column.kind in ("float", "double")
        number = f"CAST({value} AS DOUBLE)" if ranged else "CAST(NULL AS DOUBLE)"
        zero = f"coalesce({value} = 0, false)" if numeric else "false"
        cells.append(f"struct({i + 1} AS position, {status} AS status, {zero} AS zero, {number} AS number)")
    counted = (
        cleaned.selectExpr(f"inline(array({', '.join(cells)}))")
        .groupBy("position")
        .agg(
            F.expr(f"count_if(status NOT IN ('{NULL}', '{OUT_OF_RANGE}'))").alias("non_null"),
            F.expr(f"count_if(status = '{INVALID}')").alias("invalid"),
            F.expr(f"count_if(status IN ('{NULL}', '{OUT_OF_RANGE}'))").alias("nulls"),
            F.expr(f"count_if(status = '{OUT_OF_RANGE}')").alias("out_of_range"),
            F.count_if("zero").alias("zeros"),
            F.min("number").alias("min"),
            F.max("number").alias("max"),
        )
    )
    names = cleaned.sparkSession.createDataFrame(
        [(i + 1, c.name, c.kind) for i, c in enumerate(columns)], "position int, column string, type string"
    )
    # one row per output column on both sides
    return names.join(F.broadcast(counted), "position", "left").fillna(
        0, ["non_null", "invalid", "nulls", "out_of_range", "zeros"]
    )


def profile_distinct(
    cleaned: DataFrame, columns: Sequence[OutputColumn], approximate: bool = False
) -> DataFrame:
    """(column, n_distinct) of the string columns; nulls are not a value.

    Exact: values are reduced per task before the shuffle, so frequent values do not pile up.
    """
    names = [c.name for c in columns if c.kind == "string" and c.role not in ("encoded", "ids")]
    if not names:
        return cleaned.sparkSession.createDataFrame([], "column string, n_distinct long")
    if approximate:
        counted = cleaned.selectExpr(
            *[f"approx_count_distinct({quoted(n)}) AS d{i}" for i, n in enumerate(names)]
        )
        pairs = ", ".join(f"struct({literal(n)} AS column, d{i} AS n_distinct)" for i, n in enumerate(names))
        return counted.selectExpr(f"inline(array({pairs}))")
    pairs = ", ".join(f"struct({literal(n)} AS column, {quoted(n)} AS value)" for n in names)
    return (
        cleaned.selectExpr(f"inline(array({pairs}))")
        .distinct()
        .groupBy("column")
        .agg(F.count("value").alias("n_distinct"))
    )


def with_distinct(counts: DataFrame, distinct: DataFrame) -> DataFrame:
    # one row per output column on both sides
    joined = counts.join(F.broadcast(distinct), "column", "left")
    textual = (F.col("type") == "string") & F.col("n_distinct").isNull()
    return joined.withColumn("n_distinct", F.when(textual, 0).otherwise(F.col("n_distinct")))


def profile(
    cleaned: DataFrame, columns: Sequence[OutputColumn], approximate: bool = False
) -> DataFrame:
    """Counts, ranges and distinct strings, one row per column."""
    return with_distinct(
        profile_counts(cleaned, columns), profile_distinct(cleaned, columns, approximate)
    )


def cardinality_warnings(profiled: DataFrame, limit: int) -> DataFrame:
    """String columns with more distinct values than allowed."""
    return profiled.where(F.col("n_distinct") > limit).select("column", "n_distinct")


def empty_columns(profiled: DataFrame) -> DataFrame:
    """(column, finding): strings or numbers without data, numbers with only malformed data."""
    ranged = F.col("type").isin("float", "double")
    finding = (
        F.when((F.col("type") == "string") & (F.col("n_distinct") == 0), "string_no_data")
        .when(ranged & (F.col("non_null") == 0), "number_no_data")
        .when(ranged & (F.col("non_null") == F.col("invalid")), "number_no_valid_data")
    )
    return profiled.select("column", finding.alias("finding")).where(F.col("finding").isNotNull())


def total_measures(start: int | None, end: int | None) -> dict[str, str]:
    """Aggregates of decided records; plain ones, so that they can also be observed."""
    gates = [f"time < {start}L"] if start is not None else []
    gates += [f"time > {end}L"] if end is not None else []
    return {
        "total": "count(1)",
        "written": f"count_if({ACCEPTED})",
        "rejected": f"count_if(NOT {ACCEPTED})",
        "time_gated": f"count_if({' OR '.join(gates) or 'false'})",
    }


def run_totals(decided: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """One row: total, written, rejected, time_gated and, where known, files."""
    totals = total_measures(start, end)
    if FILE_COLUMN in decided.columns:
        totals["files"] = f"count(DISTINCT {FILE_COLUMN})"
    return decided.selectExpr(*[f"{value} AS {name}" for name, value in totals.items()])


def days_and_reasons(decided: DataFrame) -> DataFrame:
    """(file, day, reason, n): the table that days, reasons and files are counted from."""
    file = F.col(FILE_COLUMN) if FILE_COLUMN in decided.columns else F.lit(None).cast("string")
    return decided.groupBy(file.alias("file"), F.col(DAY).alias("day"), F.col(REASON).alias(REASON)).agg(
        F.count(F.lit(1)).alias("n")
    )


def reject_reasons(rejected: DataFrame) -> DataFrame:
    return rejected.groupBy(REASON).agg(F.count(F.lit(1)).alias("n"))


def rows_per_day(accepted: DataFrame) -> DataFrame:
    """(day, n) of the accepted records, in order of the day."""
    return (
        accepted.groupBy(F.col(DAY).alias("day")).agg(F.count(F.lit(1)).alias("n")).orderBy("day")
    )
