"""Distinct counts that later runs can add to: sketches per file and day, stored with the profile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmill.functions.casts import literal, quoted
from trailmill.operators.clean import DAY
from trailmill.operators.schema import OutputColumn
from trailmill.sources.files import FILE_COLUMN

# Two to this power are the registers of a sketch.
LOG_REGISTERS = 12


def relative_error(log_registers: int = LOG_REGISTERS) -> float:
    """Three standard errors of an estimate, as a share of the true count."""
    return 3 * 1.04 / 2 ** (log_registers / 2)


def distinct_sketches(
    cleaned: DataFrame, columns: Sequence[OutputColumn], log_registers: int = LOG_REGISTERS
) -> DataFrame:
    """(column, file, day, n, sketch) of the string columns; nulls are not a value."""
    names = [c.name for c in columns if c.kind == "string" and c.role not in ("encoded", "ids")]
    schema = "column string, file string, day string, n long, sketch binary"
    if not names:
        return cleaned.sparkSession.createDataFrame([], schema)
    file = F.col(FILE_COLUMN) if FILE_COLUMN in cleaned.columns else F.lit(None).cast("string")
    pairs = ", ".join(f"struct({literal(n)} AS column, {quoted(n)} AS value)" for n in names)
    return (
        cleaned.select(file.alias("file"), F.col(DAY).alias("day"), F.expr(f"inline(array({pairs}))"))
        .where("value IS NOT NULL")
        .groupBy("column", "file", "day")
        .agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg("value", F.lit(log_registers)).alias("sketch"))
    )


def store_sketches(sketches: DataFrame, path: str) -> None:
    """Add a run's sketches to those of earlier runs."""
    sketches.write.mode("append").parquet(path)


def stored_sketches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def estimated_distinct(sketches: DataFrame, by: Sequence[str] = ("column",)) -> DataFrame:
    """(column, n, n_distinct) over any sketches, or per file or day: united, then estimated."""
    return sketches.groupBy(*by).agg(
        F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct")
    )
