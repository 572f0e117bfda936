"""Lookup files: a ``source,target,type`` line, then ``key,value`` lines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmill.options import VALUE_TYPES, Lookup, OptionsError

# Separators that are tried on the first line.
SEPARATORS = (",", ";", "\t", "|")


@dataclass(frozen=True)
class LookupTable:
    """``rows`` holds (key, value, position): text, text, place in the file."""

    source: str
    target: str
    kind: str
    rows: DataFrame

    def __post_init__(self):
        if self.kind not in VALUE_TYPES:
            raise OptionsError(f"lookup {self.target!r}: unknown type {self.kind!r}")

    def latest(self) -> DataFrame:
        """(key, value) with the key in lower case; the last of equal keys wins."""
        return self.rows.groupBy(F.lower("key").alias("key")).agg(
            F.max_by("value", "position").alias("value")
        )


def read_lookup(spark: SparkSession, lookup: Lookup) -> LookupTable:
    first = spark.read.text(lookup.path).head(1)
    if not first:
        raise OptionsError(f"lookup file {lookup.path!r} is empty")
    line = first[0][0]
    sep = lookup.sep or max(SEPARATORS, key=line.count)
    names = [part.strip().strip('"') for part in line.split(sep)]
    if len(names) < 3:
        raise OptionsError(f"lookup file {lookup.path!r} needs source, target and type")
    rows = (
        spark.read.schema("key string, value string")
        .option("sep", sep)
        .option("escape", '"')
        .option("header", True)
        .option("enforceSchema", True)
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .csv(lookup.path)
        .select(
            "key",
            "value",
            # place in the file: block by block, then line by line inside a block
            F.struct(
                F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("line"),
            ).alias("position"),
        )
    )
    return LookupTable(names[0], names[1], names[2].lower(), rows)
