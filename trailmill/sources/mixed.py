"""Parquet folders whose files store a column with different types."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmill.sources.access import open_seekable, tasks_can_open

# Functions that run in tasks travel with the plan, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Each type may be read as any later one of its line; anything may be read as text.
NUMBERS = ("bigint", "double")
TIMES = ("date", "timestamp")


def _kind(kind: pa.DataType) -> str:
    if pa.types.is_integer(kind):
        return "bigint"
    if pa.types.is_floating(kind) or pa.types.is_decimal(kind):
        return "double"
    if pa.types.is_date(kind):
        return "date"
    if pa.types.is_timestamp(kind):
        return "timestamp"
    return str(kind)


def joined_type(kinds: Sequence[str]) -> str | None:
    """The least type that holds all of ``kinds``; None if they are one already."""
    different = set(kinds)
    if len(different) == 1:
        return None
    for line in (NUMBERS, TIMES):
        if different <= set(line):
            return line[-1]
    return "string"


def footers(spark: SparkSession, paths: Sequence[str], pattern: str) -> DataFrame:
    """(file, stored, kinds): names with their exact types, and with the type they count as."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(list(paths))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import parquet

        for batch in batches:
            files = batch.column(0).to_pylist()
            stored, kinds = [], []
            for file in files:
                with open_seekable(file) as raw:
                    schema = parquet.read_schema(raw)
                stored.append([f"{field.name}\t{field.type}" for field in schema])
                kinds.append([f"{field.name}\t{_kind(field.type)}" for field in schema])
            texts = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(files, pa.string()), pa.array(stored, texts), pa.array(kinds, texts)],
                ["file", "stored", "kinds"],
            )

    schema = "file string, stored array<string>, kinds array<string>"
    return listed.select("_metadata.file_path").mapInArrow(read, schema)  # paths alone, no contents


def read_by_footer(spark: SparkSession, paths: Sequence[str], pattern: str) -> list[tuple[DataFrame, dict[str, str]]]:
    """One frame per different footer, with the types its columns must be turned into.

    A single frame with no types to turn if all files agree, or where only Spark's own readers know the
    file system. Integers and decimals beside doubles become doubles, dates beside instants
    instants, everything else text; so only whole numbers beyond 2^53 beside doubles lose digits.
    """
    whole = [(spark.read.option("pathGlobFilter", pattern).parquet(*paths), {})]
    if not all(tasks_can_open(spark, path) for path in paths):
        return whole
    groups = footers(spark, paths, pattern).groupBy("stored", "kinds")
    # a row per different footer
    different = groups.agg(F.min("file").alias("least")).orderBy("least").collect()
    if len(different) == 1:
        return whole
    kinds: dict[str, list[str]] = {}
    for row in different:
        for name, kind in (entry.rsplit("\t", 1) for entry in row["kinds"]):
            kinds.setdefault(name, []).append(kind)
    turned = {name: kind for name, found in kinds.items() if (kind := joined_type(found))}
    # names of the files, which Spark needs on the driver to read some of a folder
    files = {tuple(row["stored"]): row["files"] for row in groups.agg(F.collect_list("file").alias("files")).collect()}
    frames = []
    for row in different:
        frame = spark.read.parquet(*sorted(files[tuple(row["stored"])]))
        frames.append((frame, {name: kind for name, kind in turned.items() if name in frame.columns}))
    return frames
