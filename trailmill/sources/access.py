"""Files as tasks see them: opened by their full name in a shared file system."""

from __future__ import annotations

import csv
import gzip
import io
import sys
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Functions that run in tasks travel with the plan, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def full_name(spark: SparkSession, path: str) -> str:
    """The path as a URI with its file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toUri().toString()


def file_system(uri: str):
    """(file system, path in it) of a full name."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


class _Seekable(io.RawIOBase):
    """A file of Arrow with the errors of Python's files."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.size, self.at = file, file.size(), 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        at = offset + (0, self.at, self.size)[whence]
        if at < 0:
            raise OSError("position before the beginning")
        self.at = at
        return at

    def tell(self) -> int:
        return self.at

    def readinto(self, buffer) -> int:
        n = max(0, min(len(buffer), self.size - self.at))
        data = self.file.read_at(n, self.at) if n else b""
        buffer[: len(data)] = data
        self.at += len(data)
        return len(data)

    def close(self) -> None:
        self.file.close()
        super().close()


def open_seekable(uri: str) -> io.BufferedReader:
    system, path = file_system(uri)
    return io.BufferedReader(_Seekable(system.open_input_file(path)), 1 << 20)


def tasks_can_open(spark: SparkSession, path: str) -> bool:
    """Whether Arrow knows the file system; otherwise only Spark's own readers do."""
    try:
        file_system(full_name(spark, path))
    except (pa.ArrowException, OSError, ValueError):
        return False
    return True


def csv_rows(lines: Iterator[str], sep: str, quote: str) -> Iterator[list[str]]:
    csv.field_size_limit(sys.maxsize)
    return csv.reader(lines, delimiter=sep, quotechar=quote, skipinitialspace=True)


def first_names(lines: Iterator[str], sep: str, quote: str) -> list[str]:
    """Column names of the first record, trimmed; empty if there is no record."""
    return [name.strip() for name in next(csv_rows(lines, sep, quote), [])]


def headers_by_file(
    spark: SparkSession, paths: Sequence[str], pattern: str, sep: str, quote: str
) -> DataFrame:
    """(file, names): the header of every CSV file that has one, found where tasks run.

    Only the beginning of each file is read. Where the file system is known to Spark alone, the
    first lines come from a scan of all of them.
    """
    schema = "file string, names array<string>"
    if all(tasks_can_open(spark, path) for path in paths):
        listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(list(paths))

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                files = batch.column(0).to_pylist()
                found = []
                for file in files:
                    with open_seekable(file) as raw:
                        stream = gzip.GzipFile(fileobj=raw) if file.endswith(".gz") else raw
                        found.append(first_names(io.TextIOWrapper(stream, "utf-8", newline=""), sep, quote))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(files, pa.string()), pa.array(found, pa.list_(pa.string()))], ["file", "names"]
                )

        # the path alone: the contents are not read
        headers = listed.select("_metadata.file_path").mapInArrow(read, schema)
    else:
        lines = spark.read.option("pathGlobFilter", pattern).text(list(paths)).select(
            F.col("_metadata.file_path").alias("file"), "value", F.monotonically_increasing_id().alias("place"),
            F.col("_metadata.file_block_start").alias("block"),
        )
        first = lines.where("block = 0").groupBy("file").agg(F.min_by("value", "place").alias("value"))

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [first_names(iter([line]), sep, quote) for line in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(found, pa.list_(pa.string()))], ["file", "names"]
                )

        headers = first.mapInArrow(cut, schema)
    return headers.where(F.size("names") > 0)
