"""Writing results."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmill.operators.numbering import numbered
from trailmill.session import discard, table_path, written


def write_records(
    df: DataFrame,
    path: str,
    records_per_file: int = 0,
    row_group_bytes: int | None = None,
    page_bytes: int | None = None,
    mode: str = "errorifexists",
) -> None:
    """Snappy Parquet; a task starts a new file after ``records_per_file`` records (0: never)."""
    writer = _writer(df, row_group_bytes, page_bytes, mode)
    if records_per_file:
        writer = writer.option("maxRecordsPerFile", records_per_file)
    writer.parquet(path)


def write_rolled(
    df: DataFrame,
    path: str,
    order: Sequence[str],
    records_per_file: int = 0,
    row_group_bytes: int | None = None,
    page_bytes: int | None = None,
    mode: str = "errorifexists",
    drop: Sequence[str] = (),
) -> None:
    """Snappy Parquet files of exactly ``records_per_file`` records, only the last may hold fewer.

    Records are numbered over the whole output in the given order, which must tell every two
    apart; the number decides the file, and every file is written by a task of its own, in that
    order. 0 gives one file: all tasks sort a share, then one task copies the shares in order and
    holds no more than a page of them. The columns in ``drop`` are not written.
    """
    columns = [F.col(f"`{c}`") for c in df.columns if c not in drop]
    if not records_per_file:
        stored = written(df.repartitionByRange(*order).sortWithinPartitions(*order).select(*columns), "rolled")
        _writer(_one_after_another(stored), row_group_bytes, page_bytes, mode).parquet(path)
        discard(stored)
        return
    places = numbered(df, list(order), "__at", "rolled")
    files = max(1, -(-places.count() // records_per_file))
    dealt = places.repartitionById(files, F.floor((F.col("__at") - 1) / records_per_file).cast("int"))
    ordered = dealt.sortWithinPartitions("__at").select(*columns)
    _writer(ordered, row_group_bytes, page_bytes, mode).parquet(path)


def _one_after_another(stored: DataFrame) -> DataFrame:
    """The rows of a table of ``written`` in one partition, file after file by their numbers.

    A table has one file per task that wrote it, so there are few of them at any size of the data.
    """
    spark, folder = stored.sparkSession, table_path(stored)
    listed = spark.read.format("binaryFile").load(folder).select("path").collect()
    names = sorted((row["path"].rpartition("/")[2] for row in listed), key=lambda n: int(n.split("-")[1]))
    parts = [spark.read.schema(stored.schema).parquet(f"{folder}/{name}") for name in names]
    return reduce(DataFrame.unionAll, parts, parts.pop(0)).coalesce(1) if parts else stored.coalesce(1)


def _writer(df: DataFrame, row_group_bytes: int | None, page_bytes: int | None, mode: str):
    writer = df.write.mode(mode).option("compression", "snappy")
    if row_group_bytes:
        writer = writer.option("parquet.block.size", row_group_bytes)
    if page_bytes:
        writer = writer.option("parquet.page.size", page_bytes)
    return writer


def write_text(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A small ordered table of lines as one text file."""
    lines.coalesce(1).write.mode(mode).text(path)
