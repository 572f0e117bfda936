"""Inputs that are not uniform: archives of several entries, headers, dialects, formats and types."""

from __future__ import annotations

import posixpath
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suite.files import _AS_READ, _COLUMNS, _texts, _written_csv
from suite.inputs import derived, table, with_inputs
from suite.registry import query
from trailmill.options import PrepOptions
from trailmill.plans.preparation import prepare
from trailmill.session import scratch_path
from trailmill.sources.access import file_system, full_name
from trailmill.sources.dialect import QUOTES, SEPARATORS
from trailmill.sources.files import FILE_COLUMN, csv_dialect, read_csv, read_parquet

_ROUND_TRIP = with_inputs(f"SELECT {_AS_READ} FROM geo_raw", "geo_raw")


@query("csv_zip_entries", _ROUND_TRIP)
def csv_zip_entries(spark, sf_dir):
    """Archives of three entries: two of records, the second with its columns reversed, and one of text."""
    source = _written_csv(spark, sf_dir)
    target = full_name(spark, scratch_path(spark, "zip"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, folder = file_system(target)
        system.create_dir(folder)
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                header, *rows = content.decode().splitlines()
                half = len(rows) // 2
                turned = [",".join(reversed(row.split(","))) for row in [header, *rows[half:]]]
                with system.open_output_stream(f"{folder}/{posixpath.basename(path)}.zip") as out:
                    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
                        archive.writestr("first.csv", "\n".join([header, *rows[:half]]) + "\n")
                        archive.writestr("about.md", "Records of one table, in two parts.\n")
                        archive.writestr("second/part.csv", "\n".join(turned) + "\n")
            yield pd.DataFrame({"name": batch["path"]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(source)
    files.select("path", "content").mapInPandas(pack, "name string").count()
    return _texts(read_csv(spark, target))


@query("csv_headers_reordered", _ROUND_TRIP)
def csv_headers_reordered(spark, sf_dir):
    """One folder whose files name the same columns in two different orders."""
    path = scratch_path(spark, "orders")
    frame = derived(spark, sf_dir, "geo_raw")
    for part, columns in ((0, _COLUMNS), (1, sorted(_COLUMNS, reverse=True))):
        some = frame.where(F.col("row_id") % 2 == part).select(*columns)
        some.write.mode("append").options(header=True, maxRecordsPerFile=5000).csv(path)
    return _texts(read_csv(spark, path))


_NOTE = "'no, yes; ' || c_name || '| ' || chr(9) || c_mktsegment"


@query(
    "csv_dialect_detected",
    " UNION ALL ".join(
        f"SELECT CAST(c_custkey AS STRING) AS id, CAST(c_acctbal AS STRING) AS amount, {_NOTE} AS note,"
        f" '{sep}' AS sep, '{quote.replace(chr(39), chr(39) * 2)}' AS quote FROM customer"
        for sep in SEPARATORS for quote in QUOTES
    ),
)
def csv_dialect_detected(spark, sf_dir):
    """Values that hold every separator, written in every dialect and read without being told which."""
    frame = table(spark, sf_dir, "customer").selectExpr(
        "CAST(c_custkey AS STRING) AS id", "CAST(c_acctbal AS STRING) AS amount", f"{_NOTE} AS note"
    )
    whole = None
    for sep in SEPARATORS:
        for quote in QUOTES:
            path = scratch_path(spark, "dialect")
            frame.write.options(header=True, sep=sep, quote=quote, escape=quote).csv(path)
            found = csv_dialect(spark, path)
            part = read_csv(spark, path, sep=found.sep, quote=found.quote).select(
                "id", "amount", "note", F.lit(found.sep).alias("sep"), F.lit(found.quote).alias("quote")
            )
            whole = part if whole is None else whole.unionByName(part)
    return whole


@query(
    "time_format_per_file",
    "SELECT l_orderkey * 8 + l_linenumber AS trip_id, (1700000000 + l_orderkey * 37 + l_linenumber) * 1000 AS time"
    " FROM lineitem",
)
def time_format_per_file(spark, sf_dir):
    """A folder in which files write times as seconds, as milliseconds or with an offset."""
    path = scratch_path(spark, "formats")
    seconds = F.lit(1_700_000_000).cast("long") + F.col("l_orderkey") * 37 + F.col("l_linenumber")
    frame = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("trip_id"), seconds.alias("s"),
        F.lit("58.25").alias("y"), F.lit("26.5").alias("x"),
    )
    written = {
        0: F.col("s").cast("string"),
        1: (F.col("s") * 1000).cast("string"),
        2: F.date_format(F.timestamp_seconds(F.col("s") + 7200), "yyyy-MM-dd'T'HH:mm:ss'+02:00'"),
    }
    for part, text in written.items():
        some = frame.where(F.col("trip_id") % 3 == part).select("trip_id", text.alias("at"), "y", "x")
        some.write.mode("append").options(header=True, maxRecordsPerFile=20_000).csv(path)
    options = PrepOptions(longitude="x", latitude="y", time="at", long_columns=["trip_id"], input_path=path)
    return prepare(spark, options).records().select("trip_id", "time")


_MIXED = {
    0: ("CAST(c_custkey AS INT)", "CAST(c_custkey AS BIGINT)", "CAST(c_nationkey AS INT)", "DATE '2024-01-02'"),
    1: ("CAST(c_custkey AS BIGINT)", "c_custkey + CAST(0.5 AS DOUBLE)", "'n' || CAST(c_nationkey AS STRING)",
        "TIMESTAMP '2024-01-02 03:04:05'"),
    2: ("CAST(c_custkey AS INT)", "CAST(c_custkey AS BIGINT)", None, "DATE '2024-01-03'"),
}


@query(
    "parquet_mixed_types",
    " UNION ALL ".join(
        f"""SELECT c_custkey AS id, CAST({whole} AS BIGINT) AS whole, CAST({amount} AS DOUBLE) AS amount,
            {f'CAST({label} AS STRING)' if label else 'NULL'} AS label,
            CAST(epoch(CAST({seen} AS TIMESTAMP)) AS BIGINT) AS seen FROM customer WHERE c_custkey % 3 = {part}"""
        for part, (whole, amount, label, seen) in _MIXED.items()
    ),
)
def parquet_mixed_types(spark, sf_dir):
    """Files with narrow and wide numbers, fractions, dates, instants and text, and one without a column."""
    path = scratch_path(spark, "mixed")
    customer = table(spark, sf_dir, "customer")
    for part, (whole, amount, label, seen) in _MIXED.items():
        columns = {"id": "c_custkey", "whole": whole, "amount": amount, "label": label, "seen": seen}
        some = customer.where(F.col("c_custkey") % 3 == part)
        some.selectExpr(*[f"{e} AS {n}" for n, e in columns.items() if e]).write.mode("append").parquet(path)
    back: DataFrame = read_parquet(spark, path).drop(FILE_COLUMN)
    return back.select("id", "whole", "amount", "label", F.unix_seconds("seen").alias("seen"))
