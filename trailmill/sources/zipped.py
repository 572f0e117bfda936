"""CSV files inside zip archives, as a data source: its partitions are entries of archives.

An entry is opened by seeking in the shared file system and streams through Arrow's CSV reader,
so neither archives nor entries pass through one value, and their size is not bounded. Small entries
that follow each other in an archive share a partition.
"""

from __future__ import annotations

import io
import json
import re
import sys
import zipfile
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv as arrow_csv
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from trailmill.sources.access import csv_rows, file_system, first_names, full_name, open_seekable

# The reader travels with the plan, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ZIP_ENDING = ".zip"
ENTRY_ENDING = ".csv"
PARTITION_BYTES = 64 << 20
BLOCK_BYTES = 4 << 20
ROWS_PER_BATCH = 10_000
_LISTERS = 16


@dataclass
class Entries(InputPartition):
    archive: str
    names: list[str]


def archives_of(uris: Sequence[str]) -> list[str]:
    """Full names of the archives among files and flat folders, sorted."""
    from pyarrow import fs

    found = []
    for uri in uris:
        system, path = file_system(uri)
        info = system.get_file_info(path)
        if info.type == fs.FileType.Directory:
            prefix = uri.rstrip("/")
            found += [
                f"{prefix}/{entry.base_name}"
                for entry in system.get_file_info(fs.FileSelector(path))
                if entry.is_file and entry.base_name.endswith(ZIP_ENDING) and entry.base_name[0] not in "._"
            ]
        elif info.is_file and uri.endswith(ZIP_ENDING):
            found.append(uri)
    return sorted(found)


def csv_entries(archive: zipfile.ZipFile) -> list[zipfile.ZipInfo]:
    """Entries that end in .csv; if none does, all files. Hidden files are left out."""
    files = [
        entry for entry in archive.infolist()
        if not entry.is_dir() and not entry.filename.startswith("__MACOSX/")
        and entry.filename.rsplit("/", 1)[-1][:1] not in (".", "_")
    ]
    return [e for e in files if e.filename.lower().endswith(ENTRY_ENDING)] or files


def partitions_of(uri: str) -> list[Entries]:
    with open_seekable(uri) as raw, zipfile.ZipFile(raw) as archive:
        packs, size = [], 0
        for entry in csv_entries(archive):
            if not packs or size + entry.compress_size > PARTITION_BYTES:
                packs.append(Entries(uri, []))
                size = 0
            packs[-1].names.append(entry.filename)
            size += entry.compress_size
        return packs


class _Watched:
    """A stream that notes whether a blank stands before a quote, which Arrow reads as text."""

    def __init__(self, stream, sep: str, quote: str):
        self.stream, self.closed, self.seen, self.tail = stream, False, False, b"\n"
        self.sign = re.compile(b"[" + re.escape((sep + "\n").encode()) + b"] +" + re.escape(quote.encode()))

    def read(self, n: int = -1) -> bytes:
        data = self.stream.read(n)
        if not self.seen:
            self.seen = self.sign.search(self.tail + data) is not None
            blanks = len(data) - len(data.rstrip(b" "))
            self.tail = (self.tail + data)[-(blanks + 1) :] if data else self.tail
        return data

    def close(self) -> None:
        self.closed = True


def _padded(rows: Sequence[list[str]], places: Sequence[int]) -> list[pa.Array]:
    """Columns of rows: short records are padded, surplus values dropped, as in plain CSV."""
    return [
        pa.array([(row[i].strip() or None) if i < len(row) else None for row in rows], pa.string())
        for i in places
    ]


def _trimmed(column: pa.Array) -> pa.Array:
    trimmed = pc.ascii_trim_whitespace(column)
    return pc.if_else(pc.equal(trimmed, ""), pa.scalar(None, pa.string()), trimmed)


def entry_columns(
    archive: zipfile.ZipFile, name: str, width: int, places: Sequence[int], skip: int, sep: str, quote: str
) -> Iterator[list[pa.Array]]:
    """Batches of the columns at ``places``, in that order, of one entry.

    Arrow reads the entry until something comes that it reads differently from plain CSV files
    (a blank before a quote, a record longer than a block); the rest is read record by record.
    """
    odd: list[str] = []

    def keep(row: arrow_csv.InvalidRow) -> str:
        odd.append(row.text)
        return "skip"

    done = 0
    with archive.open(name) as member:
        watched = _Watched(member, sep, quote)
        try:
            reader = arrow_csv.open_csv(
                pa.PythonFile(watched, mode="r"),
                arrow_csv.ReadOptions(
                    use_threads=False, block_size=BLOCK_BYTES, skip_rows_after_names=skip,
                    column_names=[str(i) for i in range(width)],
                ),
                arrow_csv.ParseOptions(
                    delimiter=sep, quote_char=quote, newlines_in_values=True, invalid_row_handler=keep
                ),
                arrow_csv.ConvertOptions(
                    column_types={str(i): pa.string() for i in range(width)}, null_values=[],
                    strings_can_be_null=False,
                ),
            )
            for batch in reader:
                if watched.seen:
                    break
                done += batch.num_rows
                yield [_trimmed(batch.column(i)) for i in places]
                if odd:
                    done += len(odd)
                    yield _padded(list(csv_rows(iter(odd), sep, quote)), places)
                    odd.clear()
            else:
                if odd and not watched.seen:
                    yield _padded(list(csv_rows(iter(odd), sep, quote)), places)
                    odd.clear()
                if not watched.seen:
                    return
        except pa.ArrowInvalid:
            pass
    with archive.open(name) as member:
        rows = csv_rows(io.TextIOWrapper(member, "utf-8", newline=""), sep, quote)
        filled = islice((row for row in rows if row), skip + done, None)
        while chunk := list(islice(filled, ROWS_PER_BATCH)):
            yield _padded(chunk, places)


def places_of(names: Sequence[str], found: Sequence[str], where: str) -> list[int]:
    """Where each of ``names`` stands among the columns found; both must be the same names."""
    if sorted(names) != sorted(found):
        missing, unknown = sorted(set(names) - set(found)), sorted(set(found) - set(names))
        raise ValueError(f"{where}: columns missing {missing}, unknown {unknown}")
    return list(range(len(names))) if list(names) == list(found) else [list(found).index(n) for n in names]


class ZippedCsvReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.names = schema.names
        self.uris = json.loads(options["uris"])
        self.header = options["header"] == "true"
        self.lines = options.get("lines") == "true"
        self.sep, self.quote = options["sep"], options["quote"]

    def partitions(self) -> list[Entries]:
        with ThreadPoolExecutor(_LISTERS) as pool:  # only directories of archives are read
            return [pack for packs in pool.map(partitions_of, archives_of(self.uris)) for pack in packs]

    def read(self, partition: Entries | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no archive has an entry
            return
        with open_seekable(partition.archive) as raw, zipfile.ZipFile(raw) as archive:
            for name in partition.names:
                if self.lines:
                    with archive.open(name) as member:
                        text = io.TextIOWrapper(member, "utf-8")
                        while chunk := list(islice(text, ROWS_PER_BATCH)):
                            lines = pa.array([line.rstrip("\n") for line in chunk], pa.string())
                            yield pa.RecordBatch.from_arrays([lines], self.names)
                    continue
                names = self.names[:-1]  # the last column is the archive
                with archive.open(name) as member:
                    found = first_names(io.TextIOWrapper(member, "utf-8", newline=""), self.sep, self.quote)
                if not found:
                    continue
                width = len(found) if self.header else len(names)
                places = (
                    places_of(names, found, f"{partition.archive}, {name}") if self.header else range(width)
                )
                for columns in entry_columns(
                    archive, name, width, places, int(self.header), self.sep, self.quote
                ):
                    file = pa.array([partition.archive] * len(columns[0]), pa.string())
                    yield pa.RecordBatch.from_arrays([*columns, file], self.names)


class ZippedCsv(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zipped_csv"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ZippedCsvReader(schema, dict(self.options))


def _load(spark: SparkSession, schema: T.StructType, paths: Sequence[str], **options: str) -> DataFrame:
    spark.dataSource.register(ZippedCsv)
    uris = json.dumps([full_name(spark, path) for path in paths])
    return spark.read.format(ZippedCsv.name()).schema(schema).options(uris=uris, **options).load()


def zipped_header(spark: SparkSession, paths: Sequence[str], sep: str, quote: str) -> list[str]:
    """Names of the first entry that has any; one archive after the other, usually only one."""
    for uri in archives_of([full_name(spark, path) for path in paths]):
        with open_seekable(uri) as raw, zipfile.ZipFile(raw) as archive:
            for entry in csv_entries(archive):
                with archive.open(entry) as member:
                    names = first_names(io.TextIOWrapper(member, "utf-8", newline=""), sep, quote)
                if names:
                    return names
    return []


def read_zipped_csv(
    spark: SparkSession,
    paths: Sequence[str],
    names: Sequence[str],
    has_header: bool,
    sep: str,
    quote: str,
    file_column: str,
) -> DataFrame:
    """All values as text; quoted line breaks are kept, columns are matched to each entry's header."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, file_column]])
    return _load(spark, schema, paths, header=str(has_header).lower(), sep=sep, quote=quote)


def read_zipped_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(value): all lines of all entries."""
    schema = T.StructType([T.StructField("value", T.StringType())])
    return _load(spark, schema, paths, header="false", sep=",", quote='"', lines="true")
