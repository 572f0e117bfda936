"""Record files: CSV (plain, gzip, zip) and Parquet, one kind per run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmill.operators.joins import left_join_unique
from trailmill.operators.numbering import numbered
from trailmill.options import AUTO, OptionsError
from trailmill.sources.access import headers_by_file
from trailmill.sources.dialect import QUOTES, SEPARATORS, Dialect, detect_dialect
from trailmill.sources.mixed import read_by_footer
from trailmill.sources.zipped import ZIP_ENDING, read_zipped_csv, read_zipped_lines, zipped_header

# Widest record, and the file endings that are read.
MAX_COLUMNS = 1000
CSV_ENDINGS = (".csv", ".gz")
PARQUET_ENDING = ".parquet"

# Name of the column that says which file a record came from.
FILE_COLUMN = "__file"
# Where a record stands in the input: by name of the file, then by place in it.
PLACE_COLUMN = "__place"

_PLAIN = "*{" + ",".join(CSV_ENDINGS) + "}"


def _paths(path: str | Sequence[str]) -> list[str]:
    return [path] if isinstance(path, str) else list(path)


def holds(spark: SparkSession, path: str | Sequence[str], endings: Sequence[str]) -> bool:
    """Whether a file, or a file of a flat folder, has one of the endings."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for one in _paths(path):
        where = jvm.org.apache.hadoop.fs.Path(one)
        fs = where.getFileSystem(conf)
        if not fs.exists(where):
            raise OptionsError(f"input {one!r} does not exist")
        if fs.getFileStatus(where).isFile():
            if one.endswith(tuple(endings)):
                return True
            continue
        files = fs.listStatusIterator(where)  # up to the first hit, in pages of the file system
        while files.hasNext():
            status = files.next()
            name = status.getPath().getName()
            if name.endswith(tuple(endings)) and not name.startswith((".", "_")) and status.isFile():
                return True
    return False


def input_kind(spark: SparkSession, path: str | Sequence[str]) -> str:
    """``csv`` or ``parquet``; a mixture or neither is an error."""
    csv = holds(spark, path, (*CSV_ENDINGS, ZIP_ENDING))
    parquet = holds(spark, path, (PARQUET_ENDING,))
    if csv and parquet:
        raise OptionsError("the input holds both CSV and Parquet files")
    if not csv and not parquet:
        raise OptionsError("the input holds no .csv, .gz, .zip or .parquet file")
    return "csv" if csv else "parquet"


def csv_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(value): all lines of a CSV input, in archives too."""
    parts = []
    if holds(spark, path, CSV_ENDINGS):
        parts.append(spark.read.option("pathGlobFilter", _PLAIN).text(_paths(path)))
    if holds(spark, path, (ZIP_ENDING,)):
        parts.append(read_zipped_lines(spark, _paths(path)))
    if not parts:
        raise OptionsError("not a CSV input")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def csv_dialect(spark: SparkSession, path: str | Sequence[str], sep: str = AUTO, quote: str = AUTO) -> Dialect:
    """Separator and quote; what is ``auto`` is found by one pass over all lines."""
    if AUTO not in (sep, quote):
        return Dialect(sep, quote)
    return detect_dialect(
        csv_lines(spark, path),
        SEPARATORS if sep == AUTO else (sep,),
        QUOTES if quote == AUTO else (quote,),
    )


def _csv_reader(spark: SparkSession, multiline: bool, dialect: Dialect):
    return (
        spark.read.option("maxColumns", MAX_COLUMNS)
        .option("maxCharsPerColumn", -1)
        .option("sep", dialect.sep)
        .option("quote", dialect.quote)
        .option("escape", dialect.quote)  # a doubled quote stands for one quote
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .option("multiLine", multiline)
        .option("mode", "PERMISSIVE")
        # the folder itself, not its files one by one: it may hold very many
        .option("pathGlobFilter", _PLAIN)
    )


def _texts(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _read_plain(reader, paths: list[str], names: Sequence[str], header: bool) -> DataFrame:
    frame = reader.schema(_texts(names)).option("header", header).csv(paths)
    return frame.select("*", F.col("_metadata.file_path").alias(FILE_COLUMN))


def _reconciled(reader, paths: list[str], names: Sequence[str], headers: DataFrame) -> DataFrame:
    """Records of files whose columns stand in different orders, matched by each file's header."""
    if len(set(names)) < len(names):
        raise OptionsError("files with different headers must not name a column twice")
    wrong = headers.where(F.array_sort("names") != F.lit(sorted(names))).head(1)
    if wrong:
        found = wrong[0]["names"]
        raise OptionsError(
            f"{wrong[0]['file']}: columns missing {sorted(set(names) - set(found))},"
            f" unknown {sorted(set(found) - set(names))}"
        )
    places = F.transform(F.lit(list(names)), lambda n: F.array_position("names", n).cast("int") - 1)
    table = headers.select(F.col("file").alias(FILE_COLUMN), places.alias("__places"))
    columns = [f"__c{i}" for i in range(len(names))]
    joined = left_join_unique(_read_plain(reader, paths, columns, True), table, FILE_COLUMN)
    values = F.array(*columns)
    return joined.select(
        *[F.get(values, F.col("__places")[i]).alias(n) for i, n in enumerate(names)], FILE_COLUMN
    )


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    headers: Sequence[str] | None = None,
    multiline: bool = False,
    quote: str = '"',
    sep: str = ",",
) -> DataFrame:
    """All values as text, plus the file each record came from.

    Without ``headers`` the first line of every file is its header. Columns are matched by name, in
    the order of the first file; a file with a missing or an unknown column is an error. Records
    with quoted line breaks need ``multiline``, which makes each file one task. ``quote`` and
    ``sep`` may be ``auto``.
    """
    if input_kind(spark, path) != "csv":
        raise OptionsError("not a CSV input")
    paths = _paths(path)
    dialect = csv_dialect(spark, path, sep, quote)
    plain, zipped = holds(spark, path, CSV_ENDINGS), holds(spark, path, (ZIP_ENDING,))
    parts = []
    reader = _csv_reader(spark, multiline, dialect)
    names = [n.strip() for n in headers] if headers is not None else None
    if plain and names:
        parts.append(_read_plain(reader, paths, names, False))
    elif plain:
        found = headers_by_file(spark, paths, _PLAIN, dialect.sep, dialect.quote)
        # a row per different header: one, unless columns change their order
        kinds = found.groupBy("names").agg(F.min("file").alias("file")).collect()
        if kinds:
            names = min(kinds, key=lambda row: row["file"])["names"]
            if len(kinds) == 1:
                parts.append(_read_plain(reader, paths, names, True))
            else:
                parts.append(_reconciled(reader, paths, names, found))
    if zipped:
        names = names or zipped_header(spark, paths, dialect.sep, dialect.quote)
        if names:
            parts.append(
                read_zipped_csv(spark, paths, names, headers is None, dialect.sep, dialect.quote, FILE_COLUMN)
            )
    if not parts:
        raise OptionsError("the input files are empty")
    frame = parts[0]
    for other in parts[1:]:
        frame = frame.unionByName(other)
    return frame


def _parquet(spark: SparkSession, path: str | Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The records with and without the file each came from."""
    if input_kind(spark, path) != "parquet":
        raise OptionsError("not a Parquet input")
    frames = read_by_footer(spark, _paths(path), f"*{PARQUET_ENDING}")
    parts: list[DataFrame] = []
    for frame, turned in frames:
        columns = [F.col(f"`{c}`").cast(turned[c]).alias(c) if c in turned else F.col(f"`{c}`") for c in frame.columns]
        named = frame.select(*columns, F.col("_metadata.file_path").alias(FILE_COLUMN))
        parts.append(parts[-1].unionByName(named, allowMissingColumns=True) if parts else named)
    # a file column that nobody uses makes the Parquet scan build all metadata of every row
    return parts[-1], frames[0][0] if len(frames) == 1 else parts[-1].drop(FILE_COLUMN)


def read_parquet(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Columns keep their stored types, so typed filters still reach the files.

    Where files store a column with different types, each is read with its own and turned into the
    least type that holds all; a column that a file lacks is null there.
    """
    return _parquet(spark, path)[0]


def read_for_run(
    spark: SparkSession,
    path: str | Sequence[str],
    headers: Sequence[str] | None = None,
    multiline: bool = False,
    quote: str = '"',
    sep: str = ",",
) -> tuple[DataFrame, DataFrame]:
    """The records with the file each came from, and the same for whoever needs no file."""
    if input_kind(spark, path) == "parquet":
        return _parquet(spark, path)
    records = read_csv(spark, path, headers, multiline, quote, sep)
    return records, records


def read_records(
    spark: SparkSession,
    path: str | Sequence[str],
    headers: Sequence[str] | None = None,
    multiline: bool = False,
    quote: str = '"',
    sep: str = ",",
) -> DataFrame:
    """A file, a flat folder or several of them; the endings say which kind it is."""
    return read_for_run(spark, path, headers, multiline, quote, sep)[0]


def reading_place(records: DataFrame, files: DataFrame) -> DataFrame:
    """``records`` of ``read_records`` with ``PLACE_COLUMN``: one number that grows in reading order.

    Files count in order of their names, records of a file in theirs. The number is made where a
    record is read: rank of the file, block of the file that a task reads, place in the task.
    ``files`` (file, rank) has one row per file.
    """
    table = files.select(F.col("file").alias(FILE_COLUMN), F.col("rank").alias("__rank"))
    # rows of a task count up within 33 bits; blocks are positions in a file
    row = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    digits = "decimal(38,0)"
    numbered_rows = records.withColumn("__row", row)
    place = (
        F.col("__rank").cast(digits) * F.lit(str(10**25)).cast(digits)
        + F.col("__block").cast(digits) * F.lit(str(10**10)).cast(digits)
        + F.col("__row").cast(digits)
    ).cast(digits)
    return left_join_unique(numbered_rows, table, FILE_COLUMN).withColumn(PLACE_COLUMN, place).drop(
        "__rank", "__block", "__row"
    )


def read_in_order(
    spark: SparkSession,
    path: str | Sequence[str],
    headers: Sequence[str] | None = None,
    quote: str = '"',
    sep: str = ",",
) -> DataFrame:
    """Records of plain CSV or of Parquet files with ``PLACE_COLUMN``."""
    paths = _paths(path)
    kind = input_kind(spark, path)
    pattern = f"*{PARQUET_ENDING}" if kind == "parquet" else _PLAIN
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(paths)
    files = numbered(listed.select(F.col("_metadata.file_path").alias("file")), ["file"], "rank", "files")
    if kind == "parquet":
        frame = spark.read.option("pathGlobFilter", pattern).parquet(*paths)
    else:
        if holds(spark, path, (ZIP_ENDING,)):
            raise OptionsError("records of archives have no reading order")
        dialect = csv_dialect(spark, path, sep, quote)
        if headers is None:
            found = headers_by_file(spark, paths, _PLAIN, dialect.sep, dialect.quote)
            kinds = found.groupBy("names").agg(F.min("file").alias("file")).collect()
            if len(kinds) != 1:
                raise OptionsError("the files have different headers")
            headers = kinds[0]["names"]
            reader = _csv_reader(spark, False, dialect).option("header", True)
        else:
            reader = _csv_reader(spark, False, dialect).option("header", False)
        frame = reader.schema(_texts(headers)).csv(paths)
    named = frame.select(
        "*", F.col("_metadata.file_path").alias(FILE_COLUMN), F.col("_metadata.file_block_start").alias("__block")
    )
    return reading_place(named, files)


def union_records(*frames: DataFrame) -> DataFrame:
    """Records of several runs, matched by column name."""
    whole = frames[0]
    for other in frames[1:]:
        whole = whole.unionByName(other)
    return whole
