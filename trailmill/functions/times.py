"""Time text: format detection, epoch milliseconds and calendar day."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmill.functions.casts import literal, quoted

# The accepted text formats, tried in this order; epoch sits before local text.
SPACED_OFFSET = "yyyy-MM-dd HH:mm:ss.SSS xx"
ISO_LOCAL = "yyyy-MM-dd'T'HH:mm[:ss][.SSSSSSSSS]"
ISO_OFFSET = ISO_LOCAL + "XXXXX"
ISO_ZONED = ISO_OFFSET + "['['VV']']"

FORMATS = ("spaced_offset", "iso_offset", "iso_zoned", "epoch_s", "epoch_ms", "iso_local")

_PATTERNS = {"spaced_offset": SPACED_OFFSET, "iso_offset": ISO_OFFSET, "iso_zoned": ISO_ZONED}

# An epoch text is at least this long; a longer sample means milliseconds.
EPOCH_DIGITS = 10

# Column types that hold times already, and how they are read: an instant as it is, a local time
# in the zone of the run.
STORED_TYPES = {"timestamp": "stored_instant", "timestamp_ntz": "stored_local", "date": "stored_local"}
# Any of FORMATS, told apart per value: for text beside stored times, such as time bounds.
ANY = "any"

# The format is that of the record's file, named in this column.
BY_FILE = "by_file"
FORMAT_COLUMN = "__time_format"

# Milliseconds beyond this have no calendar day in Spark (the product with 1000 leaves bigint).
_DAY_LIMIT_MS = 9_000_000_000_000_000


def zone_name(zone: str) -> str:
    return "UTC" if zone in ("", "Z") else zone


def _instant(text: str, pattern: str) -> str:
    return f"unix_millis(try_to_timestamp({text}, {literal(pattern)}))"


def to_millis(text: str, fmt: str, zone: str = "Z") -> str:
    """Epoch milliseconds of a time text in a known format; null if it does not fit."""
    if fmt in _PATTERNS:
        return _instant(text, _PATTERNS[fmt])
    if fmt == "stored_instant":
        return text
    if fmt == ANY:
        seconds = f"CASE WHEN length({text}) <= {EPOCH_DIGITS} THEN {to_millis(text, 'epoch_s')} END"
        others = [to_millis(text, f, zone) for f in ("spaced_offset", "iso_zoned", "epoch_ms", "iso_local")]
        return f"coalesce({seconds}, {', '.join(others)})"
    if fmt in ("iso_local", "stored_local"):
        # read as if UTC (independent of the session zone), then move into the given zone
        as_utc = f"try_to_timestamp({text} || 'Z', {literal(ISO_LOCAL + 'XXX')})"
        return f"unix_millis(to_utc_timestamp({as_utc}, {literal(zone_name(zone))}))"
    if fmt in ("epoch_s", "epoch_ms"):
        number = f"try_cast({text} AS BIGINT)"
        scaled = number if fmt == "epoch_ms" else f"try_multiply({number}, 1000L)"
        return f"CASE WHEN length({text}) >= {EPOCH_DIGITS} THEN {scaled} END"
    raise ValueError(f"unknown time format {fmt!r}")


def to_day(text: str, millis: str, fmt: str, zone: str = "Z") -> str:
    """Calendar day as text: written dates keep their own day, epochs use the given zone."""
    if fmt.startswith("epoch") or fmt == "stored_instant":
        in_range = f"CASE WHEN {millis} BETWEEN -{_DAY_LIMIT_MS} AND {_DAY_LIMIT_MS} THEN {millis} END"
        local = f"from_utc_timestamp(timestamp_millis({in_range}), {literal(zone_name(zone))})"
        # the instant shifted into the zone, read back in UTC whatever the session zone is
        return f"CAST(date_from_unix_date(CAST(floor(unix_micros({local}) / 86400000000) AS INT)) AS STRING)"
    return f"CASE WHEN {millis} IS NOT NULL THEN substring({text}, 1, 10) END"


@dataclass(frozen=True)
class TimeReader:
    """The detected format together with the zone: how this input writes time.

    ``formats`` are those of the files if they differ (``fmt`` is then BY_FILE).
    """

    fmt: str
    zone: str = "Z"
    formats: tuple[str, ...] = ()

    def of(self, raw_type: str) -> TimeReader:
        """How a column of this type is read: stored times need no format."""
        if raw_type in STORED_TYPES:
            return TimeReader(STORED_TYPES[raw_type], self.zone)
        return TimeReader(ANY, self.zone) if self.fmt in STORED_TYPES.values() else self

    def alone(self) -> TimeReader:
        """How a text that belongs to no file is read, such as a time bound."""
        return TimeReader(ANY, self.zone) if self.fmt == BY_FILE else self

    def _each(self, of_format) -> str:
        cases = " ".join(f"WHEN '{name}' THEN {of_format(name)}" for name in self.formats)
        return f"CASE {FORMAT_COLUMN} {cases} END"

    def millis(self, text: str) -> str:
        if self.fmt == BY_FILE:
            return self._each(lambda name: to_millis(text, name, self.zone))
        return to_millis(text, self.fmt, self.zone)

    def day(self, text: str, millis: str) -> str:
        if self.fmt == BY_FILE:
            return self._each(lambda name: to_day(text, millis, name, self.zone))
        return to_day(text, millis, self.fmt, self.zone)


def time_text(column: str, raw_type: str) -> str:
    """What the reader of this type reads: milliseconds of an instant, otherwise text."""
    if raw_type == "timestamp":
        return f"unix_millis({column})"
    text = column if raw_type == "string" else f"CAST({column} AS STRING)"
    if raw_type == "timestamp_ntz":
        return f"replace({text}, ' ', 'T')"
    return f"({text} || 'T00:00')" if raw_type == "date" else text


_WHOLE = ("tinyint", "smallint", "int", "bigint")


def _shape(text: str) -> str:
    """The one format whose look a text has, found without parsing."""
    return (
        f"CASE WHEN try_cast({text} AS BIGINT) IS NOT NULL THEN"
        f" CASE WHEN length({text}) <= {EPOCH_DIGITS} THEN 'epoch_s' ELSE 'epoch_ms' END"
        f" WHEN {text} NOT LIKE '%-%:%' THEN NULL"
        f" WHEN substring({text}, 11, 1) = ' ' THEN 'spaced_offset'"
        f" WHEN {text} LIKE '%]' THEN 'iso_zoned'"
        f" WHEN substring({text}, 17) RLIKE '[Z+-]' THEN 'iso_offset' ELSE 'iso_local' END"
    )


def _vote(text: str, shape: str) -> str:
    """The format of the shape if the text parses in it, or null: one parse a value."""
    return f"CASE {shape} " + " ".join(
        f"WHEN '{name}' THEN CASE WHEN {to_millis(text, name)} IS NOT NULL THEN '{name}' END"
        for name in FORMATS if not name.startswith("epoch")
    ) + f" ELSE {shape} END"


def format_votes(records: DataFrame, column: str, by: str | None = None) -> DataFrame:
    """One row (per ``by``): n values, and how many fit each format.

    Whole numbers are told apart by size; a text is parsed in the one format it looks like. What fits
    an offset alone also fits the zoned form.
    """
    raw_type = dict(records.dtypes)[column]
    kept = [quoted(by)] if by else []
    if raw_type in _WHOLE:
        number = quoted(column)
        low, high = -(10 ** (EPOCH_DIGITS - 1)) + 1, 10**EPOCH_DIGITS - 1
        short = f"CASE WHEN CAST({number} AS BIGINT) BETWEEN {low}L AND {high}L THEN 'epoch_s' ELSE 'epoch_ms' END"
        voted = records.selectExpr(*kept, f"{number} AS v", f"CASE WHEN {number} IS NOT NULL THEN {short} END AS vote")
    else:
        text = f"nullif(CAST({quoted(column)} AS STRING), '')"
        shaped = records.selectExpr(*kept, f"{text} AS v").selectExpr("*", f"{_shape('v')} AS shape")
        voted = shaped.selectExpr(*kept, "v", f"{_vote('v', 'shape')} AS vote")
    fitting = {name: f"vote = '{name}'" for name in FORMATS} | {"iso_zoned": "vote IN ('iso_offset', 'iso_zoned')"}
    counts = [F.count("v").alias("n"), *(F.expr(f"count_if({fits})").alias(n) for n, fits in fitting.items())]
    return voted.groupBy(by).agg(*counts) if by else voted.agg(*counts)


def detect_format(records: DataFrame, column: str) -> str:
    """The format that most values fit, the first listed of equals: one aggregate.

    A column without any value is read alike by every format. A column of a stored time type
    is not looked into.
    """
    raw_type = dict(records.dtypes)[column]
    if raw_type in STORED_TYPES:
        return STORED_TYPES[raw_type]
    counted = format_votes(records, column).first()
    best = max(FORMATS, key=lambda name: counted[name])
    if counted["n"] and not counted[best]:
        raise ValueError(f"the values of {column!r} match no known time format")
    return best


def formats_by_file(records: DataFrame, column: str, file: str) -> DataFrame:
    """(file, FORMAT_COLUMN): the format that most values of a file fit.

    Files whose values fit none take the format that most values of all files fit.
    """
    votes = format_votes(records, column, by=file)
    total = votes.agg(*[F.sum(name).alias(name) for name in ("n", *FORMATS)])

    def best(df: DataFrame, name: str) -> DataFrame:
        most = F.greatest(*FORMATS)
        choice = F.coalesce(*[F.when((F.col(f) == most) & (most > 0), F.lit(f)) for f in FORMATS])
        return df.withColumn(name, choice)

    # one row on the right
    whole = best(total, "__whole").select("__whole")
    return best(votes, FORMAT_COLUMN).join(F.broadcast(whole)).select(
        file, F.coalesce(FORMAT_COLUMN, "__whole").alias(FORMAT_COLUMN)
    )


def format_of(text: str) -> str:
    """Per value: the name of the first format it fits, or null."""
    return _vote(text, f"({_shape(text)})")
