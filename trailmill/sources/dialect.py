"""Which separator and quote a CSV input uses."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What is tried, the usual ones first.
SEPARATORS = (",", ";", "\t", "|")
QUOTES = ('"', "'")


@dataclass(frozen=True)
class Dialect:
    sep: str
    quote: str


def _seen(line: Column, sep: str, quote: str) -> Column:
    """(separators outside quotes or null if a quote stays open, fields that begin with a quote)."""
    s, q = re.escape(sep), re.escape(quote)
    opened = F.regexp_count(line, F.lit(rf"(?:^|{s})\x20*{q}"))
    # only quotes at the beginning of a field open it; doubled ones inside stand for themselves
    bare = F.regexp_replace(line, rf"(^|{s})\x20*{q}(?:[^{q}]|{q}{q})*{q}\x20*(?={s}|$)", "$1")
    left = F.regexp_count(bare, F.lit(rf"(?:^|{s})\x20*{q}"))
    return F.struct(
        F.when(left == 0, F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit("")))).alias("width"),
        opened.alias("quoted"),
    )


def detect_dialect(
    lines: DataFrame, separators: Sequence[str] = SEPARATORS, quotes: Sequence[str] = QUOTES
) -> Dialect:
    """The dialect in which most lines have the same number of fields.

    ``lines`` has one text column ``value``. Every line is read in every dialect, and per dialect
    the lines are counted by their number of separators: one aggregate, reduced per task, with a
    row per dialect and width. A dialect's score is the share of lines with its commonest
    width, lines without any separator or with an open quote counting as misses. Of equals the
    one with more quoted fields wins, then the wider, then the first listed.
    """
    dialects = [Dialect(s, q) for s in separators for q in quotes]
    value = F.regexp_replace("value", "\r$", "")
    read = F.array(*[
        F.struct(F.lit(i).alias("dialect"), _seen(value, d.sep, d.quote).alias("seen"))
        for i, d in enumerate(dialects)
    ])
    widths = (
        lines.where(F.trim(value) != "")
        .select(F.explode(read).alias("r"))
        .groupBy("r.dialect", "r.seen.width")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("r.seen.quoted").alias("quoted"))
    )
    best = (
        widths.groupBy("dialect")
        .agg(
            F.max(F.struct(F.when(F.col("width") > 0, F.col("n")).otherwise(0).alias("n"), "width")).alias("mode"),
            F.sum("quoted").alias("quoted"),
        )
        .select("dialect", "mode.n", "mode.width", "quoted")
        .collect()  # one row per dialect
    )
    scored = [(row["n"], row["quoted"], row["width"] or 0, -row["dialect"]) for row in best if row["n"]]
    return dialects[-max(scored)[-1]] if scored else dialects[0]
