"""Quality rules with host-level verdicts.

Every text gets counts by built-in functions. Rule failures are added up per host; each host's
failure rates are shrunk by a beta prior fitted to all hosts by the method of moments, so that a
host with few documents is judged mostly by what is usual. Hosts whose shrunk rate passes the
limit are refused, and that verdict is joined back to their documents.

All of it is DataFrame operations. Null text has no words and fails; a null host is a host of
its own. Repeated rows are judged and counted like any others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmill.operators.joins import left_join_unique
from trailmill.session import written

WORD_BREAK = r"[\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
MAX_HOST_RATE = 0.8
# Rules that only count for the host; each says how a document fails.
HOST_RULES = {
    "base": "n_words < 50 OR 100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > word_chars",
    "lines": "10 * n_dup_lines > 5 * n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 15 * n_words",
}


def _repeated(windows: Column) -> Column:
    """Words covered by windows that occur twice or more.

    ``windows`` are structs (hash, place). Sorted by hash, equal windows are neighbours; the
    places of all such windows, sorted again, cover three words each less what they share.
    """
    count = F.size(windows)
    pairs = F.arrays_zip(
        F.slice(windows, 1, F.greatest(count - 1, F.lit(0))).alias("a"),
        F.slice(windows, 2, F.greatest(count - 1, F.lit(0))).alias("b"),
    )
    equal = F.filter(pairs, lambda p: p["a"]["hash"] == p["b"]["hash"])
    return F.sort_array(
        F.array_distinct(
            F.concat(
                F.transform(equal, lambda p: p["a"]["place"]),
                F.transform(equal, lambda p: p["b"]["place"]),
            )
        )
    )


def text_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with n_words, word_chars, n_symbols, n_lines, n_dup_lines,
    n_repeat_words (long)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(whole, WORD_BREAK, -1), lambda w: w != "")
    bare = F.translate(whole, WHITE, "")
    lines = F.filter(F.split(whole, "\n", -1), lambda x: F.translate(x, WHITE, "") != "")
    kept = [F.col(f"`{c}`") for c in docs.columns if c != text]
    first = docs.select(
        *kept,
        words.alias("__words"),
        lines.alias("__lines"),
        F.length(bare).cast("long").alias("word_chars"),
        (F.length(bare) - F.length(F.translate(bare, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    n = F.size("__words")
    # three shifted views side by side, so that a window is read without any index arithmetic
    triples = F.arrays_zip(
        F.slice("__words", 1, F.greatest(n - 2, F.lit(0))).alias("a"),
        F.slice("__words", 2, F.greatest(n - 2, F.lit(0))).alias("b"),
        F.slice("__words", 3, F.greatest(n - 2, F.lit(0))).alias("c"),
    )
    hashes = F.transform(triples, lambda t: F.xxhash64(t["a"], t["b"], t["c"]))
    second = first.withColumn("__hashes", hashes)
    windows = F.sort_array(
        F.transform("__hashes", lambda h, i: F.struct(h.alias("hash"), i.alias("place")))
    )
    some = F.size(F.array_distinct("__hashes")) < F.size("__hashes")
    third = second.withColumn("__windows", F.when(some, windows))
    fourth = third.withColumn("__places", _repeated(F.col("__windows")))
    gaps = F.zip_with(
        F.slice("__places", 1, F.greatest(F.size("__places") - 1, F.lit(0))),
        F.slice("__places", 2, F.greatest(F.size("__places") - 1, F.lit(0))),
        lambda a, b: F.least(b - a, F.lit(3)),
    )
    covered = F.aggregate(gaps, F.lit(3), lambda sum, x: sum + x)
    return fourth.select(
        *kept,
        n.cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("__places") > 0, covered).otherwise(0).cast("long").alias("n_repeat_words"),
    )


def host_rates(counts: DataFrame, host: str) -> DataFrame:
    """(host, one shrunk failure rate per rule); one row per host.

    The prior of a rule is Beta(a, b) with the mean and variance of the hosts' raw rates. Where
    all hosts have the same rate the prior is worth as much as an average host's documents.
    """
    per_host = counts.groupBy(host).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.expr(rule).cast("long")).alias(f"fail_{name}") for name, rule in HOST_RULES.items()],
    )
    rate = lambda name: F.col(f"fail_{name}") / F.col("n")
    moments = per_host.agg(
        F.avg("n").alias("usual"),
        *[F.avg(rate(name)).alias(f"mean_{name}") for name in HOST_RULES],
        *[F.var_pop(rate(name)).alias(f"var_{name}") for name in HOST_RULES],
    )
    joined = per_host.join(F.broadcast(moments))  # moments is a single row
    shrunk = []
    for name in HOST_RULES:
        mean, variance = F.col(f"mean_{name}"), F.col(f"var_{name}")
        fitted = mean * (1 - mean) / variance - 1
        weight = F.when((variance > 0) & (fitted > 0), fitted).otherwise(F.col("usual"))
        value = (F.col(f"fail_{name}") + weight * mean) / (F.col("n") + weight)
        shrunk.append(value.alias(f"rate_{name}"))
    return joined.select(host, *shrunk)


def judge_quality(
    docs: DataFrame,
    text: str = "text",
    host: str = "source",
    keep: tuple[str, ...] = ("doc_id",),
    max_host_rate: float = MAX_HOST_RATE,
) -> DataFrame:
    """``keep``, the counts, ``base_failed``, ``host_refused`` and ``kept`` of every document."""
    rows = docs.select(
        *keep, F.coalesce(F.col(host).cast("string"), F.lit("")).alias("__host"), F.col(text)
    )
    counts = written(text_counts(rows, text), "quality")
    rates = host_rates(counts, "__host")
    refused = F.greatest(*[F.col(f"rate_{name}") for name in HOST_RULES]) > max_host_rate
    verdicts = written(rates.select("__host", refused.alias("host_refused")), "verdicts")
    failed = F.expr(HOST_RULES["base"])
    # a host may hold a third of all documents
    return left_join_unique(counts, verdicts, "__host").select(
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & ~F.col("host_refused")).alias("kept"),
        "host_refused",
    )
