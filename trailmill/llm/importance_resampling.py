"""Importance resampling towards a target distribution, with line breaks as segment borders.

A text's features are all runs of 1 to ``max_n`` consecutive words, hashed into buckets. A bucket's
gain is the log ratio of its smoothed shares in the target and in the corpus; a document's weight
is the mean gain of its features. Documents are drawn by weight plus Gumbel noise from their id, so
a draw without replacement is a plain ranking that any task repeats alike.

Line breaks are separators, so a text is a sequence of lines. Lines repeat: each different line is
split, hashed and counted once, and its counts are multiplied by its occurrences in the corpus.
Its sum of gains is found once as well and handed to all documents that hold it. Runs of words that
reach over a line's end belong to no line; they are made per document from the last words of one
line and the first of the next, and added separately.

Line texts move once, reduced per task before; everything else is hashes and numbers. Lines that fill a
large share of the corpus are spread over tasks when their gains go back to the documents. The
driver sees one gain per bucket and counts.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased. Null and empty texts have no
features and weight 0. Every row is a document of its own, repeated rows and ids too; ties go to
the smaller id, null last, and then by place in the input. Columns of any other name are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmill.llm.batches import small_batches
from trailmill.operators.joins import left_join_unique
from trailmill.operators.numbering import numbered
from trailmill.session import discard, written

_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
OUT_NUMBERS = 1 << 20


def words_of(line: bytes) -> list[bytes]:
    """Words of UTF-8 text: letters, digits and all bytes of wider characters."""
    return line.translate(_WORD_BYTES).split()


def runs_within(words: list[bytes], max_n: int) -> list[bytes]:
    runs = list(words)
    for n in range(2, max_n + 1):
        runs += [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
    return runs


def runs_across(text: bytes, max_n: int) -> list[bytes]:
    """Runs of up to ``max_n`` words that begin in one line and end in a later one."""
    runs: list[bytes] = []
    tail: list[bytes] = []
    for line in text.split(b"\n"):
        words = words_of(line)
        near = tail + words[: max_n - 1]
        for start in range(len(tail)):
            for end in range(len(tail) + 1, min(start + max_n, len(near)) + 1):
                runs.append(b" ".join(near[start:end]))
        tail = (tail + words)[-(max_n - 1) :] if max_n > 1 else []
    return runs


def _buckets(runs: list[bytes], buckets: int) -> np.ndarray:
    return (np.fromiter(map(zlib.crc32, runs), np.int64, len(runs)) % buckets).astype(np.int32)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))


def _replaced(
    df: DataFrame, column: str, kinds: str, made: Callable[[bytes], tuple], names: list[str]
) -> DataFrame:
    """``df`` with a binary column replaced by numbers and one list of buckets made from it.

    ``made`` gives the numbers and then the list; ``kinds`` is their schema.
    """
    kept = [c for c in df.columns if c != column]
    rows = df.select(*kept, column)
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.drop(column).schema), kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(kept))
            start, size, held = 0, 0, []
            for row in range(batch.num_rows):
                held.append(made(texts[row].as_py() or b""))
                size += len(held[-1][-1])
                if size > OUT_NUMBERS or row + 1 == batch.num_rows:
                    *numbers, lists = zip(*held, strict=True)
                    columns = [
                        *batch.slice(start, len(held)).columns[: len(kept)],
                        *(pa.array(one, pa.int64()) for one in numbers),
                        _lists(list(lists)),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, [*kept, *names])
                    start, size, held = row + 1, 0, []

    return rows.mapInArrow(run, schema)


def _key(line: Column) -> Column:
    """128 bits: two chains of a 64-bit hash."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


class Features:
    """The different lines and the rows of a corpus, written as two tables."""

    def __init__(self, docs: DataFrame, max_n: int, buckets: int, doc_id: str | None, text: str):
        small_batches(docs.sparkSession)
        texts = F.coalesce(F.col(f"`{text}`"), F.lit(""))
        lines = F.filter(F.split(texts, "\n", -1), lambda line: line != "")
        different = (
            docs.select(F.explode(lines).alias("line")).groupBy("line").agg(F.count(F.lit(1)).alias("times"))
        )

        def counted(line: bytes) -> tuple:
            words = words_of(line)
            return len(words), _buckets(runs_within(words, max_n), buckets)

        self.segments = written(
            _replaced(
                different.select(_key(F.col("line")).alias("key"), "times", F.col("line").cast("binary").alias("line")),
                "line", "n_words long, buckets array<int>", counted, ["n_words", "buckets"],
            ).where("n_words > 0"),
            "segments",
        )
        rows = docs.select(
            (F.lit(None).cast("long") if doc_id is None else F.col(f"`{doc_id}`")).alias("doc_id"),
            F.monotonically_increasing_id().alias("row"),
            F.transform(lines, _key).alias("keys"),
            texts.cast("binary").alias("text"),
        )
        if max_n > 1:
            rows = _replaced(
                rows, "text", "across array<int>", lambda t: (_buckets(runs_across(t, max_n), buckets),), ["across"]
            )
        else:  # a single word reaches over no line's end
            rows = rows.drop("text").withColumn("across", F.array().cast("array<int>"))
        self.rows = written(rows, "rows")

    def counts(self) -> DataFrame:
        """(bucket, n) over the whole corpus: counts of a line times its occurrences, and the runs across."""
        inside = self.segments.select(F.explode("buckets").alias("bucket"), "times")
        across = self.rows.select(F.explode("across").alias("bucket"), F.lit(1).cast("long").alias("times"))
        return inside.unionAll(across).groupBy("bucket").agg(F.sum("times").alias("n"))

    def discard(self) -> None:
        discard(self.segments, self.rows)


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of all buckets: thousandths of the log ratio of smoothed shares, floored."""
    spark = corpus.sparkSession
    one = corpus.select("bucket", F.col("n").alias("s"))
    two = target.select("bucket", F.col("n").alias("t"))
    both = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(one, "bucket", "left")
    both = written(both.join(two, "bucket", "left").fillna(0), "buckets")
    # a table of one row per bucket
    total = both.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    over = (F.col("t") + 1).cast("double") * float(total["s"] + buckets)
    under = (F.col("s") + 1).cast("double") * float(total["t"] + buckets)
    return both.select("bucket", F.floor(F.log(over / under) * 1000).alias("gain"))


def _with_gain(df: DataFrame, column: str, gains: np.ndarray, n: str, gain: str) -> DataFrame:
    """``df`` with the number of a list's buckets and the sum of their gains in place of the list."""
    kept = [c for c in df.columns if c != column]
    rows = df.select(*kept, column)
    names = [*kept, n, gain]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.drop(column).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(kept))
            ends = lists.offsets.to_numpy().astype(np.int64)
            sums = np.concatenate(([0], np.cumsum(gains[lists.values.to_numpy()], dtype=np.int64)))
            numbers = [pa.array(np.diff(ends)), pa.array(sums[ends[1:]] - sums[ends[:-1]])]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *numbers], names)

    return rows.mapInArrow(run, f"{fields}, {n} long, {gain} long")


def document_weights(corpus: Features, gains: np.ndarray) -> DataFrame:
    """(row, doc_id, n_words, n_features, weight) of every row."""
    segments = written(_with_gain(corpus.segments.drop("times"), "buckets", gains, "n", "gain"), "gains")
    lines = corpus.rows.select("row", F.explode("keys").alias("key"))
    counts = corpus.segments.select(F.xxhash64("key").alias("hash"), F.col("times").alias("n"))
    # gains of lines grow with the corpus, so they are never broadcast
    held = left_join_unique(lines, segments, "key", counts, max_rows=0)
    sums = held.groupBy("row").agg(F.sum("n_words").alias("n_words"), F.sum("n").alias("n"), F.sum("gain").alias("gain"))
    rows = _with_gain(corpus.rows.drop("keys"), "across", gains, "across_n", "across_gain")
    summed = rows.join(sums, "row", "left").select(
        "row", "doc_id",
        F.coalesce("n_words", F.lit(0)).alias("n_words"),
        (F.coalesce("n", F.lit(0)) + F.col("across_n")).alias("n_features"),
        (F.coalesce("gain", F.lit(0)) + F.col("across_gain")).alias("total"),
    )
    floored = F.expr("CASE WHEN n_features = 0 THEN 0L ELSE (total - pmod(total, n_features)) DIV n_features END")
    weights = written(summed.select("row", "doc_id", "n_words", "n_features", floored.alias("weight")), "weights")
    discard(segments)
    return weights


def noise(seed: int, doc_id: str = "doc_id") -> Column:
    """Thousandths of Gumbel noise from the hash of seed and id."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")))
    digits = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.log(-F.log((digits + 0.5) / F.lit(4294967296.0))) * -1000)


def resample(
    docs: DataFrame,
    target: DataFrame,
    max_n: int = 1,
    buckets: int = 10_000,
    percent: int = 10,
    min_words: int = 20,
    seed: int = 2024,
    doc_id: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document.

    Of the documents with ``min_words`` words or more, ``percent`` in a hundred are drawn; ``rank``
    is 1, 2, 3 ... by falling score, null for the others.
    """
    corpus = Features(docs, max_n, buckets, doc_id, text)
    wanted = Features(target, max_n, buckets, None, target_text)
    table = bucket_gains(corpus.counts(), wanted.counts(), buckets).collect()  # one row per bucket
    gains = np.zeros(buckets, np.int64)
    for row in table:
        gains[row["bucket"]] = row["gain"]
    weights = document_weights(corpus, gains)
    corpus.discard()
    wanted.discard()
    able = F.col("n_words") >= min_words
    drawn = weights.where(able).count() * percent // 100
    scored = weights.withColumns({"able": able, "score": F.col("weight") + noise(seed)})
    order = [F.col("able").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    ranked = numbered(scored, order, "place", "ranks")
    rank = F.when(F.col("able") & (F.col("place") <= drawn), F.col("place"))
    return ranked.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
