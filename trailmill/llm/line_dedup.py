"""Lines that several documents share stay only in the first document that holds them.

Every line has a key: the line without white space at both ends, A-Z in lower case. Keys are
hashed (128 bits) where the text is read; from then on no text moves. The hashes are range-
partitioned, and within a partition sorted by hash, document and position, so one pass over the
sorted rows meets the first occurrence of a key before all others: a running window hands its
document on to the later ones. No second exchange is needed for that. What comes back is small:
per document the words of 64 lines in which some line goes, as a keep bitmap; words in which all
lines stay are left out.

A key that holds more than a task's share of the lines is spread over several slices, each with a
first document of its own; the least of these (one row per slice) is the key's. Counters of hashes
find such keys, and only keys in heavy counters are counted one by one.

Everything is DataFrame operations. Documents are told apart by their id; rows that share an id
are one document, whose lines stay or go together. A null id counts as one document after all
others. Keys shorter than ``least`` code points always stay. Null or empty text is one empty line.
Repeated rows give equal result rows. Other columns of the input are not looked at, whatever their
names. A row's bitmap is found again by id and hash of the text, so it does not depend on the
order in which rows are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmill.operators.joins import left_join_unique
from trailmill.session import discard, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = "\t\n\x0b\f\r "
COUNTERS = 1 << 16
WORD_BITS = 64
_ALL = -1  # a word whose lines all stay


def _lowered(text: Column) -> Column:
    """A-Z in lower case. ``lower`` does that at once where a text is ASCII; elsewhere it does more."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _hashes(value: Column) -> tuple[Column, Column]:
    """128 bits: two chains of a 64-bit hash."""
    return F.xxhash64(value), F.xxhash64(F.lit(1), value)


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _whole(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), whole.alias("text"))


def line_keys(docs: DataFrame, least: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, t1, t2, pos, h1, h2, spread) of every line whose key is long enough."""
    rows = _whole(docs, doc_id, text)
    t1, t2 = _hashes(F.col("text"))
    h1, h2 = _hashes(F.col("key"))
    lines = rows.select(
        "doc_id", t1.alias("t1"), t2.alias("t2"), F.monotonically_increasing_id().alias("spread"),
        F.posexplode(_lines(_lowered(F.col("text")))).alias("pos", "line"),
    )
    keys = lines.withColumn("key", F.btrim("line", F.lit(SPACE))).where(F.length("key") >= least)
    return keys.select("doc_id", "t1", "t2", "pos", h1.alias("h1"), h2.alias("h2"), "spread")


def _slices(keys: DataFrame) -> list[tuple[int, int]]:
    """(h1, number of slices) of keys with more than a task's share of the lines."""
    tasks = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counter = F.pmod("h1", F.lit(COUNTERS))
    sums = keys.groupBy(counter.alias("counter")).agg(F.count(F.lit(1)).alias("n")).collect()
    total = sum(row["n"] for row in sums)  # at most COUNTERS rows, whatever the input
    heavy = [row["counter"] for row in sums if row["n"] * tasks > total]
    if not heavy:
        return []
    few = keys.where(counter.isin(heavy))  # fewer counters than tasks can be that heavy
    counts = few.groupBy("h1").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * tasks > total)
    return [(row["h1"], -(-row["n"] * tasks // total)) for row in counts.collect()]


def _order(column: str) -> Column:
    return F.col(column).asc_nulls_last()


def dropped_lines(keys: DataFrame) -> DataFrame:
    """(doc_id, t1, t2, pos) of the lines that an earlier document holds already."""
    spark = keys.sparkSession
    slices = _slices(keys)
    table = spark.createDataFrame(slices, "h1 long, parts int")
    # fewer rows than shuffle tasks, so broadcasting them is safe at any data size
    sliced = keys.join(F.broadcast(table), "h1", "left").withColumn(
        "slice", F.coalesce(F.pmod(F.col("spread") + F.col("pos"), F.col("parts")), F.lit(0))
    )
    ranged = sliced.drop("spread").repartitionByRange("h1", "h2", "slice")
    running = (
        Window.partitionBy("h1", "h2", "slice")
        .orderBy(_order("doc_id"), "t1", "t2", "pos")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    found = ranged.withColumn("first", F.first(F.struct("doc_id")).over(running))
    if slices:
        found = written(found, "sliced")
        firsts = (
            found.where("parts is not null")
            .groupBy("h1", "h2")
            .agg(F.min(F.struct(F.col("first.doc_id").isNull().alias("none"), "first.doc_id")).alias("least"))
            .select("h1", "h2", F.struct("least.doc_id").alias("least"))
        )
        # rows of the same bound: keys that are heavy
        found = found.join(F.broadcast(firsts), ["h1", "h2"], "left").withColumn(
            "first", F.coalesce("least", "first")
        )
    later = ~F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
    return found.where(later).select("doc_id", "t1", "t2", "pos")


def keep_bitmaps(
    docs: DataFrame, least: int = 10, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, t1, t2, n_dropped, keep) of every different document that loses a line.

    ``t1, t2`` is the hash of the text. ``keep`` maps the number of a word of 64 lines to its bits,
    least first, 1 where the line stays; words whose lines all stay are left out.
    """
    keys = written(line_keys(docs, least, doc_id, text), "lines")
    word = F.floor(F.col("pos") / WORD_BITS).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("pos") % WORD_BITS).cast("int"))
    document = ["doc_id", "t1", "t2"]
    words = dropped_lines(keys).groupBy(*document, word.alias("word")).agg(F.bit_or(bit).alias("gone"))
    bitmaps = words.groupBy(*document).agg(
        F.sum(F.bit_count("gone")).cast("long").alias("n_dropped"),
        # as many entries as the document has words of 64 lines, at most
        F.map_from_entries(F.collect_list(F.struct("word", F.bitwise_not("gone")))).alias("keep"),
    )
    stored = written(bitmaps, "bitmaps")
    discard(keys)
    return stored


def with_bitmaps(
    docs: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, text, n_dropped and keep of every document; null text as empty, keep null if all stay."""
    t1, t2 = _hashes(F.col("text"))
    rows = _whole(docs, doc_id, text).withColumn("row", F.struct("doc_id", t1.alias("t1"), t2.alias("t2")))
    table = bitmaps.select(F.struct("doc_id", "t1", "t2").alias("row"), "n_dropped", "keep")
    return left_join_unique(rows, table, "row").drop("row")


def kept_text(text: Column | str = "text", keep: Column | str = "keep") -> Column:
    """The lines that stay, joined by line breaks."""
    text, keep = (F.col(c) if isinstance(c, str) else c for c in (text, keep))

    def stays(_: Column, pos: Column) -> Column:
        word = F.coalesce(F.try_element_at(keep, F.floor(pos / WORD_BITS).cast("int")), F.lit(_ALL))
        return F.getbit(word.cast("long"), (pos % WORD_BITS).cast("int")) == 1

    return F.when(keep.isNull(), text).otherwise(F.array_join(F.filter(_lines(text), stays), "\n"))


def deduplicated(docs: DataFrame, least: int = 10) -> DataFrame:
    """doc_id, n_lines, n_dropped and hash of the text that stays, for every document; and keep."""
    found = with_bitmaps(docs, keep_bitmaps(docs, least))
    return found.select(
        "doc_id",
        F.size(_lines(F.col("text"))).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2(kept_text(), 256).alias("kept_sha256"),
    )
