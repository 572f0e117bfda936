"""Benchmark items in documents, also with changed numbers, names, units and words.

Words become a template: numbers, units and names (capitalised words inside a sentence) are typed
placeholders, other words lose case and outer punctuation; a glued unit (``3km``) is a number and a
unit. A capital that begins a sentence may be a name or not, and names may have several words, so
every text is read twice: word by word, and with such capitals as names and neighbouring names as
one slot. Windows of WINDOW template words of the items are looked up in the documents by a hash
join, reading by reading.

Matches of one document and item have a shift: word of the document less word of the item. Shifts
no further apart than DRIFT words, or a quarter of the item if that is more, form a chain, so words
put in, left out or replaced do not split a copy. A chain is a leak if its matches cover enough of
the item's words and its slots are consistent: the same value in the item always meets the same
value in the document, and different values different ones. In a chain that is not a leak every
single shift is judged in the same way.

Two things keep the work in proportion where templates say little. A window in which fewer than
MIN_LITERAL of WINDOW words are no slots (a table of numbers) is hashed with its values: a copy is
found, other numbers are no match. Windows of one row that repeat within half a window (a repeated
row of numbers, word or phrase) are one run with all its places and values; two runs meet twice,
aligned at their beginnings and at their ends, not place by place.

A bounded bit table of the items' window hashes lets only likely windows leave a task; the join
decides exactly (64-bit hashes). Documents are never shuffled, only their matching windows.

A name at the edge of an item that stands beside another name in the document is read as one longer
name there. Windows further inside still match; an item of about one window can be missed.

Null and empty texts match nothing. Items shorter than a window are matched by one window of
their own length, but not below MIN_WORDS words. Rows, of documents and of items, are told apart by
id and text: different texts of one id, or without id, are matched and reported each for itself;
rows equal in both are reported once. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmill.llm.batches import small_batches, tidy
from trailmill.llm.shingles import mixed
from trailmill.session import written

WINDOW = 8
MIN_WORDS = 5
MIN_LITERAL = 3
MIN_COVERED = 0.5
DRIFT = 4
BITS = 1 << 24
MEMO_ENTRIES = 150_000
PIECE = 1 << 18  # characters of texts that are read at once
# Unit words.
UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg lb oz ml l gal s sec min h hr hour hours minute minutes second "
    "seconds day days week weeks month months year years meter meters metre metres kilometer "
    "kilometers kilometre kilometres mile miles foot feet inch inches gram grams kilogram kilograms "
    "pound pounds liter liters litre litres dollar dollars euro euros cent cents percent usd eur "
    "degree degrees mph kmh watt watts volt volts byte bytes kb mb gb".split()
)
NUMBER, UNIT, NAME = 1, 2, 3
GLUED = 3  # kind of a single word; names are told by their place
BOTH, PLAIN, NAMED = 0, 1, 2  # readings; BOTH: the two are the same


def text_codes():
    """A function from texts to the codes of their readings and the number of words of each text.

    A reading is (text, reading, codes, values, starts), one entry per code, text after text; a text
    whose two readings are the same is in the first only, as BOTH. Codes are template words, values
    those of slots (0: no slot), starts the word of its text at which a code begins.
    """
    import re

    import xxhash

    number = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*%?").fullmatch
    glued = re.compile(r"([+-]?[$€£]?\d[\d.,:/]*)([^\W\d_]+)").fullmatch

    def hashed(text: str) -> int:
        return xxhash.xxh64_intdigest(text) >> 1 & ~15

    class Memo(dict):
        """Hash of the bare word; its low bits are 1 capitalised, 2 ends a sentence, 4 x kind."""

        def __missing__(self, word: str) -> int:
            halved = None
            if word.isalpha() and word.islower():  # most words: nothing to strip, no digit, no capital
                packed = hashed(word) | (UNIT << 2 if word in UNITS else 0)
            else:
                bare = word.strip(".,;:!?\"'()[]{}«»“”‘’|*#&")
                low = bare.lower()
                kind = UNIT if low in UNITS else 0
                flags = (1 if bare[:1].isupper() else 0) | (2 if word[-1:] in ".!?:" else 0)
                if not bare.isalpha():
                    kind = NUMBER if number(bare) else kind
                    parts = glued(low)
                    if parts and parts[2] in UNITS:
                        kind = GLUED
                        halved = hashed(parts[1]) | NUMBER << 2, hashed(parts[2]) | UNIT << 2 | flags & 2
                packed = hashed(low) | kind << 2 | flags
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            if halved:
                halves[packed] = halved
            self[word] = packed
            return packed

    halves: dict[int, tuple[int, int]] = {}
    memo = Memo()

    def codes(texts: list[str]) -> tuple[list[tuple[np.ndarray, ...]], np.ndarray]:
        words = [text.split() for text in texts]
        n_words = np.fromiter(map(len, words), np.int64, len(words))
        of = np.repeat(np.arange(len(words)), n_words)
        if not len(of):
            return [], n_words
        packed = np.fromiter(map(memo.__getitem__, chain.from_iterable(words)), np.int64, len(of))
        starts = np.arange(len(of)) - (np.cumsum(n_words) - n_words)[of]
        both = np.flatnonzero((packed >> 2 & 3) == GLUED)
        if len(both):
            pairs = [halves[word] for word in packed[both].tolist()]
            packed[both] = [first for first, _ in pairs]
            packed = np.insert(packed, both + 1, [second for _, second in pairs])
            starts = np.insert(starts, both + 1, starts[both])
            of = np.insert(of, both + 1, of[both])
        if len(halves) > MEMO_ENTRIES:
            halves.clear()
            memo.clear()
        bare, kind, flags = packed & ~15, packed >> 2 & 3, packed & 3
        inside = np.append(False, ((flags[:-1] & 2) == 0) & (of[1:] == of[:-1]))
        capital = (kind == 0) & ((flags & 1) == 1)
        plain = np.where(capital & inside, NAME, kind)

        def reading(of: np.ndarray, which, kind: np.ndarray, value: np.ndarray, starts: np.ndarray, bare: np.ndarray):
            return (
                of,
                which,
                np.where(kind > 0, kind, bare).astype(np.uint64),
                np.where(kind > 0, value, 0),
                starts,
            )

        named = np.where(capital, NAME, kind)
        name = named == NAME
        further = np.append(False, name[1:] & name[:-1]) & inside  # no slot across sentences
        differs = np.zeros(len(words), bool)
        differs[of[further | (named != plain)]] = True
        two = differs[of]
        readings = [reading(of, np.where(two, PLAIN, BOTH), plain, bare, starts, bare)]
        if two.any():
            of, bare, named, starts, further = of[two], bare[two], named[two], starts[two], further[two]
            first = np.flatnonzero(~further)
            value = bare[first]
            longer = np.flatnonzero(np.diff(np.append(first, len(bare))) > 1)
            if len(longer):  # the value of a run of names depends on all of them, in order
                step = np.uint64(0x9E3779B97F4A7C15)
                run = np.cumsum(~further) - 1
                place = (np.arange(len(bare)) - first[run]).astype(np.uint64)
                total = np.add.reduceat(mixed(bare.view(np.uint64) + place * step), first)
                value[longer] = (total[longer] >> np.uint64(1)).view(np.int64) | 16
            which = np.full(len(first), NAMED)
            readings.append(reading(of[first], which, named[first], value, starts[first], bare[first]))
        return readings, n_words

    return codes


def word_codes():
    """A function from a text to [(reading, codes, values, starts)] and its number of words."""
    codes_of = text_codes()

    def codes(text: str) -> tuple[list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], int]:
        readings, (n,) = codes_of([text])
        return [(int(which[0]), codes, values, np.append(starts, n)) for _, which, codes, values, starts in readings], int(n)

    return codes


def windows(codes: np.ndarray, width: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hashes of all windows, or of those that begin at the places ``at``."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n if at is None else len(at), width, np.uint64)
    spread = mixed(codes)
    for k in range(width):
        one = spread[k : k + n] if at is None else spread[at + k]
        total = (total * np.uint64(0x9E3779B97F4A7C15)) ^ (total >> np.uint64(29)) ^ one
    return mixed(total)


def window_hashes(codes: np.ndarray, values: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the templates, of the values too where a window is mostly slots."""
    hashes = windows(codes, width)
    slot = values != 0
    least = width - -(-MIN_LITERAL * width // WINDOW) + 1  # so many slots leave too few other words
    if np.count_nonzero(slot) >= least and len(hashes):
        before = np.append(0, np.cumsum(slot))
        mostly = np.flatnonzero(before[width:] - before[:-width] >= least)
        if len(mostly):
            hashes[mostly] = windows(np.where(slot, values.view(np.uint64), codes), width, mostly)
    return hashes


def _pieces(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """The texts in order, with the place of the first: some PIECE characters at a time, or one text."""
    begin = size = 0
    for k, text in enumerate(texts):
        if size and size + len(text) > PIECE:
            yield begin, texts[begin:k]
            begin, size = k, 0
        size += len(text)
    if texts:
        yield begin, texts[begin:]


FOUND = (
    "id long, row long, reading int, hash long, n_words int, width int, at array<int>, end array<int>, "
    "slots array<long>"
)


def _found(widths: list[int] | None, bits: np.ndarray | None):
    """Windows of every row; of items (no bits) all, of documents those the bits let through.

    Without ``widths`` a row has windows of WINDOW words, or of its own length if it is shorter.
    ``at`` and ``end`` count words, also where a slot holds several: one for each place of a run.
    ``slots`` holds the values of the slots, place by place.
    """

    def chosen(hashes: np.ndarray, of: np.ndarray, width: int, sizes: np.ndarray) -> np.ndarray:
        """Places of the windows that lie in one text and count there."""
        at = of[: len(hashes)] == of[width - 1 :]
        if widths is None:
            at &= np.minimum(sizes, WINDOW)[of[: len(hashes)]] == width
        if bits is not None:
            low = hashes & np.uint64(BITS - 1)
            at &= ((bits[low >> np.uint64(3)] >> (low & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
        return np.flatnonzero(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes_of = text_codes()
        for batch in batches:
            rows = []
            ids, keys = batch.column(0), batch.column(1)
            for begin, texts in _pieces([text or "" for text in batch.column(2).to_pylist()]):
                readings, n_words = codes_of(texts)
                for of, which, codes, values, starts in readings:
                    sizes = np.bincount(of, minlength=len(texts))
                    stops = np.cumsum(sizes)
                    for width in widths if widths is not None else range(MIN_WORDS, WINDOW + 1):
                        if len(codes) < width:
                            continue
                        hashes = window_hashes(codes, values, width)
                        # by text and hash: last place, period, places, ends, slots
                        runs: dict[tuple[int, int], tuple] = {}
                        for i in chosen(hashes, of, width, sizes).tolist():
                            k, to = int(of[i]), i + width
                            inside = values[i:to]
                            slots = inside[inside != 0].tolist()
                            n = int(n_words[k])
                            # half a glued word is all of it
                            start, end = int(starts[i]), max(int(starts[to]) if to < stops[k] else n, int(starts[to - 1]) + 1)
                            hashed = int(hashes[i].view(np.int64))
                            last, period, *lists = runs.get((k, hashed), (None, 0))
                            if last is not None and 2 * (i - last) <= width and period in (0, i - last):
                                for held, more in zip(lists, ([start], [end], slots), strict=True):
                                    held.extend(more)
                                runs[k, hashed] = (i, i - last, *lists)
                            else:
                                lists = [start], [end], slots
                                runs[k, hashed] = (i, 0, *lists)
                                row = ids[begin + k].as_py(), keys[begin + k].as_py()
                                rows.append((*row, int(which[i]), hashed, n, width, *lists))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 9
            whole, many = pa.int32(), pa.list_(pa.int32())
            kinds = [pa.int64(), pa.int64(), whole, pa.int64(), whole, whole, many, many, pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["id", "row", "reading", "hash", "n_words", "width", "at", "end", "slots"],
            )

    return run


def _met(of_docs: DataFrame, of_items: DataFrame) -> DataFrame:
    """Runs of equal windows, aligned at their beginnings and, if one is longer, at their ends."""
    d, i = of_docs.alias("d"), of_items.alias("i")
    same = (F.col("d.reading") == F.col("i.reading")) | (F.least("d.reading", "i.reading") == BOTH)
    met = d.join(i, (F.col("d.hash") == F.col("i.hash")) & (F.col("d.width") == F.col("i.width")) & same)
    n_doc, n_item = F.size("d.at"), F.size("i.at")
    aligned = F.when(n_doc == n_item, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    met = met.withColumns({"both": F.least(n_doc, n_item), "late": F.explode(aligned)})
    skip_doc, skip_item = F.col("late") * (n_doc - F.col("both")), F.col("late") * (n_item - F.col("both"))
    each = (F.size("i.slots") / n_item).cast("int")  # slots of one place

    def slots(side: str, skip):
        return F.slice(f"{side}.slots", skip * each + 1, F.col("both") * each)

    return met.select(
        F.col("d.id").alias("doc"),
        F.col("d.row").alias("doc_row"),
        F.col("i.id").alias("item"),
        F.col("i.row").alias("item_row"),
        F.greatest("d.reading", "i.reading").alias("reading"),
        (F.get("d.at", skip_doc) - F.get("i.at", skip_item)).alias("shift"),
        F.get("i.at", skip_item).alias("at"),
        F.get("i.end", skip_item + F.col("both") - 1).alias("end"),
        F.col("i.n_words").alias("n_words"),
        F.arrays_zip(slots("i", skip_item).alias("i"), slots("d", skip_doc).alias("d")).alias("slots"),
    )


def _judged(hits: DataFrame, alignment: list[str]) -> DataFrame:
    """``alignment``, first shift, share of the item's words and ``exact`` of consistent alignments."""
    places = hits.groupBy(*alignment, "at").agg(
        F.max("end").alias("end"), F.min("shift").alias("first"), F.max("n_words").alias("n_words")
    )
    before = F.max("end").over(Window.partitionBy(*alignment).orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    new = F.col("end") - F.greatest("at", F.coalesce("before", F.col("at")))
    covered = (
        places.withColumn("before", before)
        .groupBy(*alignment)
        .agg(
            F.min("first").alias("first"),
            (F.sum(F.greatest(new, F.lit(0))) / F.max("n_words")).alias("covered"),
        )
    )
    pairs = hits.select(*alignment, F.explode("slots").alias("s")).select(
        *alignment, F.col("s.i").alias("item_value"), F.col("s.d").alias("doc_value")
    )
    consistent = pairs.distinct().groupBy(*alignment).agg(
        F.count(F.lit(1)).alias("pairs"),
        F.countDistinct("item_value").alias("item_values"),
        F.countDistinct("doc_value").alias("doc_values"),
        F.bool_and(F.col("item_value") == F.col("doc_value")).alias("exact"),
    )
    joined = [F.col(f"c.{k}").eqNullSafe(F.col(f"s.{k}")) for k in alignment]
    one_to_one = (F.col("pairs") == F.col("item_values")) & (F.col("pairs") == F.col("doc_values"))
    return (
        covered.alias("c")
        .join(consistent.alias("s"), joined, "left")
        .where(F.coalesce(one_to_one, F.lit(True)))
        .select(
            *[F.col(f"c.{k}").alias(k) for k in alignment],
            F.col("c.first").alias("first"),
            F.col("c.covered").alias("covered"),
            F.coalesce("exact", F.lit(True)).alias("exact"),
        )
    )


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    min_covered: float = MIN_COVERED,
) -> DataFrame:
    """doc_id, item_id, shift, covered (share of the item's words), exact, one row per leak.

    ``exact`` is true where every slot has the item's own value.
    """
    small_batches(docs.sparkSession)

    def pick(df: DataFrame, key: str) -> DataFrame:
        row = F.xxhash64(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")), F.col(f"`{text}`"))
        return df.select(F.col(f"`{key}`").cast("long").alias("id"), row.alias("row"), F.col(f"`{text}`").alias("text"))

    of_items = written(pick(items, item_id).mapInArrow(tidy(_found(None, None)), FOUND), "items")
    widths = [r["width"] for r in of_items.select("width").distinct().collect()]  # at most WINDOW
    places = of_items.select(F.col("hash").bitwiseAND(BITS - 1).alias("p")).distinct()
    bits = np.zeros(BITS // 8, np.uint8)  # whatever the number of items
    marks = places.groupBy(F.shiftright("p", 3).alias("byte")).agg(
        F.bit_or(F.expr("shiftleft(1, CAST(p & 7 AS INT))")).alias("mask")
    )
    for row in marks.toLocalIterator():
        bits[row["byte"]] = row["mask"]
    of_docs = pick(docs, doc_id).mapInArrow(tidy(_found(sorted(widths), bits)), FOUND)
    hits = _met(of_docs, of_items)
    pair = ["doc", "doc_row", "item", "item_row"]
    along = Window.partitionBy(*pair).orderBy("shift")
    gap = F.col("shift") - F.lag("shift").over(along)
    far = gap.isNull() | (gap > F.greatest(F.lit(DRIFT), F.floor(F.col("n_words") / 4)))
    start = F.when(far, F.col("shift"))
    chained = hits.withColumn("start", start).withColumn(
        "chain", F.max("start").over(along.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    )
    hits = written(chained.drop("start"), "hits")
    chain = [*pair, "chain"]
    whole = _judged(hits, [*chain, "reading"]).withColumn("shift", F.lit(None).cast("int"))
    single = _judged(hits, [*chain, "reading", "shift"])
    enough = whole.unionByName(single).where(F.col("covered") >= min_covered)
    ruled = F.bool_or(F.col("shift").isNull()).over(Window.partitionBy(*chain))
    return (
        enough.withColumn("ruled", ruled)
        .where(~F.col("ruled") | F.col("shift").isNull())
        .groupBy(*chain, "shift")
        .agg(F.min("first").alias("first"), F.max("covered").alias("covered"), F.bool_or("exact").alias("exact"))
        .select(
            F.col("doc").alias(doc_id),
            F.col("item").alias(item_id),
            F.col("first").alias("shift"),
            F.least("covered", F.lit(1.0)).alias("covered"),
            "exact",
        )
    )


def without_leaks(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``docs`` without those that hold a benchmark item.

    Rows are told apart by a hash of id and text: other texts of an id, and other rows without id,
    stay; rows equal in both stay or go together.
    """
    row = F.xxhash64(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")), F.col(f"`{text}`"))
    rows = docs.select(row.alias("row"), F.col(f"`{text}`").alias("text"))
    leaks = find_leaks(rows, items, "row").select(F.col("row").alias("__leak")).distinct()
    return docs.join(leaks, row == leaks["__leak"], "left_anti")
