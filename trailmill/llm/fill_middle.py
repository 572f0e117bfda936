"""Fill-in-the-middle training texts: prefix, suffix and middle of a text change places.

A text is a run of units, by default code points. One match of ``(unit)*`` against the whole text,
by a regular-expression library that keeps every repetition of a group, gives the ends of all
units: their number is n, and the offset after k units is the k-th end. So the two cuts are looked
up; nothing steps through the text in Python. The numbers that choose cuts and form come from the
hash of seed and document id, so a repeated task gives the same text.

Every row is handled by itself: there is no shuffle, and a lost task repeats its own rows. Texts
of single code points are matched in stretches of at most STRETCH, which bounds the memory for
captures at about 60 MB; other units see their whole text at once, as a cut could split one.

Null text counts as empty and stays plain, as does a text that is no run of units (n is 0) or holds
a sentinel. A null id hashes as an empty one. Repeated rows give equal result rows. Other columns
of the input are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmill.llm.batches import small_batches

CODE_POINT = "(?s:.)"
STRETCH = 1 << 20
SENTINELS = ("<P>", "<S>", "<M>")
OUT_BYTES = 4 << 20


def unit_ends(unit: str, stretch: int | None) -> Callable[[str], Sequence[int] | None]:
    """A function from a text to the end offset of each of its units; None if it is no run of them."""
    import regex

    units = regex.compile(f"({unit})*")

    def ends(text: str) -> Sequence[int] | None:
        if stretch is None or len(text) <= stretch:
            match = units.fullmatch(text)
            return match.ends(1) if match else None
        found = array("q")
        for at in range(0, len(text), stretch):
            found.extend(units.fullmatch(text, at, at + stretch).ends(1))
        return found

    return ends


def _numbers(seed: int, doc_id: object) -> list[int]:
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digits[i : i + 8], 16) for i in (0, 8, 16, 24)]


def check_sentinels(sentinels: Sequence[str]) -> None:
    """Sentinels are found again only if none can begin inside another one."""
    if len(set(sentinels)) != 3 or not all(sentinels):
        raise ValueError("three different sentinels are needed")
    if any(s[0] in other[1:] for s in sentinels for other in sentinels):
        raise ValueError("a sentinel's first character must not occur within a sentinel")
    if any(s.startswith(other) for s in sentinels for other in sentinels if s != other):
        raise ValueError("no sentinel may begin with another one")


def fill_in_middle(
    docs: DataFrame,
    unit: str = CODE_POINT,
    seed: int = 1,
    moved_percent: int = 90,
    spm_percent: int = 20,
    sentinels: Sequence[str] = SENTINELS,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of every document.

    ``form`` is plain (the text itself), psm (prefix, suffix, middle) or spm (suffix, prefix,
    middle); ``n`` counts units, ``prefix_chars`` and ``middle_chars`` code points (null if plain).
    """
    check_sentinels(sentinels)
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    stretch = STRETCH if unit == CODE_POINT else None
    before, after, middle_mark = sentinels
    fields = [
        rows.schema["doc_id"],
        T.StructField("n", T.LongType()),
        T.StructField("form", T.StringType()),
        T.StructField("prefix_chars", T.LongType()),
        T.StructField("middle_chars", T.LongType()),
        T.StructField("output", T.StringType()),
    ]
    names = [field.name for field in fields]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends_of = unit_ends(unit, stretch)

        def moved(key: object, whole: str) -> tuple:
            ends = ends_of(whole)
            n = len(ends or ())
            h1, h2, h3, h4 = _numbers(seed, key)
            if not n or h3 % 100 >= moved_percent or any(s in whole for s in sentinels):
                return n, "plain", None, None, whole
            low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
            one, two = (ends[k - 1] if k else 0 for k in (low, high))
            prefix, middle, suffix = whole[:one], whole[one:two], whole[two:]
            if h4 % 100 < spm_percent:
                output = after + suffix + before + prefix + middle_mark + middle
                return n, "spm", one, two - one, output
            return n, "psm", one, two - one, before + prefix + after + suffix + middle_mark + middle

        for batch in batches:
            ids, texts = batch.columns
            start, size, held = 0, 0, []
            for row in range(batch.num_rows):
                held.append(moved(ids[row].as_py(), texts[row].as_py() or ""))
                size += len(held[-1][-1])
                if size > OUT_BYTES or row + 1 == batch.num_rows:
                    columns = [pa.array(c, k) for c, k in zip(zip(*held), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([ids.slice(start, len(held)), *columns], names)
                    start, size, held = row + 1, 0, []

    return rows.mapInArrow(run, T.StructType(fields))


def restored(
    form: Column | str = "form", output: Column | str = "output", sentinels: Sequence[str] = SENTINELS
) -> Column:
    """The original text, from a text of ``fill_in_middle`` and its form."""
    form, output = (F.col(c) if isinstance(c, str) else c for c in (form, output))
    before, after, middle_mark = sentinels

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        start = F.lit(len(first) + 1)
        cut = F.position(F.lit(second), output, start)
        last = F.position(F.lit(middle_mark), output, cut)
        return (
            F.substr(output, start, cut - start),
            F.substr(output, cut + len(second), last - cut - len(second)),
            F.substr(output, last + len(middle_mark)),
        )

    prefix, suffix, middle = parts(before, after)
    late, early, between = parts(after, before)
    return (
        F.when(form == "psm", F.concat(prefix, middle, suffix))
        .when(form == "spm", F.concat(early, between, late))
        .otherwise(output)
    )


def middle_digests(docs: DataFrame) -> DataFrame:
    """Counts, form and hashes of the moved and of the restored text of every document."""
    return fill_in_middle(docs).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(), 256).alias("restored_sha256"),
    )
