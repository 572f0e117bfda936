"""Byte-level BPE as a tree reduction of a monoid.

One function, ``reduced``, halves and joins on three levels.

* A text is halved anywhere. A single space between two characters that are no white space always
  begins a match, and between matches no merge happens, so such a space is a proven boundary. A
  part keeps the ids between its first and its last boundary, and as text what lies outside them:
  its head and its tail. Joining two parts encodes the tail of the left with the head of the right,
  a window that has grown on both sides to the nearest boundary; all ids outside are final.
  Parts without a boundary are joined as text.
* Within one match, halves are encoded recursively and joined: a window of tokens around the seam
  is encoded again, and it grows until both its ends fit the tokens outside. Two neighbouring
  tokens fit if encoding their bytes together gives just the two; a list whose neighbours all fit
  is the encoding of its bytes, so everything outside the window is final. Joining costs the
  window, not the match. Matches of at most LEAF_BYTES bytes are merged plainly.
* Ids are halved too; decoding concatenates the bytes of the halves up the tree.

Ranks come from a vocabulary file given by path, which every machine must have installed; only
the ranks' path travels with the plan. Python workers keep results of frequent stretches between
spaces in a bounded memo. No shuffle: a row is encoded where it is read.

Null text is encoded as an empty one: no ids. Repeated rows are encoded each for itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from trailmill.llm.batches import small_batches, tidy

LEAF_BYTES = 16
LEAF_CHARS = 8192
LEAF_IDS = 8192
WINDOW = 2
MEMO_ENTRIES = 60_000
STRETCHES = 150_000
OUT_BYTES = 8 << 20


NEVER = 1 << 60
SENTENCE_MARKS = (".", ",")


def reduced(start: int, end: int, size: int, leaf: Callable, joined: Callable):
    """Leaves of at most ``size`` places from ``start`` to ``end``, joined up a tree of halves."""
    if end - start <= size:
        return leaf(start, end)
    half = (start + end) // 2
    return joined(reduced(start, half, size, leaf, joined), reduced(half, end, size, leaf, joined))


def _merged(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the pair of least rank, the leftmost of equals, until none is left."""
    rank_of = ranks.get
    parts = [data[i : i + 1] for i in range(len(data))]
    pairs = [rank_of(data[i : i + 2], NEVER) for i in range(len(data) - 1)]
    while pairs:
        best = min(pairs)
        if best == NEVER:
            break
        at = pairs.index(best)
        parts[at] += parts.pop(at + 1)
        del pairs[at]
        if at < len(pairs):
            pairs[at] = rank_of(parts[at] + parts[at + 1], NEVER)
        if at:
            pairs[at - 1] = rank_of(parts[at - 1] + parts[at], NEVER)
    return [ranks[part] for part in parts]


class _Memo:
    """Two generations of results: what was not asked for while the younger one filled is dropped."""

    def __init__(self, entries: int):
        self.entries, self.young, self.old = entries, {}, {}

    def get(self, key):
        value = self.young.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self.young) >= self.entries:
            self.old, self.young = self.young, {}
        self.young[key] = value


def piece_encoder(ranks: dict[bytes, int]) -> Callable[[bytes], list[int]]:
    """Encoder of one match of the pattern. Leaves and seams are remembered: they repeat."""
    tokens = {rank: data for data, rank in ranks.items()}
    leaves, seams, windows = _Memo(MEMO_ENTRIES), _Memo(MEMO_ENTRIES), _Memo(MEMO_ENTRIES)

    def fits(left: int, right: int) -> bool:
        pair = (left, right)
        known = seams.get(pair)
        if known is None:
            known = _merged(tokens[left] + tokens[right], ranks) == [left, right]
            seams.put(pair, known)
        return known

    def again(ids: list[int]) -> list[int]:
        key = tuple(ids)
        known = windows.get(key)
        if known is None:
            known = _merged(b"".join([tokens[i] for i in ids]), ranks)
            if len(key) <= 4 * WINDOW:
                windows.put(key, known)
        return known

    def joined(left: list[int], right: list[int]) -> list[int]:
        if fits(left[-1], right[0]):
            return left + right
        size = WINDOW
        while True:
            a, b = left[-size:], right[:size]
            before, after = left[: len(left) - len(a)], right[len(b) :]
            middle = again(a + b)
            if (not before or fits(before[-1], middle[0])) and (not after or fits(middle[-1], after[0])):
                return before + middle + after
            size *= 2

    def tree(data: bytes) -> list[int]:
        def leaf(start: int, end: int) -> list[int]:
            part = data[start:end]
            known = leaves.get(part)
            if known is None:
                known = _merged(part, ranks)
                leaves.put(part, known)
            return known

        return reduced(0, len(data), LEAF_BYTES, leaf, joined)

    def encode(data: bytes) -> list[int]:
        whole = ranks.get(data)
        if whole is not None:
            return [whole]
        return _merged(data, ranks) if len(data) <= LEAF_BYTES else tree(data)

    return encode


def read_ranks(path: str) -> dict[bytes, int]:
    import base64

    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def text_encoder(ranks: dict[bytes, int], pattern: str) -> Callable[[str], bytes]:
    """Encoder of a text; ids are packed as 32-bit integers.

    Stretches from one boundary to the next are encoded alone and remembered: they repeat. A part of
    a text is (head, ids, tail); ids are None if it has no boundary, then all of it is its head.
    """
    import re
    from array import array

    import regex

    split = regex.compile(pattern).findall
    cut = re.compile(r"(?<=\S) (?=\S)").split
    piece = piece_encoder(ranks)
    memo = _Memo(STRETCHES)

    def stretch(text: str) -> bytes:
        """Ids of a text as matches of the pattern."""
        if text[1:].isalpha() and text[0] == " ":  # one match
            return array("i", piece(text.encode())).tobytes()
        ids = array("i")
        for match in split(text):
            ids.extend(piece(match.encode()))
        return ids.tobytes()

    def looked_up(key: str) -> bytes:
        packed = memo.get(key)
        if packed is None:
            bare = key[:-1]
            if key[-1] in SENTENCE_MARKS and bare.isalpha():  # two matches
                packed = looked_up(bare) + stretch(key[-1])
            else:
                packed = stretch(" " + key)
            memo.put(key, packed)
        return packed

    def stretches(keys: list[str]) -> bytes | None:
        """Ids of stretches, each with the space before it; None if a space is no boundary."""
        out, frequent = [], memo.young.get
        for key in keys:
            packed = frequent(key)
            if packed is None:
                if bordered(key):  # white space beside a space; the memo holds no such key
                    return None
                packed = looked_up(key)
                frequent = memo.young.get
            out.append(packed)
        return b"".join(out)

    def part(text: str) -> tuple[str, bytes | None, str]:
        keys = text.split(" ")
        ids = None
        if not (bordered(keys[0]) or bordered(keys[-1])):
            ids = stretches(keys[1:-1])
        if ids is None:
            keys = cut(text)
            ids = stretches(keys[1:-1])
        return (keys[0], ids, " " + keys[-1]) if len(keys) > 1 else (text, None, "")

    def seam(text: str) -> bytes:
        """Ids of a window from one boundary to another."""
        if not text:
            return b""
        key = text[1:]
        if text[0] == " " and " " not in key and not bordered(key):
            return looked_up(key)
        first, *others = cut(text)
        return b"".join([stretch(first), *[stretch(" " + key) for key in others]])

    def joined(left: tuple, right: tuple) -> tuple:
        if left[1] is None and right[1] is None:
            return part(left[0] + right[0])
        if left[1] is None:
            head, ids, tail = part(left[0] + right[0])
            return (head, right[1], right[2]) if ids is None else (head, ids + seam(tail) + right[1], right[2])
        if right[1] is None:
            head, ids, tail = part(left[2] + right[0])
            return (left[0], left[1], head) if ids is None else (left[0], left[1] + seam(head) + ids, tail)
        return left[0], left[1] + seam(left[2] + right[0]) + right[1], right[2]

    def encode(text: str) -> bytes:
        head, ids, tail = reduced(0, len(text), LEAF_CHARS, lambda start, end: part(text[start:end]), joined)
        return seam(head) + (ids or b"") + seam(tail)

    def bordered(key: str) -> bool:
        return not key or key[0].isspace() or key[-1].isspace()

    return encode


def ids_decoder(ranks: dict[bytes, int]) -> Callable:
    """Decoder of an array of ids: the tokens' bytes, concatenated up the tree."""
    tokens = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token

    def decoded(ids) -> bytes:
        def leaf(start: int, end: int) -> bytes:
            return b"".join([tokens[i] for i in ids[start:end].tolist()])

        return reduced(0, len(ids), LEAF_IDS, leaf, bytes.__add__)

    return decoded


def _installed(vocabulary: str, pattern: str | None) -> tuple[str, str]:
    import os

    if pattern is None or not os.path.isabs(vocabulary):
        import public_tokenizers

        pattern = public_tokenizers.PATTERN if pattern is None else pattern
        vocabulary = vocabulary if os.path.isabs(vocabulary) else public_tokenizers.path(vocabulary)
    return vocabulary, pattern


VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def encode(
    docs: DataFrame,
    text: str = "text",
    ids: str = "ids",
    vocabulary: str = VOCABULARY,
    pattern: str | None = None,
    data: str | None = None,
) -> DataFrame:
    """``docs`` with ``ids`` (array<int>) in place of ``text``.

    With ``data`` the ids are decoded again in the same pass, into a column of that name.

    ``vocabulary`` is a rank file: an absolute path, or the name of an installed public one.
    """
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in (text, ids)]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        path, rule = _installed(vocabulary, pattern)
        ranks = read_ranks(path)
        encoder, decoder = text_encoder(ranks, rule), ids_decoder(ranks)
        for batch in batches:
            packed, size, start = [], 0, 0
            texts = batch.column(len(kept))
            for row in range(batch.num_rows):
                text = texts[row].as_py()
                packed.append(encoder(text) if text else b"")
                size += len(packed[-1])
                if size > OUT_BYTES or row + 1 == batch.num_rows:  # small batches, little memory
                    ends = np.cumsum([0, *map(len, packed)]) // 4
                    flat = np.frombuffer(b"".join(packed), np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
                    part = batch.slice(start, len(packed)).columns[: len(kept)]
                    columns = [*part, lists]
                    if data is not None:
                        whole = [decoder(np.frombuffer(one, np.int32)) for one in packed]
                        columns.append(pa.array(whole, pa.binary()))
                    yield pa.RecordBatch.from_arrays(columns, names)
                    packed, size, start = [], 0, row + 1

    fields = [*rows.drop(text).schema, StructField(ids, ArrayType(IntegerType()))]
    if data is not None:
        fields.append(StructField(data, BinaryType()))
    names = [field.name for field in fields]
    return rows.mapInArrow(tidy(run), StructType(fields))


def decode(
    docs: DataFrame,
    ids: str = "ids",
    data: str = "data",
    vocabulary: str = VOCABULARY,
) -> DataFrame:
    """``docs`` with the decoded bytes as ``data``; ``ids`` stays. Null ids give empty bytes."""
    kept = [c for c in docs.columns if c != data]
    at = kept.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, _ = _installed(vocabulary, "")
        decoder = ids_decoder(read_ranks(path))
        for batch in batches:
            lists = batch.column(at)
            whole = []
            for row in range(batch.num_rows):
                value = lists[row].values  # one text's ids at a time
                whole.append(b"" if value is None else decoder(value.to_numpy()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(whole, pa.binary())], [*kept, data]
            )

    rows = docs.select(*[F.col(f"`{c}`") for c in kept])
    return rows.mapInArrow(tidy(run), StructType([*rows.schema, StructField(data, BinaryType())]))


def token_digests(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, hash of the ids, hash of the decoded bytes of every document."""
    rows = docs.select("doc_id", "text")
    return encode(rows, vocabulary=vocabulary, data="data").select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("data", 256).alias("decoded_sha256"),
    )
