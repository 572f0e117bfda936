"""Exact n-gram Jaccard join by a grouped prefix join, down to connected components.

1. Every text becomes its set of shingle hashes. Equal sets are one class.
2. Shingles are ordered, rare ones first; two sets over the limit share one of their first few
   shingles (the prefix). The rare ones are sought among the least hashes of a set, some 2.5 times
   as many as a prefix holds; they come before all others in the order. Their frequencies are
   counted exactly. A class whose prefix consists of shingles that no other class has links with
   nothing, which settles all but copies and texts of common passages. Among the
   classes left, frequencies are counted again, and the prefixes follow from these.
3. Classes with the same size and prefix are one group; a prefix index is built over groups.
4. Group pairs are filtered by size; members are filtered by a parity bitmap, which bounds the
   symmetric difference from below, and verified by exact intersection of their sets.

Only components are asked for, so a crowded group needs no pairs of all its members. For a few
rounds every node of a shared prefix shingle is verified against one node of another component,
the likeliest by bitmap among a few holders drawn of each of its shingles. The components of each
round's links are walked as one node each in the next. What then remains are pairs of members in different components that
still share a prefix shingle; all of these are checked. So no link is lost, and copies in
thousands cost one verification each, not one per pair. A pair is made once, not for every shingle
that it shares, and only where bitmaps of up to 1024 bits allow a link.

Hashes have 64 bits; classes are told apart by 128. Null and empty texts have no shingles and
link with nothing. Repeated rows fall into one class and each keep their result row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmill.llm.batches import small_batches, tidy
from trailmill.llm.graph import components
from trailmill.llm.shingles import mixed, shingle_sets
from trailmill.operators.joins import fits_broadcast, left_join_unique
from trailmill.session import discard, written

BITMAP_WORDS = 4
# at least two rounds; more, up to ROUNDS, while one in WORTH of the pairs tried links
ROUNDS = 3
WORTH = 2
# holders of a shingle that a round proposes to all others
DRAWS = 3
# a pair is made again where so many prefix shingles follow its last shared one
EARLIER = 8
MAX_BROADCAST_IDS = 200_000


def _signature(shingles: np.ndarray) -> bytes:
    """128 bits that tell sets apart: two sums over differently mixed hashes."""
    one = mixed(shingles).sum(dtype=np.uint64)
    two = mixed(shingles ^ np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)
    return one.tobytes() + two.tobytes()


MIDDLE_BITS = 1024


def _wider_bitmap(shingles: np.ndarray, least: int, size: int) -> np.ndarray:
    """Parity bitmap of ``size`` bits for sets over ``least``; smaller bitmaps do for the others."""
    if len(shingles) <= least:
        return np.zeros(0, np.int64)
    odd = np.bincount((shingles >> np.uint64(24)).astype(np.int64) & (size - 1), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _scan(width: int):
    """Per row its id, hash of the text, size and signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = shingle_sets(width)
        for batch in batches:
            sizes, marks = [], []
            for shingles in sets(batch.column(1)):
                sizes.append(len(shingles))
                marks.append(_signature(shingles))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), *batch.columns[2:],
                    pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()),
                ],
                ["doc_id", "t1", "t2", "n", "sig"],
            )

    return run


def _text_hash(text: str) -> list[Column]:
    """128 bits of a text as t1, t2: two chains of a 64-bit hash."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return [F.xxhash64(whole).alias("t1"), F.xxhash64(F.lit(1), whole).alias("t2")]


def _prefix_size(n: int, num: int, den: int) -> int:
    return n - -(-n * num // den) + 1 if n else 0


def _prefixes(width: int, num: int, den: int):
    """Per row its signature, bitmaps, least hashes, and what a prefix needs beyond those."""
    least = min(1 << 64, 5 * (1 << 63) * (den - num) // den)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = shingle_sets(width)
        for batch in batches:
            marks, bits, middle, wide, low, more = [], [], [], [], [], []
            for shingles in sets(batch.column(1)):
                n = len(shingles)
                marks.append(_signature(shingles))
                odd = np.bincount((shingles >> np.uint64(40)).astype(np.int64) % (64 * BITMAP_WORDS),
                                  minlength=64 * BITMAP_WORDS) & 1
                bits.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
                middle.append(_wider_bitmap(shingles, 64 * BITMAP_WORDS, MIDDLE_BITS))
                wide.append(_wider_bitmap(shingles, 2 * MIDDLE_BITS, 1 << int(n).bit_length()))
                k = n if least >> 64 else int(np.searchsorted(shingles, np.uint64(least)))
                low.append(shingles[:k].view(np.int64))  # sets are sorted by hash
                more.append(shingles[k : max(k, _prefix_size(n, num, den))].view(np.int64))
            lists = map(_lists, (bits, middle, wide, low, more))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(marks, pa.binary()), *lists],
                ["doc_id", "sig", "bits", "middle", "wide", "low", "more"],
            )

    return run


def _full_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = shingle_sets(width)
        for batch in batches:
            whole = list(sets(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([_signature(s) for s in whole], pa.binary()),
                    _lists([s.view(np.int64) for s in whole]),
                ],
                ["doc_id", "sig", "shingles"],
            )

    return run


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _of(row: str | Column, name: str) -> Column:
    return F.col(f"{row}.{name}") if isinstance(row, str) else row[name]


def _near(a: str | Column, b: str | Column, num: int, den: int) -> Column:
    """Sizes and bitmaps allow a link between rows ``a`` and ``b``."""
    na, nb = _of(a, "n"), _of(b, "n")
    apart = _apart(a, b)
    return (
        (den * na >= num * nb)
        & (den * nb >= num * na)
        & ((num + den) * apart <= (den - num) * (na + nb))
    )


def _apart(a: str | Column, b: str | Column, name: str = "bits", words: int = BITMAP_WORDS) -> Column:
    """Bits in which two bitmaps differ; null where one is empty."""
    total = F.lit(0)
    for i in range(words):
        total = total + F.bit_count(F.get(_of(a, name), F.lit(i)).bitwiseXOR(F.get(_of(b, name), F.lit(i))))
    return total


def _nearer(a: str, b: str, num: int, den: int) -> Column:
    """As ``_near``, by the middle bitmaps too where both sets have one."""
    apart = _apart(a, b, "middle", MIDDLE_BITS // 64)
    room = (den - num) * (F.col(f"{a}.n") + F.col(f"{b}.n"))
    return _near(a, b, num, den) & F.coalesce((num + den) * apart <= room, F.lit(True))


class _Join:
    def __init__(self, docs: DataFrame, width: int, num: int, den: int):
        small_batches(docs.sparkSession)
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        self.width, self.num, self.den = width, num, den
        self.scan = written(
            self.docs.select("*", *_text_hash("text")).mapInArrow(
                tidy(_scan(width)), "doc_id long, t1 long, t2 long, n long, sig binary"
            ),
            "scan",
        )
        self.rows = self.scan
        self.classes = written(
            self.rows.where("n > 0")
            .groupBy("sig", "n")
            .agg(F.min("doc_id").alias("rep"))
            .withColumn("cid", F.monotonically_increasing_id()),
            "classes",
        )

    def sets_of(self, found: DataFrame, classes: DataFrame) -> DataFrame:
        """``found`` (doc_id, sig, ...) of one row per class, with its cid and n."""
        same = found["doc_id"].eqNullSafe(classes["rep"]) & (found["sig"] == classes["sig"])
        rows = found.join(classes, same).drop("doc_id", "rep", "sig")
        return rows.dropDuplicates(["cid"])  # a repeated row

    def index(self) -> None:
        found = self.docs.mapInArrow(
            tidy(_prefixes(self.width, self.num, self.den)),
            "doc_id long, sig binary, bits array<long>, middle array<long>, wide array<long>, "
            "low array<long>, more array<long>",
        )
        sets = written(self.sets_of(found, self.classes), "prefixes")
        left = written(self.unsettled(sets), "unsettled")
        bitmaps = written(left.drop("low", "more", "size"), "bitmaps")
        self.nodes = bitmaps.select("cid", "n", "bits", "middle")
        self.wider = bitmaps.where(F.size("middle") > 0).select("cid", "n", "middle", "wide")
        prefixes = written(self.prefixes(left), "tokens")
        discard(sets, left)
        # a prefix with a shingle of its own equals no other prefix
        alike = ["n", "tokens", "own"]
        prefixes = prefixes.withColumn("own", F.when(F.col("rare") > 0, F.col("cid")).otherwise(-1))
        groups = written(
            prefixes.groupBy(*alike, "rare").agg(F.min("cid").alias("gid")), "groups"
        )
        grouped = prefixes.join(groups.drop("rare"), alike).select("cid", F.col("gid").alias("found"))
        self.members = written(
            self.classes.join(grouped, "cid", "left").select("cid", F.coalesce("found", "cid").alias("gid")),
            "members",
        )
        discard(prefixes)
        postings = groups.select("gid", "n", "rare", F.posexplode("tokens").alias("at", "token"))
        postings = postings.select("gid", "n", (F.col("rare") + F.col("at")).alias("pos"), "token")
        several = (
            postings.groupBy("token").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("token")
        )
        self.shared = written(postings.join(several, "token"), "postings")
        discard(groups)

    def unsettled(self, sets: DataFrame) -> DataFrame:
        """Classes whose prefix holds a shingle of another class, with the prefix ``size``."""
        counts = (
            sets.select("cid", F.explode("low").alias("token"))
            .groupBy("token")
            .agg(F.count(F.lit(1)).alias("k"), F.min("cid").alias("cid"))
        )
        alone = counts.where("k = 1").groupBy("cid").agg(F.count(F.lit(1)).alias("alone"))
        whole = F.expr(f"n - (n * {self.num} + {self.den - 1}) DIV {self.den} + 1")
        return (
            sets.withColumn("size", whole)
            .join(alone, "cid", "left")
            .where(F.coalesce("alone", F.lit(0)) < F.col("size"))
            .drop("alone")
        )

    def prefixes(self, left: DataFrame) -> DataFrame:
        """(cid, n, rare, tokens): how many shingles of a prefix no other class has, and the others.

        The order is that of the frequencies among the classes left, then of the hashes.
        """
        tokens = left.select("cid", F.explode("low").alias("token"))
        common = (
            tokens.groupBy("token").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
        )
        held = (
            tokens.join(common, "token")
            .groupBy("cid")
            # at most the least hashes of one set
            .agg(F.array_sort(F.collect_list(F.struct("k", "token"))).alias("held"))
        )
        rare = F.least(F.size("low") - F.size("held"), F.col("size")).cast("int")
        rows = left.join(held, "cid", "left").withColumn(
            "held", F.coalesce("held", F.array().cast("array<struct<k:bigint,token:bigint>>"))
        )
        taken = F.slice("held", F.lit(1), F.greatest(F.lit(0), F.col("size").cast("int") - F.col("rare")))
        return rows.withColumn("rare", rare).select(
            "cid", "n", "rare", F.concat(F.transform(taken, lambda x: x["token"]), "more").alias("tokens")
        ).where(F.size("tokens") > 0)

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of classes that link, of a table of ``sifted``, which goes."""
        needed = pairs.select("a").union(pairs.select("b")).distinct()
        classes = written(self.classes.join(needed, F.col("cid") == F.col("a"), "left_semi"), "needed")
        ids = classes.select(F.col("rep").alias("id")).distinct()
        if fits_broadcast(ids, max_rows=MAX_BROADCAST_IDS):
            ids = F.broadcast(ids)
        texts = self.docs.join(ids, self.docs["doc_id"].eqNullSafe(F.col("id")), "left_semi")
        found = texts.mapInArrow(
            tidy(_full_sets(self.width)), "doc_id long, sig binary, shingles array<long>"
        )
        sets = written(self.sets_of(found, classes).select("cid", "n", "shingles"), "sets")
        one = sets.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
        two = sets.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
        both = F.size(F.array_intersect("sa", "sb"))
        linked = (self.den + self.num) * both >= self.num * (F.col("na") + F.col("nb"))
        links = written(pairs.join(two, "b").join(one, "a").where(linked).select("a", "b"), "links")
        discard(pairs, classes, sets)
        return links

    def sifted(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` once each, without those of large sets that bitmaps of the same width tell apart."""
        one, two = (
            self.wider.select(F.col("cid").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "middle", "wide")])
            for x in "ab"
        )
        far = F.lit(False)
        for name in ("middle", "wide"):
            x, y = F.col(f"{name}_a"), F.col(f"{name}_b")
            unlike = F.zip_with(x, y, lambda v, w: F.bit_count(v.bitwiseXOR(w)))
            apart = F.aggregate(unlike, F.lit(0), lambda total, v: total + v)
            room = (self.den - self.num) * (F.col("n_a") + F.col("n_b"))
            far = far | F.coalesce((F.size(x) == F.size(y)) & ((self.num + self.den) * apart > room), F.lit(False))
        held = pairs.select("a", "b").distinct().join(two, "b", "left").join(one, "a", "left")
        return written(held.where(~far).select("a", "b"), "pairs")

    def units(self, comps: DataFrame) -> DataFrame:
        """One class for every component in every group."""
        return comps.groupBy("gid", "comp").agg(F.min("cid").alias("cid"))

    def proposed(self, units: DataFrame, turn: int) -> DataFrame:
        """For every unit the likeliest node of another component with a shared prefix shingle.

        Of every shingle a few holders, drawn anew for it and each turn, are proposed to all others:
        so a unit chooses among many nodes, and large components, which have many holders, soon meet
        what belongs to them. The drawn come to a unit's row with their bitmaps and the likeliest is
        picked there: no pair is a row before it is, and a unit has one row for each of its shingles.
        """
        nodes = units.join(self.nodes.select("cid", "n", "bits"), "cid")
        node = F.struct("comp", "cid", "n", "bits").alias("own")
        held = self.shared.select("token", "gid").join(nodes, "gid").select("token", node)
        drawn = [
            F.min(F.struct(F.xxhash64(F.lit(turn), F.lit(i), "token", "own.cid").alias("draw"), "own"))["own"]
            for i in range(DRAWS)
        ]
        ends = (
            held.groupBy("token")
            .agg(F.min("own").alias("lo"), F.max("own").alias("hi"), F.array(*drawn).alias("drawn"))
            .where("lo.comp <> hi.comp")
        )
        others = F.filter("drawn", lambda x: x["comp"] != F.col("own.comp"))
        end = F.when(F.col("own.comp") != F.col("hi.comp"), F.col("hi")).otherwise(F.col("lo"))
        others = F.when(F.size(others) > 0, others).otherwise(F.array(end))
        near = F.filter(others, lambda x: _near(x, "own", self.num, self.den))
        apart = F.transform(near, lambda x: F.struct(_apart(x, "own").alias("apart"), x["cid"].alias("b")))
        rows = held.join(ends, "token").select(F.col("own.cid").alias("a"), F.array_min(apart).alias("best"))
        best = rows.groupBy("a").agg(F.min("best").alias("best")).where("best IS NOT NULL")
        return best.select("a", F.col("best.b").alias("b"))

    def likeliest(self, pairs: DataFrame) -> DataFrame:
        one, two = self.nodes.alias("x"), self.nodes.alias("y")
        return (
            pairs.join(two, F.col("b") == F.col("y.cid"))
            .join(one, F.col("a") == F.col("x.cid"))
            .where(_near("x", "y", self.num, self.den))
            .groupBy("a")
            .agg(F.min(F.struct(_apart("x", "y").alias("apart"), F.col("b").alias("b"))).alias("best"))
            .select("a", F.col("best.b").alias("b"))
        )

    def remaining(self, comps: DataFrame) -> DataFrame:
        """All pairs of members in different components that may still link.

        A pair is made at the first prefix shingle that both share: a later one knows those just
        before it in either prefix, and makes no pair where they have one in common. The first one
        has none before it, so no pair is lost; one far behind its last shared shingle may come again.
        """
        span = comps.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        mixed_tokens = (
            self.shared.join(span, "gid")
            .groupBy("token")
            .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
            .where("lo <> hi")
            .select("token")
        )
        left = written(self.shared.join(mixed_tokens, "token"), "left")
        members = comps.join(self.nodes.drop("n"), "cid")
        # bitmaps go only with members that may make a pair
        several = comps.join(span.where("lo <> hi").select("gid"), "gid", "left_semi")
        inside = several.join(self.nodes, "cid")
        x, y = inside.alias("x"), inside.alias("y")
        within = x.join(
            y,
            (F.col("x.gid") == F.col("y.gid"))
            & (F.col("x.cid") < F.col("y.cid"))
            & (F.col("x.comp") != F.col("y.comp"))
            & _nearer("x", "y", self.num, self.den),
        ).select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b"))
        earlier = Window.partitionBy("gid").orderBy("pos").rowsBetween(-EARLIER, -1)
        held = left.withColumn("before", F.collect_list("token").over(earlier)).join(members, "gid")
        x, y = held.alias("x"), held.alias("y")
        room = (self.num + self.den) * (F.col("x.pos") + F.col("y.pos")) <= (self.den - self.num) * (
            F.col("x.n") + F.col("y.n")
        )
        across = x.join(
            y,
            (F.col("x.token") == F.col("y.token"))
            & (F.col("x.cid") < F.col("y.cid"))
            & (F.col("x.comp") != F.col("y.comp"))
            & room
            & _nearer("x", "y", self.num, self.den)
            & ~F.arrays_overlap("x.before", "y.before"),
        ).select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b"))
        return within.union(across)

    def merged(self, comps: DataFrame, links: DataFrame) -> DataFrame:
        """(cid, gid, comp) of every class after ``links``, which join components of ``comps``.

        Only the links' components are walked, each pair of them once, however many links it has.
        """
        a = comps.select(F.col("cid").alias("a"), F.col("comp").alias("from"))
        b = comps.select(F.col("cid").alias("b"), F.col("comp").alias("to"))
        ends = links.join(a, "a").join(b, "b").select(F.col("from").alias("a"), F.col("to").alias("b"))
        found = components(ends).withColumnRenamed("comp", "least")
        return written(
            comps.join(found, F.col("comp") == F.col("node"), "left").select(
                "cid", "gid", F.coalesce("least", "comp").alias("comp")
            ),
            "comps",
        )


def _linked(docs: DataFrame, width: int, num: int, den: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, t1, t2, n, comp, component_id, class_id of every row; the last three null without words."""
    join = _Join(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), width, num, den)
    join.index()
    inside = join.members.where("cid <> gid").select(F.col("cid").alias("a"), F.col("gid").alias("b"))
    heads = join.members.where("cid = gid").select("gid", F.col("gid").alias("comp"), "cid")
    links = join.verified(join.sifted(join.proposed(heads, 0).union(join.likeliest(inside))))
    comps = join.merged(join.members.withColumn("comp", F.col("cid")), links)
    # clusters meet in a few rounds; while pairs link, one more saves far more pairs at the end
    for turn in range(1, ROUNDS):
        pairs = join.sifted(join.proposed(join.units(comps), turn))
        tried = pairs.count()
        if not tried:
            discard(pairs)
            break
        links = join.verified(pairs)
        found = links.count()
        if found:
            comps = join.merged(comps, links)
        if not found or found * WORTH < tried:
            break
    pairs = join.sifted(join.remaining(comps))
    if pairs.isEmpty():  # no plans for nothing: the driver keeps them
        discard(pairs)
    else:
        last = join.verified(pairs)
        if not last.isEmpty():
            comps = join.merged(comps, last)
    named = join.classes.join(comps, "cid")
    least = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    table = named.join(least, "comp").select("sig", "comp", "component_id", F.col("rep").alias("class_id"))
    # texts without words share a signature and have no class; copies by the thousand are spread
    keyed = join.rows.withColumn("sig", F.when(F.col("n") > 0, F.col("sig")))
    return left_join_unique(keyed, written(table, "table"), "sig").drop("sig")


def jaccard_components(
    docs: DataFrame,
    width: int = 5,
    num: int = 80,
    den: int = 100,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id of every document.

    Two documents link where their shingle sets' Jaccard similarity is at least ``num / den``.
    ``component_id`` is the smallest doc_id reachable by links, ``class_id`` that of equal sets.
    """
    return _linked(docs, width, num, den, doc_id, text).select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce("class_id", "doc_id").alias("class_id"),
    )


def one_of_each(
    docs: DataFrame,
    width: int = 5,
    num: int = 80,
    den: int = 100,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``docs`` with one document of every component: that of the smallest id, null last.

    Rows are told apart by id and text, so another text of a repeated id stays; only rows equal in
    both stay together. Documents without any word stay.
    """
    found = _linked(docs, width, num, den, doc_id, text).where("comp IS NOT NULL")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2")
    rows = written(found.select("comp", row.alias("row")), "rows")
    first = rows.groupBy("comp").agg(F.min("row").alias("first"))
    gone = left_join_unique(rows, first, "comp").where(F.col("row") != F.col("first"))
    gone = gone.select(
        F.col("row.doc_id").alias("__gone"), F.col("row.t1").alias("__t1"), F.col("row.t2").alias("__t2")
    )
    gone = written(gone.distinct(), "gone")
    t1, t2 = _text_hash(text)
    key = F.col(f"`{doc_id}`").eqNullSafe(gone["__gone"]) & (t1 == gone["__t1"]) & (t2 == gone["__t2"])
    return docs.join(gone, key, "left_anti")
