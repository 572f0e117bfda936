"""Resampling, line deduplication and fill-in-the-middle against brute force, with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from trailmill.llm import fill_middle, importance_resampling, line_dedup

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
KINDS = "doc_id long, text string, row string, keep string, key string, n long"


def _ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(11)
    lines = ["\t Shared LINE of some words \r", "SHARED line of some words", "ÉCOLE école ÀÖ \U0001F600 grün", "a b", "x" * 40]
    lines += [" ".join(rnd.choice("Alpha beta GAMMA delta9 eps-ilon zeta".split()) for _ in range(rnd.randrange(1, 9))) for _ in range(30)]
    made = ["\n".join(rnd.choice(lines) for _ in range(rnd.randrange(1, 90))) for _ in range(60)]
    odd = [None, "", "\n", "\n\n\n", " ", "one", "<P> inside a text", "end <S", "a<M>b", "Å" * 50, "long " * 30000]
    return made + odd + made[:7]


@pytest.fixture(scope="module")
def rows(texts):
    # ids are not in order of the rows; some repeat, with equal and with other texts; two are null
    ids = [(i * 37) % 101 for i in range(len(texts))]
    ids[3], ids[9], ids[12], ids[13] = ids[4], ids[10], None, None
    return list(zip(ids, texts, strict=True)) + [(ids[0], texts[0])] * 5


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "r", "k", "y", 1) for i, t in rows], KINDS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KINDS)


def _sorted(found):
    return sorted(map(repr, found))


# -- lines --------------------------------------------------------------------------------------


def _lines_kept(rows, least=10):
    def key(line):
        return _ascii_lower(line.strip("\t\n\x0b\f\r "))

    def place(i):
        return (i is None, i)

    first = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            k = key(line)
            if len(k) >= least and (k not in first or place(i) < place(first[k])):
                first[k] = i
    for i, text in rows:
        lines = (text or "").split("\n")
        stay = [line for line in lines if len(key(line)) < least or first[key(line)] == i]
        digest = hashlib.sha256("\n".join(stay).encode()).hexdigest()
        yield i, len(lines), len(lines) - len(stay), digest


@pytest.mark.parametrize("tasks", ["8", "200"])
def test_lines_by_brute_force(spark, docs, rows, tasks):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", tasks)  # more tasks: more keys count as heavy
    try:
        found = [tuple(r) for r in line_dedup.deduplicated(docs).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert _sorted(found) == _sorted(_lines_kept(rows))


def test_line_held_by_a_third_of_all_rows(spark):
    hot = "a line that very many documents hold"
    rows = [(i, f"{hot}\nown line number {i}" if i % 3 == 0 else f"another own line {i}") for i in range(3000, 0, -1)]
    frame = spark.createDataFrame([(i, t, "", "", "", 0) for i, t in rows], KINDS).repartition(7)
    keys = line_dedup.line_keys(frame, 10)
    assert [parts > 1 for _, parts in line_dedup._slices(keys)] == [True]
    assert _sorted(map(tuple, line_dedup.deduplicated(frame).collect())) == _sorted(_lines_kept(rows))


def test_lines_need_one_exchange_before_the_window(spark, docs):
    keys = line_dedup.line_keys(docs, 10)
    plan = line_dedup.dropped_lines(keys)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning") == 1 and "hashpartitioning" not in plan


def test_keep_bitmaps_are_small_and_give_the_text_back(spark):
    body = "\n".join(f"line number {i} of the second document" for i in range(1000))
    rows = [(1, "line number 70 of the second document"), (2, body)]
    frame = spark.createDataFrame([(i, t, "", "", "", 0) for i, t in rows], KINDS)
    bitmaps = line_dedup.keep_bitmaps(frame)
    (only,) = bitmaps.collect()
    assert (only.doc_id, only.n_dropped) == (2, 1) and only.keep == {1: -1 - (1 << 6)}
    texts = line_dedup.with_bitmaps(frame, bitmaps).select("doc_id", line_dedup.kept_text().alias("text"))
    kept = dict(map(tuple, texts.collect()))
    assert kept == {1: rows[0][1], 2: "\n".join(x for x in body.split("\n") if " 70 " not in x)}


def test_lines_of_no_documents(empty):
    assert line_dedup.deduplicated(empty).collect() == []


# -- resampling ---------------------------------------------------------------------------------


def _runs(text, max_n):
    words = WORD.findall(_ascii_lower(text or ""))
    return [" ".join(words[i : i + n]) for n in range(1, max_n + 1) for i in range(len(words) - n + 1)], len(words)


def _resampled(rows, target, max_n, buckets, percent, least):
    def bucket(run):
        return zlib.crc32(run.encode()) % buckets

    made = [(i, *_runs(t, max_n)) for i, t in rows]
    s = Counter(bucket(r) for _, runs, _ in made for r in runs)
    t = Counter(bucket(r) for text in target for r in _runs(text, max_n)[0])
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = [
        math.floor(1000 * math.log((t[b] + 1) * float(total_s + buckets) / ((s[b] + 1) * float(total_t + buckets))))
        for b in range(buckets)
    ]
    out = []
    for i, runs, words in made:
        weight = sum(gain[bucket(r)] for r in runs) // len(runs) if runs else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(runs), weight, score, None, words >= least])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0]))
    for place, r in enumerate(able[: len(able) * percent // 100], 1):
        r[4] = place
    return [tuple(r[:5]) for r in out]


TARGET = [None, "", "alpha beta gamma\nshared line", "Grün zeta zeta zeta delta9", "alpha\nbeta\n\ngamma"]


@pytest.mark.parametrize(("max_n", "buckets", "percent"), [(1, 10_000, 10), (1, 7, 100), (2, 500, 50), (4, 10_000, 30)])
def test_resampling_by_brute_force(spark, docs, rows, max_n, buckets, percent):
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    found = importance_resampling.resample(docs, target, max_n, buckets, percent)
    expected = _resampled(rows, TARGET, max_n, buckets, percent, 20)
    assert _sorted(map(tuple, found.collect())) == _sorted(expected)


def test_resampling_with_a_line_in_a_third_of_all_rows(spark):
    hot = "the very same line of words in a third of all documents"
    rows = [(i, f"{hot}\nown {i}" * (1 + i % 2) if i % 3 == 0 else f"word{i} other") for i in range(600)]
    frame = spark.createDataFrame([(i, t, "", "", "", 0) for i, t in rows], KINDS)
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    found = importance_resampling.resample(frame, target, max_n=3).collect()
    assert _sorted(map(tuple, found)) == _sorted(_resampled(rows, TARGET, 3, 10_000, 10, 20))


def test_runs_across_lines_are_those_that_no_line_holds():
    rnd = random.Random(2)
    for _ in range(300):
        text = "".join(rnd.choice("ab \n\n-") for _ in range(rnd.randrange(30)))
        for max_n in (1, 2, 3, 5):
            whole = Counter(r.encode() for r in _runs(text, max_n)[0])
            lines = Counter(
                r for line in text.encode().split(b"\n")
                for r in importance_resampling.runs_within(importance_resampling.words_of(line), max_n)
            )
            assert whole - lines == Counter(importance_resampling.runs_across(text.encode(), max_n))


def test_resampling_of_empty_tables(spark, docs, empty):
    none = spark.createDataFrame([], "text string")
    assert importance_resampling.resample(empty, none).collect() == []
    assert importance_resampling.resample(docs, none).where("rank = 1").count() == 1


# -- fill in the middle -------------------------------------------------------------------------


def _moved(i, text, units, seed=1, marks=("<P>", "<S>", "<M>")):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    parts = units(text)
    n = len(parts)
    if not n or any(m in text for m in marks) or h3 % 100 >= 90:
        return i, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(p) for p in (parts[:a], parts[a:b], parts[b:]))
    p, s, m = marks
    if h4 % 100 < 20:
        return i, n, "spm", len(prefix), len(middle), s + suffix + p + prefix + m + middle
    return i, n, "psm", len(prefix), len(middle), p + prefix + s + suffix + m + middle


@pytest.mark.parametrize("stretch", [fill_middle.STRETCH, 7])
def test_middle_by_brute_force(docs, rows, stretch, monkeypatch):
    monkeypatch.setattr(fill_middle, "STRETCH", stretch)
    monkeypatch.setattr(fill_middle, "OUT_BYTES", 3000)
    expected = [_moved(i, t, list) for i, t in rows]
    moved = fill_middle.fill_in_middle(docs)
    assert _sorted(map(tuple, moved.collect())) == _sorted(expected)
    assert {r[2] for r in expected} == {"plain", "psm", "spm"}
    back = moved.select("doc_id", fill_middle.restored().alias("text")).collect()
    assert _sorted(map(tuple, back)) == _sorted((i, t or "") for i, t in rows)


def test_middle_of_lines_and_of_odd_units(docs, rows):
    def lines(text):
        return re.findall(r"[^\n]*\n|[^\n]+", text)

    found = fill_middle.fill_in_middle(docs, unit=r"[^\n]*\n|[^\n]+", seed=5)
    assert _sorted(map(tuple, found.collect())) == _sorted(_moved(i, t, lines, 5) for i, t in rows)
    digits = fill_middle.fill_in_middle(docs, unit=r"[0-9]").select("n", "form").distinct().collect()
    assert [tuple(r) for r in digits] == [(0, "plain")]  # no text is a run of digits


def test_middle_with_sentinels_half_inside(spark):
    pieces = ["<", "<P", "S>", "<M", ">", "P>", "\n"]
    rnd = random.Random(4)
    rows = [(i, "".join(rnd.choice(pieces) for _ in range(rnd.randrange(12)))) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    moved = fill_middle.fill_in_middle(frame)
    back = moved.select("doc_id", fill_middle.restored().alias("text")).collect()
    assert _sorted(map(tuple, back)) == _sorted(rows)
    for wrong in (("a", "a", "b"), ("ab", "ba", "c"), ("a", "ab", "c"), ("", "a", "b")):
        with pytest.raises(ValueError):
            fill_middle.check_sentinels(wrong)


def test_middle_of_texts_as_ids_and_no_documents(spark, empty):
    frame = spark.createDataFrame([("k1", "some text of a document")], "name string, body string")
    (row,) = fill_middle.fill_in_middle(frame, doc_id="name", text="body").collect()
    assert tuple(row) == _moved("k1", "some text of a document", list)
    assert fill_middle.middle_digests(empty).collect() == []


def test_digest_columns(docs):
    assert line_dedup.deduplicated(docs).columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    digests = fill_middle.middle_digests(docs)
    assert dict(digests.dtypes)["n"] == dict(digests.dtypes)["prefix_chars"] == "bigint"
    assert digests.where(F.col("restored_sha256").isNull()).isEmpty()
