"""Operators on texts against brute force on small tables, with odd rows among the usual ones."""

import hashlib
import html as entities
import random
import re
from array import array

import numpy
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trailmill.llm import (
    bpe_monoid,
    host_quality,
    jaccard_groups,
    language_fusion,
    license_windows,
    ring_sharding,
    secret_ownership,
    template_leaks,
    url_sweep,
    wrapper_induction,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _prose(rnd, n, words="the of and a in thing over under red blue seven river stone".split()):
    return " ".join(rnd.choice(words) + rnd.choice(["", "s", "ed", "ly"]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    base = [_prose(rnd, rnd.randrange(20, 120)) for _ in range(25)]
    near = []
    for text in base[:12]:
        words = text.split()
        words[rnd.randrange(len(words))] = "changed"
        near.append(" ".join(words))
    odd = [None, "", " ", "\n\t", "one", "One two", "ONE TWO", "x" * 3000, "a b c " * 2000]
    return base + near + base[:5] + odd


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", None if i % 7 == 0 else f"src{i % 3}", 0, "extra") for i, t in enumerate(texts)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, __row string"
    return spark.createDataFrame(rows, kinds)


def _documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def _secret(value):
    return f'some text token = "{value}" more'


def test_secrets_by_owner(spark):
    key = "AKIA" + "Q7" * 10
    generic = "Zx9" * 8
    rows = [
        (1, _secret("abcdefgh"), "en", "a", 0),
        (2, _secret("abcdefgh"), "en", "b", 0),
        (3, f"é {key} and {'0f' * 12}", "en", "a", 0),
        (4, f"{generic} alone", "en", "c", 0),
        (5, None, None, None, None),
        (5, "password:short token=12345", "en", "a", 0),
        (6, f"x {'Yx8' * 8}", "en", "a", 0),
        (7, f"x {'Yx8' * 8}", "en", "b", 0),
    ]
    found = {}
    for row in secret_ownership.secret_report(_documents(spark, rows)).collect():
        found.setdefault(row.doc_id, []).append(row)
    assert (found[1][0].n_assign, found[1][0].n_live, found[1][0].n_example) == (1, 0, 1)
    assert (found[3][0].n_access, found[3][0].n_hex, found[3][0].n_live) == (1, 1, 2)
    assert found[3][0].spans == "access:2:26,hex:31:55"
    assert found[4][0].spans == "generic:0:24" and found[4][0].n_live == 1
    assert found[6][0].spans == found[7][0].spans == ""
    assert len(found[5]) == 2 and {r.base_sha256 for r in found[5]} == {hashlib.sha256(b"").hexdigest()}
    clean = {(r.doc_id, r.text) for r in secret_ownership.redact_secrets(_documents(spark, rows)).collect()}
    assert (1, 'some text token = "[secret]" more') in clean
    assert (3, "é [secret] and [secret]") in clean and (4, "[secret] alone") in clean
    assert (5, None) in clean and (6, rows[6][1]) in clean
    assert secret_ownership.secret_report(_documents(spark, [])).count() == 0


def test_secrets_of_rows_without_id(spark):
    one, two = "Zx9" * 8, "Wy7" * 8
    rows = [(None, f"a {one} b", "en", "a", 0), (None, f"c {two} d", "en", "b", 0), (None, "plain", "en", "a", 0)]
    rows += [(1, f"e {'Qv5' * 8}", "en", "a", 0), (1, "plain", "en", "a", 0)]
    clean = secret_ownership.redact_secrets(_documents(spark, rows)).collect()
    assert sorted(r.text for r in clean) == ["a [secret] b", "c [secret] d", "e [secret]", "plain", "plain"]


@pytest.mark.parametrize("repeat", [1, 4])
def test_ring_keeps_counts_even(spark, docs, repeat):
    rows = docs
    for _ in range(repeat - 1):
        rows = rows.union(docs)
    found = ring_sharding.shard_documents(rows, shards=7).collect()
    assert len(found) == rows.count()
    shards = {}
    for row in found:
        shards.setdefault(row.shard, []).append(row.slot)
    sizes = [len(slots) for slots in shards.values()]
    assert len(shards) == 7 and max(sizes) - min(sizes) <= 1
    assert all(sorted(slots) == list(range(len(slots))) for slots in shards.values())
    assert sum(row.shard != row.home_shard for row in found) < len(found) / 2
    assert ring_sharding.shard_documents(rows.limit(0)).count() == 0


def test_licenses_by_brute_force(spark, docs):
    templates = license_windows.TEMPLATES
    rnd = random.Random(2)
    rows = [(i, _prose(rnd, 30) + " " + t + " " + _prose(rnd, 30), "", "", 0) for i, (_, t) in enumerate(templates)]
    rows += [(100, templates[3][1].replace("free of charge", "at no cost"), "", "", 0), (101, None, "", "", 0)]
    rows += [(102, "license licensed released", "", "", 0), (102, "", "", "", 0)]
    found = license_windows.find_licenses(_documents(spark, rows), license_windows.template_table(spark))
    got = {(r.doc_id, r.template_id, round(r.containment, 6)) for r in found.collect()}
    words = lambda t: re.findall("[a-z0-9]+", t.lower())
    runs = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    expected = set()
    for doc, text, *_ in rows:
        for k, (_, template) in enumerate(templates):
            wanted, held = runs(words(template)), words(text or "")
            size = license_windows.window_class(len(words(template)) - 4)
            shares = [
                len(wanted & runs(held[a : a + 2 * size + 4])) / len(wanted) for a in range(0, len(held), size)
            ]
            if max(shares, default=0) >= 0.8:
                expected.add((doc, k, round(max(shares), 6)))
    assert got == expected and {k for _, k, _ in got} == set(range(len(templates)))


@pytest.mark.parametrize("leaf", [1, 2, 3, 7, 50])
def test_bpe_tree_at_any_cut(monkeypatch, leaf):
    """However small the parts are, the tree gives the ids of the whole text and its bytes back."""
    tiktoken = pytest.importorskip("tiktoken")
    public = pytest.importorskip("public_tokenizers")
    monkeypatch.setattr(bpe_monoid, "LEAF_CHARS", leaf)
    monkeypatch.setattr(bpe_monoid, "LEAF_IDS", leaf)
    ranks = bpe_monoid.read_ranks(public.path(bpe_monoid.VOCABULARY))
    known = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encode, decode = bpe_monoid.text_encoder(ranks, public.PATTERN), bpe_monoid.ids_decoder(ranks)
    rnd = random.Random(leaf)
    parts = ["a", "th", " ", " ", "  ", "\n", "\t", "'s", "é", "中文", "🙂", "12", "#", "\x1c", "\xa0", "word.", "abc" * 40]
    for _ in range(400):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(60)))
        ids = array("i", encode(text)).tolist() if text else []
        assert ids == known.encode_ordinary(text)
        assert decode(numpy.array(ids, numpy.int32)) == text.encode()


def test_bpe_like_the_public_encoder(spark, docs, texts):
    tiktoken = pytest.importorskip("tiktoken")
    public = pytest.importorskip("public_tokenizers")
    ranks = bpe_monoid.read_ranks(public.path(bpe_monoid.VOCABULARY))
    known = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = {r.doc_id: r for r in bpe_monoid.token_digests(docs).collect()}
    for i, text in enumerate(texts):
        ids = known.encode_ordinary(text or "")
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    both = bpe_monoid.decode(bpe_monoid.encode(docs)).collect()
    assert [bytes(r.data).decode() for r in sorted(both, key=lambda r: r.doc_id)] == [t or "" for t in texts]
    encode = bpe_monoid.text_encoder(ranks, public.PATTERN)
    rnd = random.Random(1)
    parts = ["a", "th", " ", "  ", "\n", "'s", "é", "中文", "🙂", "12", "#", "\x1c", "\xa0", "#a", "abc" * 40]
    for _ in range(500):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(40)))
        assert list(memoryview(encode(text)).cast("i") if text else []) == known.encode_ordinary(text)


@pytest.mark.parametrize("width,num", [(3, 90), (5, 80), (1, 50)])
def test_jaccard_components_by_brute_force(docs, texts, width, num):
    sets = []
    for text in texts:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = WORD.findall(lower)
        n = len(words) - width + 1
        sets.append({tuple(words[k : k + width]) for k in range(n)} if n > 0 else {tuple(words)} - {()})
    least = list(range(len(sets)))
    for _ in range(len(sets)):
        before = list(least)
        for a in range(len(sets)):
            for b in range(a):
                both = len(sets[a] & sets[b])
                if both and 100 * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    least[a] = least[b] = min(least[a], least[b])
        if least == before:
            break
    found = jaccard_groups.jaccard_components(docs, width, num, 100).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in found}
    assert got == {i: (len(s), least[i]) for i, s in enumerate(sets)}


def test_one_of_each_component_stays(docs, texts):
    kept = {r.doc_id for r in jaccard_groups.one_of_each(docs).collect()}
    assert set(range(25)) <= kept and not kept & set(range(37, 42))
    assert {37 + 5, 37 + 6} <= kept  # null and empty
    assert jaccard_groups.jaccard_components(docs.limit(0)).count() == 0


def test_a_pair_is_made_once_not_for_every_shared_shingle(spark):
    """Long texts of one family, some of their words replaced: some pairs link, most nearly do."""
    rnd = random.Random(11)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(1500)]
    rows = []
    for i in range(24):
        words = list(base)
        for _ in range(10 * (i % 6) + 5):
            words[rnd.randrange(len(words))] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    join = jaccard_groups._Join(docs, 3, 90, 100)
    join.index()
    alone = join.members.select("cid", "gid", F.col("cid").alias("comp"))
    name = {r.cid: r.rep for r in join.classes.collect()}
    pairs = [tuple(sorted((name[r.a], name[r.b]))) for r in join.remaining(alone).collect()]
    sets = [{tuple(w[k : k + 3]) for k in range(len(w) - 2)} for w in (t.split() for _, t in rows)]
    likeness = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for b in range(24) for a in range(b)}
    linked = {pair for pair, x in likeness.items() if x >= 0.9}
    assert linked and linked <= set(pairs)
    assert len(pairs) <= 1.1 * len(set(pairs))
    assert all(likeness[pair] > 0.8 for pair in pairs)


def test_a_crowded_family_is_not_paired_before_the_likeliest_is_picked(spark, monkeypatch):
    """Near copies by the hundred: a unit's row holds the drawn nodes, and only the likeliest becomes a pair."""
    rnd = random.Random(13)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(60)]
    rows = []
    for i in range(200):
        words = list(base)
        for _ in range(i % 3 + 1):
            words[rnd.randrange(len(words))] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    paired, proposals = [], []
    likeliest, proposed = jaccard_groups._Join.likeliest, jaccard_groups._Join.proposed

    def counted(self, pairs):
        paired.append(pairs.count())
        return likeliest(self, pairs)

    def kept(self, units, turn):
        found = proposed(self, units, turn)
        proposals.append((found.collect(), {r.cid: r.comp for r in units.collect()}))
        return found

    monkeypatch.setattr(jaccard_groups._Join, "likeliest", counted)
    monkeypatch.setattr(jaccard_groups._Join, "proposed", kept)
    found = jaccard_groups.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80, 100).collect()
    sets = [{tuple(w[k : k + 3]) for k in range(len(w) - 2)} for w in (t.split() for _, t in rows)]
    least = list(range(len(rows)))
    near = [(a, b) for b in least for a in range(b) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in rows:
        for a, b in near:
            least[a] = least[b] = min(least[a], least[b])
    assert {r.doc_id: r.component_id for r in found} == dict(enumerate(least))
    assert len(near) > 1000 and sum(paired) <= len(rows)
    first, comp = proposals[0]
    assert len(first) > 50 and len({r.a for r in first}) == len(first)
    assert all(comp[r.a] != comp[r.b] for r in first)


def test_links_between_two_components_are_walked_once(spark, monkeypatch):
    """Families of near copies that only the last step may join: one edge for many links."""
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(60):
        words = list(base)
        words[rnd.randrange(len(words))] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # no round sees a pair of the families by chance: half of the classes each
    def halves(self, units, turn):
        x, y = units.alias("x"), units.alias("y")
        pairs = x.join(y, (F.col("x.cid") < F.col("y.cid")) & (F.col("x.cid") % 2 == F.col("y.cid") % 2))
        return pairs.select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b"))

    walked, known = [], jaccard_groups.components

    def counted(edges):
        walked.append(edges.where("a <> b").distinct().count())
        return known(edges)

    monkeypatch.setattr(jaccard_groups._Join, "proposed", halves)
    monkeypatch.setattr(jaccard_groups, "components", counted)
    found = jaccard_groups.jaccard_components(docs, 3, 90, 100).collect()
    assert {r.component_id for r in found} == {0}
    assert len(walked) > 1 and walked[-1] <= 10


def test_other_text_of_a_repeated_id_stays(spark):
    """Rows of one id with different texts, rows without id, and rows equal in both."""
    rnd = random.Random(7)
    a, b, c, d = (_prose(rnd, 30) for _ in range(4))
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (None, d), (None, d + " more"), (None, a), (None, None), (4, "")]
    frame = _documents(spark, [(i, t, "en", "s", 0) for i, t in rows])
    kept = [(r.doc_id, r.text) for r in jaccard_groups.one_of_each(frame).collect()]
    (one,) = [r for r in kept if r[1] in (d, d + " more")]  # near copies of each other
    assert sorted(map(str, kept)) == sorted(map(str, [(1, a), (2, b), (3, c), (3, c), one, (None, None), (4, "")]))


def test_one_more_shard_moves_few_rows(spark):
    """Homes move only into the new shard; rows go on clockwise only from full shards."""
    rows = spark.range(6000).selectExpr("id * 7919 AS k").withColumn("size", F.lit(1))
    before = {r.k: r for r in ring_sharding.shard_rows(rows, "k", 24).collect()}
    after = {r.k: r for r in ring_sharding.shard_rows(rows, "k", 25).collect()}
    moved = [k for k in before if before[k].home_shard != after[k].home_shard]
    assert len(moved) <= 0.08 * len(before) and all(after[k].home_shard == 24 for k in moved)


def test_ring_by_a_clockwise_walk(spark):
    """Every arc gives its rows to its shard until that is full, then the next arcs with room take them."""
    arcs = ring_sharding.ring_arcs(spark, 5, 8)
    rnd = random.Random(3)
    for _ in range(30):
        counts = {arc: rnd.choice([0, 0, 1, 5, 200]) for arc in range(len(arcs))}
        total = sum(counts.values())
        room = [total // 5 + (s < total % 5) for s in range(5)]
        placed, waiting = [], []
        for arc, n in counts.items():
            stay = min(n, room[arcs[arc][2]])
            room[arcs[arc][2]] -= stay
            placed += [(arc, rank, arcs[arc][2]) for rank in range(stay)]
            waiting += [(arc, rank) for rank in range(stay, n)]
        for arc, rank in waiting:
            at = (arc + 1) % len(arcs)
            while not room[arcs[at][2]]:
                at = (at + 1) % len(arcs)
            room[arcs[at][2]] -= 1
            placed.append((arc, rank, arcs[at][2]))
        parts = ring_sharding.bounded_loads(arcs, counts, 5)
        got = [(arc, rank, shard) for arc, start, end, shard in parts for rank in range(start, end)]
        assert sorted(got) == sorted(placed)


def test_urls_by_brute_force(spark):
    rnd = random.Random(3)
    labels, paths = ["a", "b", "com", "net", "x"], ["/", "/en/", "/en/x/", "/e", ""]
    rules = sorted(
        {(".".join(rnd.choices(labels, k=rnd.randrange(1, 4))), rnd.choice(paths)) for _ in range(30)}
    )
    rules = [(h, p, rnd.choice(["allow", "block"])) for h, p in rules]
    urls = [None, "", "no scheme", "http://", "HTTP://A.B.COM/en/x/1?q#f", "x://com?/en/", "x://a..com/en/"]
    for _ in range(200):
        host = ".".join(rnd.choices(labels, k=rnd.randrange(1, 5)))
        urls.append(f"http://{host}{rnd.choice(['', '/', '/en/', '/en/x/y', '/e', '?q=/'])}")
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    for row in url_sweep.judge_urls(pages, table).collect():
        url = row.url or ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
        host = host.lower()
        fits = [
            (len(h + p), len(h), h + p, v)
            for h, p, v in rules
            if host and (host == h or host.endswith("." + h)) and path.startswith(p)
        ]
        best = max(fits, default=(0, 0, None, "allow"))
        assert (row.host, row.path, row.rule, row.verdict) == (host, path, best[2], best[3])
    assert {r.verdict for r in url_sweep.judge_urls(pages, table.limit(0)).collect()} == {"allow"}
    assert url_sweep.judge_urls(pages.limit(0), table).count() == 0


def test_quality_counts_by_brute_force(docs, texts):
    rows = {r.doc_id: r for r in host_quality.judge_quality(docs).collect()}
    for i, text in enumerate(texts):
        words = WORD.findall(text or "")
        places = {}
        for k in range(len(words) - 2):
            places.setdefault(tuple(words[k : k + 3]), []).append(k)
        covered = {k + j for at in places.values() if len(at) > 1 for k in at for j in range(3)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        got = rows[i]
        assert (got.n_words, got.n_repeat_words, got.word_chars) == (len(words), len(covered), sum(map(len, words)))
        assert (got.n_dup_lines, got.base_failed) == (len(lines) - len(set(lines)), failed)
        assert not (got.kept and failed)


def test_languages_held_out(spark):
    words = {"en": ["the", "and", "with", "that"], "de": ["und", "nicht", "schön", "eine"], "fr": ["être", "que", "les", "dans"]}
    rnd = random.Random(4)
    rows = [
        (i, " ".join(rnd.choices(words[lang], k=rnd.randrange(3, 40))), lang, "a.de", 0)
        for i, lang in enumerate(["en", "de", "fr"] * 40)
    ]
    table = _documents(spark, rows)
    model = language_fusion.fit_trigrams(table.where("doc_id % 2 = 0"), ["de", "en", "fr"])
    odd = _documents(spark, [(1000, None, None, None, 0), (1001, "", "en", "", 0), (1002, "123 !?", "en", "b", 0)])
    judged = language_fusion.identified(table.where("doc_id % 2 = 1").union(odd), model, ["de", "en", "fr"])
    rows = judged.collect()
    assert all(r.language == r.lang and r.kept for r in rows if r.doc_id < 1000)
    assert not any(r.kept for r in rows if r.doc_id >= 1000)
    assert language_fusion.identify_documents(table.limit(0)).count() == 0


def test_leaks_with_changed_slots(spark):
    item = "A train leaves with 30 wagons and after Berlin there are 30 more so how many wagons now"
    items = spark.createDataFrame([(1, item), (2, None), (3, "short one"), (4, "five words are just enough")], "item_id long, text string")
    docs = [
        (1, "before. " + item + " after", "", "", 0),
        (2, item.replace("30", "45").replace("Berlin", "Paris"), "", "", 0),
        (3, item.replace("30", "45", 1), "", "", 0),  # one slot has two values
        (4, _prose(random.Random(1), 200), "", "", 0),
        (5, None, "", "", 0),
        (6, "five words are just enough", "", "", 0),
        (7, "short one", "", "", 0),
    ]
    found = {(r.doc_id, r.item_id, r.exact) for r in template_leaks.find_leaks(_documents(spark, docs), items).collect()}
    assert found == {(1, 1, True), (2, 1, False), (6, 4, True)}
    left = template_leaks.without_leaks(_documents(spark, docs), items)
    assert sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 7]
    assert template_leaks.find_leaks(_documents(spark, docs), items.limit(0)).count() == 0


def test_leaks_with_changed_words(spark):
    item = (
        "Every morning the old keeper walks along the shore and counts how many boats have come home "
        "before the light of the tower goes out again and the town begins to wake for work"
    )
    words = item.split()
    named = "Tom has 3km to go before the bridge. Then he walks back with Anna Lee until evening comes"
    items = spark.createDataFrame([(1, item), (2, " ".join(words[:16])), (3, named)], "item_id long, text string")
    middle = len(words) // 2
    docs = [
        (1, " ".join([*words[:middle], "really", *words[middle:]]), "", "", 0),
        (2, " ".join(words[:middle] + words[middle + 1 :]), "", "", 0),
        (3, " ".join([*words[:7], "by", *words[8:16]]), "", "", 0),
        (4, named.replace("Tom", "Mary Ann").replace("3km", "5 miles").replace("Anna Lee", "Bo"), "", "", 0),
        (5, named.replace("Tom", "Bo").replace("Anna Lee", "Bo"), "", "", 0),  # two names become one
        (6, item + " . " + item, "", "", 0),
        (7, " ".join(words[20:] + words[:20][::-1]), "", "", 0),
    ]
    rows = template_leaks.find_leaks(_documents(spark, docs), items).collect()
    leaks = {}
    for r in rows:
        leaks.setdefault((r.doc_id, r.item_id), []).append(r)
    assert {(1, 1), (2, 1), (3, 2), (4, 3), (6, 1), (6, 2)} <= set(leaks) and (7, 2) not in leaks
    assert leaks[1, 1][0].covered == 1.0 and len(leaks[1, 1]) == len(leaks[2, 1]) == 1
    assert not leaks[4, 3][0].exact and leaks[3, 2][0].covered == 0.5
    assert len(leaks[6, 1]) == 2 and all(r.covered == 1.0 and r.exact for r in leaks[6, 1])


def test_main_text_and_template(spark):
    page = "<nav>menu</nav><div><p>Always the same line</p><p>Story {0} &amp; more<br>of {0}</p></div><footer>f</footer>"
    rows = [(i, f"http://h.org/{i}", page.format(i)) for i in range(12)]
    rows += [
        (100, "http://o.org/", '<article class="x"><h1>T</h1><p>a <b>b</b><div class="comments"><p>c</p></div><p>d</article><p>z'),
        (101, None, None),
        (102, "http://o.org/2", ""),
        (103, "http://o.org/3", '<p>a <span class="ad">buy</span> b</p><script>"</p>"</script>tail < 5'),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    text = {r.page_id: r.text for r in wrapper_induction.extract_text(pages).collect()}
    assert all(text[i] == entities.unescape(f"Story {i} &amp; more of {i}") for i in range(12))
    assert (text[100], text[101], text[102], text[103]) == ("T\na b\nd", "", "", "a b\ntail < 5")
    assert wrapper_induction.aligned_leaves("a(h(#)p(#)p(#)d(#))", "a(h(#)p(#)d(#))") == [0, 1, -1, 2]
    assert wrapper_induction.extract_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    "attributes,stays",
    [
        ('style="overflow:hidden"', True),
        ('aria-hidden="false"', True),
        ('title="hidden gems" data-role="navigation"', True),
        ('data-id="share"', True),
        ('class="layout has-sidebar no-sidebar"', True),
        ("hidden", False),
        ('data-x="1" hidden=""', False),
        ('aria-hidden="true"', False),
        ("class='box sidebar'", False),
        ('class="sidebar-left"', False),
        ("id=share", False),
        ('role="navigation"', False),
    ],
)
def test_only_boilerplate_attributes_drop(attributes, stays):
    parse = wrapper_induction.page_parser()
    assert parse(f"<p>a</p><article {attributes}><p>b</p></article>")[1] == (["b"] if stays else ["a"])


def test_template_of_small_hosts(spark):
    page = "<div>Notice of this host</div><div><p>Story {0} of {1}</p></div>"
    rows = [(100 * n + i, f"http://h{n}.org/{i}", page.format(i, n)) for n in (1, 2, 3, 9, 10) for i in range(n)]
    some = page.replace("Notice of this host", "{2}")
    rows += [(i, f"http://m.org/{i}", some.format(i, "m", "kept" if i < 2 else f"own {i}")) for i in range(4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    text = {r.page_id: r.text for r in wrapper_induction.extract_text(pages).collect()}
    assert all(text[100 * n + i] == f"Story {i} of {n}" for n in (2, 3, 9, 10) for i in range(n))
    assert text[100] == "Notice of this host\nStory 0 of 1"
    assert [text[i].split("\n")[0] for i in range(4)] == ["kept", "kept", "own 2", "own 3"]


def test_versions_of_an_article_are_no_template(spark):
    rnd = random.Random(6)
    paragraphs = [_prose(rnd, 40) for _ in range(4)]
    page = "<p>Notice on all pages</p><div><h1>A title</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "<p>{}</p></div>"
    rows = [(i, f"http://v.org/{i}", page.format(f"Updated {day}")) for i, day in enumerate(["Monday", "Friday"])]
    rows += [(10 + i, f"http://w.org/{i}", page.format(f"Updated {day}")) for i, day in enumerate(["Monday", "Friday"])]
    rows += [(20 + i, f"http://w.org/x{i}", f"<p>Notice on all pages</p><div><h1>Story {i}</h1><p>{_prose(rnd, 60)}</p></div>") for i in range(4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    text = {r.page_id: r.text.split("\n") for r in wrapper_induction.extract_text(pages).collect()}
    for i in (0, 1):
        assert text[i][-6:] == ["A title", *paragraphs, f"Updated {['Monday', 'Friday'][i]}"]
        assert text[10 + i] == ["A title", *paragraphs, f"Updated {['Monday', 'Friday'][i]}"]
    assert all(text[20 + i][0] == f"Story {i}" for i in range(4))


@pytest.mark.parametrize(
    ("page", "leaves"),
    [
        ("<title-card>a</title-card><p>b</p>", ["a", "b"]),
        ("<style-guide><p>a</p></style-guide><p>b</p><style>p {}</style>", ["a", "b"]),
        ("<title>t</title><p>b</p><script src='x'>1</script>", ["b"]),
        ("<form id='page'><div><p>" + "long prose " * 9 + "</p><label>Name</label><input><select><option>x</select></div></form>",
         [("long prose " * 9).strip()]),
        ("<div><p>" + "long prose " * 9 + "</p></div><form><p>Your mail is safe</p><input></form>", [("long prose " * 9).strip()]),
        ("<form><article><p>a</p></article><p>b</p></form><p>" + "c " * 20 + "</p>", ["a"]),
        ("<p>" + "c " * 20 + "</p><form><div role=main><p>a</p></div></form>", ["a"]),
        ('<div class="related-work"><p>a</p></div><div class="header-image-wrap"><p>b</p></div>', ["a", "b"]),
        ('<div class="related-posts"><p>a</p></div><div class="nav_menu-2"><p>b</p></div><p>c</p>', ["c"]),
        ("<article><header><h1>T</h1></header><p>a</p><footer>f</footer></article>", ["T", "a"]),
        ("<header><h1>Site</h1></header><main><header><h1>T</h1></header><p>a</p></main>", ["T", "a"]),
        ('<article><header class="byline">by</header><p>a</p></article>', ["a"]),
    ],
)
def test_text_that_must_stay(page, leaves):
    assert wrapper_induction.page_parser()(page)[1] == leaves


def test_only_the_leaking_rows_go(spark):
    """Several texts of one id and several rows without id are judged one by one."""
    item = "How many apples does Anna have if she buys 12 apples and eats 5 of them on Monday morning"
    rnd = random.Random(1)
    clean = [_prose(rnd, 60) for _ in range(3)]
    rows = [(None, clean[0] + " " + item), (None, clean[1]), (7, clean[2] + " " + item), (7, clean[0]), (8, None), (8, "")]
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    frame = _documents(spark, [(i, t, "en", "s", 0) for i, t in rows])
    left = [(r.doc_id, r.text) for r in template_leaks.without_leaks(frame, items).collect()]
    assert sorted(map(str, left)) == sorted(map(str, [(None, clean[1]), (7, clean[0]), (8, None), (8, "")]))


def test_leaks_are_told_by_row(spark):
    """Parts of an item in different texts of one id, or of rows without id, do not add up."""
    rnd = random.Random(8)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ru") for b in ("ten", "ser", "bal", "dor", "win", "gas")]
    item, other = " ".join(words), " ".join(reversed(words))
    half, rest = " ".join(words[:11]), " ".join(words[13:])
    rows = [(1, half), (1, rest), (None, half), (None, rest), (2, item), (2, other), (None, item), (3, item), (3, item)]
    before = _prose(rnd, 9)
    frame = _documents(spark, [(i, f"{before} . {t}", "en", "s", 0) for i, t in rows])
    frame = frame.withColumns({"row": F.lit("x"), "hash": F.lit(1), "item": F.lit(None), "doc": F.lit(2)})
    items = spark.createDataFrame([(1, item), (1, other), (None, item), (4, None)], "item_id long, text string")
    found = [(r.doc_id, r.item_id) for r in template_leaks.find_leaks(frame, items).collect()]
    each = [(2, 1), (2, 1), (2, None), (None, 1), (None, None), (3, 1), (3, None)]
    assert sorted(map(str, found)) == sorted(map(str, each))
    assert template_leaks.find_leaks(frame.limit(0), items).count() == 0


def test_tables_of_numbers_stay_linear(spark):
    rnd = random.Random(6)

    def numbers(n):
        return " ".join(str(rnd.randrange(10**6)) for _ in range(n))

    tables = [numbers(120) for _ in range(20)]
    items = spark.createDataFrame(
        [*enumerate(tables), (30, "0 " * 300), (31, "seven red boats went out " + "0 " * 60 + "and nobody saw them come home")],
        "item_id long, text string",
    )
    rows = [(i, numbers(300), "", "", 0) for i in range(50)]
    rows += [(100, "x " + tables[3] + " y", "", "", 0), (101, "0 " * 500, "", "", 0), (102, "1 2 3 " * 200, "", "", 0)]
    rows += [(103, "then seven red boats went out " + "0 " * 90 + "and nobody saw them come home at all", "", "", 0)]
    docs = _documents(spark, rows)
    found = {(r.doc_id, r.item_id): r for r in template_leaks.find_leaks(docs, items).collect()}
    assert {(100, 3), (101, 30), (103, 31)} <= set(found) and found[100, 3].covered == found[101, 30].covered == 1.0
    assert {doc for doc, _ in found} == {100, 101, 103}
    width, bits = template_leaks.WINDOW, template_leaks._found
    texts = lambda t: t.selectExpr(f"{t.columns[0]} AS id", "xxhash64(text) AS row", "text")
    runs = [texts(t).mapInArrow(bits([width], None), template_leaks.FOUND) for t in (docs, items)]
    assert template_leaks._met(*runs).count() < 500


def test_copies_plan_nothing_without_pairs(spark, monkeypatch):
    rnd = random.Random(11)
    texts = [" ".join(rnd.choices("abcdefghijklmnop", k=80)) for _ in range(20)]
    rows = [(i, text, "", "", 0) for i, text in enumerate([*texts, texts[3] + " z", texts[3], "y " + texts[5]])]
    labels, written = [], jaccard_groups.written
    monkeypatch.setattr(jaccard_groups, "written", lambda df, label: labels.append(label) or written(df, label))
    found = jaccard_groups.jaccard_components(_documents(spark, rows), 5, 80, 100).collect()
    assert {r.doc_id: r.component_id for r in found if r.component_id != r.doc_id} == {20: 3, 21: 3, 22: 5}
    assert labels.count("needed") == labels.count("sets") == labels.count("links") == 1, labels


def test_windows_of_many_texts_are_hashed_together(monkeypatch):
    import pyarrow as pa

    rnd = random.Random(9)
    words = "the of and River stone Bridge Anna Bell 12 40 km 3km walk. old Old: 7ft $5 «A» --".split()
    texts = [None, "", " ", "3km", *(" ".join(rnd.choices(words, k=rnd.randrange(60))) for _ in range(400))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(range(len(texts))), pa.array(texts)], list("irt"))
    calls, hashes = [], template_leaks.window_hashes
    monkeypatch.setattr(template_leaks, "window_hashes", lambda *a: calls.append(1) or hashes(*a))

    def found(widths, size):
        monkeypatch.setattr(template_leaks, "PIECE", size)
        calls.clear()
        (out,) = template_leaks._found(widths, None)(iter([batch]))
        return sorted(map(repr, out.to_pylist())), len(calls)

    for widths in (None, [5, 8]):
        whole, few = found(widths, 1 << 18)
        single, many = found(widths, 1)  # a text at a time
        assert whole == single and len(whole) > 1000 and few <= 8 < many
    codes_of = template_leaks.word_codes()
    for row, (text, width) in enumerate((t, 8) for t in texts):
        for reading, codes, values, starts in codes_of(text or "")[0]:
            assert len(starts) == len(codes) + 1 == len(values) + 1
            held = sum(f"'row': {row}, 'reading': {reading}, " in r and f"'width': {width}," in r for r in whole)
            assert held <= max(0, len(codes) - width + 1)


@pytest.mark.parametrize("words", [["red", "7", "blue"], "the of and river stone bridge Anna 12 40 km walk old".split()])
def test_leaks_by_brute_force(spark, words):
    """Every copy of an item is found; whatever is found shares windows with the item."""
    rnd = random.Random(len(words))
    items = [" ".join(rnd.choices(words, k=rnd.randrange(5, 40))) for _ in range(8)]
    docs = []
    for i in range(30):
        parts = [" ".join(rnd.choices(words, k=rnd.randrange(1, 30))) for _ in range(2)]
        docs.append((i, f" . {rnd.choice(items)} . ".join(parts), "", "", 0))
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in template_leaks.find_leaks(_documents(spark, docs), table).collect()}
    codes_of = template_leaks.word_codes()

    def shapes(text, width):
        return {
            h for _, codes, values, _ in codes_of(text)[0]
            for h in template_leaks.window_hashes(codes, values, width).tolist()
        }

    for i, text, *_ in docs:
        for j, item in enumerate(items):
            if f" . {item} . " in f" . {text} . ":
                assert (i, j) in found
            elif (i, j) in found:
                width = min(template_leaks.WINDOW, len(item.split()))
                assert any(shapes(text, w) & shapes(item, w) for w in range(5, width + 1))


def test_value_in_many_repositories_is_an_example(spark):
    few, many = "Zx9" * 8, "Qw7" * 8
    rows = [(i, f"x {many}", "en", "a", 0) for i in range(11)] + [(20 + i, f"x {few}", "en", "a", 0) for i in range(10)]
    spans = {r.doc_id: r.spans for r in secret_ownership.secret_report(_documents(spark, rows)).collect()}
    assert {spans[i] for i in range(11)} == {""} and {spans[20 + i] for i in range(10)} == {"generic:2:26"}


ENGLISH = "the river runs along old walls and every child that lives near there knows which stones are safe to cross".split()
GERMAN = "der fluss zieht an alten mauern vorbei und jedes kind das dort wohnt weiß welche steine man betreten darf".split()
FOREIGN = [
    "Il gatto dorme sul tavolo della cucina mentre la nonna prepara il pranzo per tutta la famiglia",
    "Wczoraj wieczorem poszliśmy do kina ze znajomymi i obejrzeliśmy bardzo ciekawy film o dawnych czasach",
    "Вчера вечером мы пошли в кино с друзьями и посмотрели очень интересный фильм о старых временах",
    "qzx vkjw pqgh zzkx wvbn xqjt kkpz gfdq wxyz jjqk vbnm zxqw hjkl qwrt zpxk vvqj",
]


def _languages():
    rnd = random.Random(9)
    rows = []
    for i in range(120):
        lang, words = [("en", ENGLISH), ("de", GERMAN)][i % 2]
        rows.append((i, " ".join(rnd.choices(words, k=rnd.randrange(40, 80))), lang, f"src{i % 3}", 0))
    odd = [(1000 + 2 * i + j, t, lang, "src1", 0) for i, t in enumerate(FOREIGN) for j, lang in enumerate([None, "en"])]
    return rows, odd


def test_foreign_and_junk_texts_are_refused(spark):
    rows, odd = _languages()
    labelled = _documents(spark, rows)
    judged = language_fusion.identify_documents(_documents(spark, rows + odd), labelled).collect()
    assert all(r.kept and r.language == r.lang for r in judged if r.doc_id < 1000)
    assert not any(r.kept for r in judged if r.doc_id >= 1000)
    italian = [(2000 + i, " ".join(random.Random(i).choices(FOREIGN[0].split(), k=40)), "it", "src1", 0) for i in range(60)]
    both = language_fusion.identify_documents(_documents(spark, rows + italian)).collect()
    assert all(r.kept and r.language == r.lang for r in both)


def test_languages_of_pages(spark):
    """Text outweighs a wrong declaration; where the text says little, markup, suffix and host do."""
    rows, _ = _languages()
    labelled = _documents(spark, [*rows, (500, rows[0][1], "unknown", "s", 0), (501, rows[1][1], "und", "s", 0)])
    assert language_fusion.labelled_languages(labelled) == ["de", "en"]
    page = '<!DOCTYPE html><html class="x"{0}><style>p {{ the: and }}</style><body><p class="river old walls">{1}</p></body></html>'
    german, english = rows[1][1], rows[0][1]
    pages = [
        (1, "http://a.example.com/x", page.format(' lang="en"', german)),
        (2, "http://a.example.com/x", page.format(" lang='de-AT'", "a")),
        (3, "http://kurz.de/x", page.format("", "a")),
        *[(10 + i, f"http://www.blog.org/{i}", page.format("", rows[2 * i + 1][1])) for i in range(20)],
        (4, "https://user@WWW.blog.org:80?q", page.format("", "a")),
        (5, None, page.format(' lang="en"', english * 500)),
        (6, "no url", None),
        (7, "http://a.example.com/", ""),
        (8, "http://a.example.com/", "<script>" + english + "</script><!-- " + english + " -->"),
    ]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    clash = table.withColumns({"language": F.lit("xx"), "kept": F.lit(1), "host": F.lit(0), "__page": F.lit("")})
    judged = language_fusion.identify_pages(clash, labelled)
    assert sorted(judged.columns) == sorted(["page_id", "url", "html", "declared", "host", "language", "posterior", "kept"])
    got = {r.page_id: r for r in judged.collect()}
    assert [got[i].language for i in (1, 2, 3, 4, 5)] == ["de", "de", "de", "de", "en"]
    assert all(got[i].kept for i in (1, 2, 3, 4, 5)) and not any(got[i].kept for i in (6, 7, 8))
    assert got[4].host == "www.blog.org" and got[2].declared == "de-AT" and got[3].declared is None
    assert language_fusion.identify_pages(table.limit(0), labelled).count() == 0


def test_pipeline_by_brute_force(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    rows, odd = _languages()
    item = " ".join(random.Random(3).sample(ENGLISH, 18))
    copies = [(2000, rows[4][1], "en", "src0", 0)]
    leaks = [(2001, rows[6][1] + " " + item + " " + rows[8][1], "en", "src1", 0)]
    none = [(2002, None, None, None, 0), (2003, "", "en", "src1", 0), (2004, "12 34", "en", "src1", 0)]
    docs = rows + odd + copies + leaks + none
    _documents(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {r[0] for r in rows}


CLASHING = "language posterior kept __host __row __number __key __live __gone __t1 __leak __text c0 id a.b Kept2".split()


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_of_any_column_names(spark, tmp_path, name, stage):
    """Other columns of any name go through a stage unchanged; null rows and no rows are no error."""
    pytest.importorskip("public_tokenizers")
    rows, _ = _languages()
    item = " ".join(random.Random(3).sample(ENGLISH, 18))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    plain = _documents(spark, [*rows[:30], *[(None,) * 5] * 2, (900, _secret("aB3" * 9), "en", "src1", 0)])
    usual = stage(spark, plain, str(tmp_path))
    mark = F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))
    wide = plain.select("*", *[F.concat(F.lit(c + "="), mark).alias(c) for c in CLASHING])
    got = stage(spark, wide, str(tmp_path))
    key = lambda row: str([row[c] for c in usual.columns])
    kept = got.collect()
    assert sorted(map(key, kept)) == sorted(map(key, usual.collect()))
    if name != "tokens":
        assert got.columns == wide.columns
        for row in kept:
            of = "none" if row.doc_id is None else row.doc_id
            assert [row[len(plain.columns) + i] for i in range(len(CLASHING))] == [f"{c}={of}" for c in CLASHING]
    assert stage(spark, wide.limit(0), str(tmp_path)).count() == 0


def test_languages_replace_columns_of_their_names(spark):
    rows, _ = _languages()
    plain = _documents(spark, rows[:40])
    clash = plain.withColumns({c: F.lit("x") for c in ["Language", "posterior", "kept", "__host", "__prior", "a.b"]})
    usual = language_fusion.identify_documents(plain)
    judged = language_fusion.identify_documents(clash)
    assert judged.columns == [*plain.columns, "__host", "__prior", "a.b", "language", "posterior", "kept"]
    assert sorted(judged.select(usual.columns).collect()) == sorted(usual.collect())
