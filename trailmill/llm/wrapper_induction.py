"""Main text of HTML pages by wrapper induction over pages of the same host.

Each page becomes a small tree of block elements with its text runs as leaves; menus, headers,
footers, sidebars, notices, adverts, forms, comments and scripts are left out by element, role
and class, and where a page has an article (or main) element only that counts. The tree of every
page is aligned with one reference tree of its host by simple tree matching; a leaf gets the
slot of the leaf it is aligned with. A slot that holds the same text on nearly all different
pages of a host that fill it is template; slots that vary, and leaves without counterpart, are
content. The share is smoothed by half a page on either side, so few pages must agree more
closely than many (2 of 2, 9 of 10, 81 of 100), and a text on one page is always content. Pages that
share most of their text are versions of one story and count as one page. Hosts with a single page
have nothing to compare.

A header inside an article, main or section element is part of it. A form goes unless it holds an
article or most of the page's text; then only its controls and labels go.

Pages are parsed once. Trees are short strings, so equal trees of a host are aligned once. How
often a slot holds a text is a grouped count over all different pages of the host; only the most
frequent text of a slot can hold it nearly everywhere, so at most one a slot is kept. Nothing is gathered per host.

Null and empty pages have empty text. A null URL's pages form one host. Repeated pages count once
for the template and keep their rows. Nesting beyond DEPTH levels is flattened.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmill.llm.batches import small_batches
from trailmill.llm.url_sweep import url_parts
from trailmill.operators.joins import left_join_unique
from trailmill.session import written

CONSTANT_SHARE = 0.8
MIN_PAGES = 2
DEPTH = 100
# Pages without a text that are added to a host before the text counts as a notice.
NOTICE_WEIGHT = 4.0
# A page with so much of its text on other pages of the host is a version of one of them.
VERSION_SHARE = 0.75

# Elements by role in a page.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset "
    "figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li "
    "main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th "
    "thead tr ul".split()
)
DROPPED = frozenset(
    "aside audio button canvas dialog footer head header input label map menu nav object optgroup "
    "option search select svg video".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSES_PARAGRAPH = BLOCKS - {"body", "caption", "head", "html", "option", "optgroup", "tbody", "td", "tfoot", "th", "thead", "tr"}
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
BOILERPLATE_CLASSES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment "
    "comments consent cookie cookies disqus footer gdpr header login masthead menu modal nav navbar "
    "navigation newsletter notice overlay pager pagination popup promo promoted promotion related "
    "replies reply share sharing sidebar signup skip social sponsor sponsored subscribe "
    "subscription toolbar widget".split()
)
# What may stand beside them in a class name without naming other content.
LAYOUT_PARTS = frozenset(
    "area articles block bottom box btn button buttons card cell col column container desktop form full "
    "global group icon icons inner item items label large left line link links list main mobile "
    "outer page panel posts primary right row secondary section site slot small space stories sub text "
    "title top unit wrap wrapper".split()
)
# Where a header belongs to the text.
HEADED = frozenset("article main section".split())
BOILERPLATE_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search "
    "toolbar".split()
)


def page_parser():
    """A function from HTML to (tree, texts): a string such as ``article(h1(#)p(#))`` and its leaves."""
    import html
    import re

    token = re.compile(
        r"<!--.*?(?:-->|\Z)"
        r"|<(script|style|template|iframe|textarea|title|noscript|noframes)(?=[\s/>]).*?(?:</\1\s*>|\Z)"
        r"|<(/?)([a-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
        r"|<[!?/][^>]*>",
        re.S | re.I,
    )
    attribute = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
    name_part = re.compile("[a-z]+")

    def named(attributes: str) -> dict[str, str]:
        """Attributes by lower-case name; of repeated names the first counts."""
        pairs: dict[str, str] = {}
        for name, value in attribute.findall(attributes):
            if value[:1] in ('"', "'"):
                value = value[1:-1]
            pairs.setdefault(name.lower(), value.strip().lower())
        return pairs

    def boilerplate(name: str) -> bool:
        """A class or id of boilerplate and layout alone, boilerplate first: ``sidebar-left``, but not
        ``has-sidebar`` or ``related-work``."""
        parts = name_part.findall(name)
        return bool(parts) and parts[0] in BOILERPLATE_CLASSES and all(
            part in BOILERPLATE_CLASSES or part in LAYOUT_PARTS for part in parts
        )

    def unwanted(attributes: dict[str, str]) -> bool:
        if "hidden" in attributes or attributes.get("aria-hidden") == "true":
            return True
        if not BOILERPLATE_ROLES.isdisjoint(attributes.get("role", "").split()):
            return True
        return any(boilerplate(name) for key in ("class", "id") for name in attributes.get(key, "").split())

    def parse(page: str) -> tuple[str, list[str]]:
        root = ["body", []]
        stack, run, regions, skipped = [root], [], [], 0  # skipped: open elements when skipping began

        def flush() -> None:
            if run:
                text = " ".join(html.unescape("".join(run)).split())
                run.clear()
                if text:
                    stack[skipped - 2 if skipped else -1][1].append(text)

        def close(depth: int) -> None:
            nonlocal skipped
            if not skipped or depth < skipped - 1:  # what is left out inside a block splits no text
                flush()
            del stack[depth:]
            if skipped >= len(stack) + 1:
                skipped = 0

        def close_within(tags: set, limits: frozenset | set) -> None:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] in tags:
                    close(depth)
                    return
                if stack[depth][0] in limits:
                    return

        at = 0
        for found in token.finditer(page):
            start, end = found.span()
            if start > at and not skipped:
                run.append(page[at:start])
            at = end
            tag = found[3]
            if tag is None:
                continue
            tag = tag.lower()
            if found[2]:
                if tag in BLOCKS or tag in DROPPED:
                    for depth in range(len(stack) - 1, 0, -1):
                        if stack[depth][0] == tag:
                            close(depth)
                            break
                elif skipped and stack[-1][0] == tag:
                    close(len(stack) - 1)
                continue
            attributes = found[4]
            pairs = named(attributes) if attributes else {}
            drop = tag in DROPPED or bool(pairs) and unwanted(pairs)
            if tag == "header" and drop and any(x[0] in HEADED for x in stack):
                drop = bool(pairs) and unwanted(pairs)
            if tag in CLOSES_PARAGRAPH:
                close_within({"p"}, BLOCKS - {"p"})
            if tag in SIBLINGS:
                close_within(*SIBLINGS[tag])
            if tag in VOID or attributes.endswith("/") and tag not in BLOCKS:
                if tag in ("br", "hr") and not skipped:
                    run.append(" ") if tag == "br" else flush()
                continue
            if tag in ("html", "body"):
                continue
            if tag not in BLOCKS and not drop:
                if skipped and stack[-1][0] == tag:
                    stack.append([tag, []])  # so that its end tag does not end the skipping
                continue
            if not skipped and tag in BLOCKS:
                flush()
            node = [tag, []]
            if not skipped and not drop:
                stack[-1][1].append(node)
                if tag in ("article", "main") or "main" in pairs.get("role", "").split():
                    if not any(x[0] == "article" for x in stack):
                        regions.append((tag == "article", node))
            stack.append(node)
            if drop and not skipped:
                skipped = len(stack)
        if at < len(page) and not skipped:
            run.append(page[at:])
        flush()
        gone = _without_forms(root, [node for _, node in regions])
        articles = [node for is_article, node in regions if is_article and id(node) not in gone]
        mains = [node for is_article, node in regions if not is_article and id(node) not in gone]
        return _written_tree(articles or mains or [root])

    return parse


def _without_forms(root: list, regions: list) -> set[int]:
    """Empty the forms of a page; hands back the nodes that were in them.

    A form that holds an article or more than half of the page's text is a frame around the page and
    stays; its controls and labels are left out where they are read.
    """
    order, parents = [root], {id(root): None}
    for node in order:
        for kid in node[1]:
            if not isinstance(kid, str):
                parents[id(kid)] = node
                order.append(kid)
    if not any(node[0] == "form" for node in order):
        return set()
    size: dict[int, int] = {}
    for node in reversed(order):
        size[id(node)] = sum(len(kid) if isinstance(kid, str) else size[id(kid)] for kid in node[1])
    framing = set()
    for node in regions:
        while node is not None and id(node) not in framing:
            framing.add(id(node))
            node = parents.get(id(node))
    gone: set[int] = set()
    for node in order:
        above = parents[id(node)]
        if above is not None and id(above) in gone:
            gone.add(id(node))
        elif node[0] == "form" and id(node) not in framing and 2 * size[id(node)] <= size[id(root)]:
            gone.add(id(node))
    for node in order:
        if id(node) in gone:
            node[1].clear()
    return gone


def _written_tree(nodes: list) -> tuple[str, list[str]]:
    """The tree as a string and its leaves in order; elements without text are left out."""
    out, texts = [], []
    todo = [(node, 0) for node in reversed(nodes)]
    while todo:
        node, depth = todo.pop()
        if node is None:
            if out[-1].endswith("("):
                out.pop()
            else:
                out.append(")")
        elif isinstance(node, str):
            out.append("#")
            texts.append(node)
        else:
            kids = node[1]
            if depth < DEPTH:
                out.append(node[0] + "(")
                todo.append((None, depth))
            todo.extend((kid, depth + 1) for kid in reversed(kids))
    return "".join(out), texts


def read_tree(tree: str) -> list:
    """Nested [label, children] of a written tree; leaves are ['#', []]."""
    import re

    root = ["", []]
    stack = [root]
    for part in re.findall(r"[^()#]+\(|\)|#", tree):
        if part == "#":
            stack[-1][1].append(["#", []])
        elif part == ")":
            stack.pop()
        else:
            node = [part[:-1], []]
            stack[-1][1].append(node)
            stack.append(node)
    return root


def aligned_leaves(page: str, reference: str) -> list[int]:
    """For each leaf of ``page`` the number of the leaf of ``reference`` it is matched with, or -1.

    Simple tree matching: equal labels match, children keep their order, and the number of
    matched nodes is largest. Equal first and last children match before anything is compared.
    """
    one, two = read_tree(page), read_tree(reference)

    def numbered(node: list, count: list[int]) -> None:
        key = ""
        first = count[0]
        if node[0] == "#":
            count[0] += 1
        for kid in node[1]:
            numbered(kid, count)
            key += kid[2]
        node.extend([f"{node[0]}({key})", first])

    numbered(one, [0])
    numbered(two, [0])
    slots: dict[int, int] = {}
    scores: dict[tuple[int, int], int] = {}

    def trimmed(a: list, b: list) -> tuple[int, int]:
        n, head, tail = min(len(a), len(b)), 0, 0
        while head < n and a[head][2] == b[head][2]:
            head += 1
        while tail < n - head and a[-1 - tail][2] == b[-1 - tail][2]:
            tail += 1
        return head, tail

    def table(a: list, b: list) -> list[list[int]]:
        rows = [[0] * (len(b) + 1)]
        for x in a:
            last, row = rows[-1], [0]
            for j, y in enumerate(b):
                row.append(max(last[j + 1], row[j], last[j] + score(x, y)))
            rows.append(row)
        return rows

    def score(x: list, y: list) -> int:
        if x[0] != y[0]:
            return 0
        key = (id(x), id(y))
        if key not in scores:
            a, b = x[1], y[1]
            head, tail = trimmed(a, b)
            same = sum(kid[2].count("(") for kid in a[:head] + a[len(a) - tail :])
            scores[key] = 1 + same + table(a[head : len(a) - tail], b[head : len(b) - tail])[-1][-1]
        return scores[key]

    def match(x: list, y: list) -> None:
        if x[0] == "#":
            slots[x[3]] = y[3]
            return
        a, b = x[1], y[1]
        head, tail = trimmed(a, b)
        for k in range(head):
            match(a[k], b[k])
        for k in range(1, tail + 1):
            match(a[-k], b[-k])
        a, b = a[head : len(a) - tail], b[head : len(b) - tail]
        rows = table(a, b)
        i, j = len(a), len(b)
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                match(a[i], b[j])

    match(one, two)
    return [slots.get(k, -1) for k in range(page.count("#"))]


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    parse = page_parser()
    for batch in batches:
        trees, hashes, sizes, texts = [], [], [], []
        for page in batch.column(batch.num_columns - 1).to_pylist():
            tree, leaves = parse(page or "")
            trees.append(tree)
            texts.append(leaves)
            hashes.append([xxhash.xxh64_intdigest(leaf) - (1 << 63) for leaf in leaves])
            sizes.append([len(leaf) for leaf in leaves])
        yield pa.RecordBatch.from_arrays(
            [
                *batch.columns[:-1],
                pa.array(trees, pa.string()),
                pa.array(hashes, pa.list_(pa.int64())),
                pa.array(sizes, pa.list_(pa.int32())),
                pa.array(texts, pa.list_(pa.string())),
            ],
            [*batch.schema.names[:-1], "tree", "hashes", "sizes", "texts"],
        )


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        host, tree, reference = (batch.column(i) for i in range(3))
        slots = [
            aligned_leaves(*pair) for pair in zip(tree.to_pylist(), reference.to_pylist(), strict=True)
        ]
        yield pa.RecordBatch.from_arrays(
            [host, tree, pa.array(slots, pa.list_(pa.int32()))], ["host", "tree", "slots"]
        )


def _stories(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """(page, story) of different pages: versions of one text have the same story.

    A page is a version if most of its text, by length, is on other pages of its host too. Its story
    is then its longest text that is surely no notice: texts on nearly all pages of a host, by a share that few pages
    cannot reach, are passed over. Any other page is a story of its own.
    """
    leaves = (
        pages.select("page", "host", F.explode(F.arrays_zip("hashes", "sizes")).alias("leaf"))
        .groupBy("page", F.struct("host", F.col("leaf.hashes").alias("leaf")).alias("key"))
        .agg(F.sum("leaf.sizes").alias("length"), F.max("leaf.sizes").alias("size"))
    )
    leaves = written(leaves, "leaves")
    spread = leaves.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    spread = written(
        spread.join(hosts.select("host", "n_pages"), F.col("key.host") == F.col("host")).select("key", "n", "n_pages"),
        "spread",
    )
    often = spread.select(F.xxhash64("key").alias("hash"), "n")
    notice = (F.col("n") + 0.5) / (F.col("n_pages") + NOTICE_WEIGHT) >= CONSTANT_SHARE
    told = F.when(~notice, F.struct("size", F.col("key.leaf").alias("leaf")))
    shared = F.sum(F.when(F.col("n") >= 2, F.col("length")).otherwise(0)) / F.sum("length")
    return (
        left_join_unique(leaves, spread, "key", often)
        .groupBy("page")
        .agg(shared.alias("shared"), F.max(told).alias("longest"))
        .select(
            "page",
            F.when(F.col("shared") >= VERSION_SHARE, F.coalesce("longest.leaf", "page"))
            .otherwise(F.col("page")).alias("story"),
        )
    )


def extract_text(
    pages: DataFrame,
    url: str = "url",
    html: str = "html",
    key: str = "page_id",
    constant_share: float = CONSTANT_SHARE,
    min_pages: int = MIN_PAGES,
) -> DataFrame:
    """``key``, ``url``, ``text`` (blocks joined by line breaks) and ``n_chars`` of every page."""
    small_batches(pages.sparkSession)
    host, _ = url_parts(F.col(url))
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), host.alias("host"), F.col(html).alias("html"))
    kind = dict(rows.dtypes)["key"]
    parsed = written(
        rows.mapInArrow(
            _parsed,
            f"key {kind}, url string, host string, tree string, hashes array<long>, "
            "sizes array<int>, texts array<string>",
        ),
        "parsed",
    )
    different = parsed.select("host", "tree", "hashes", "sizes").distinct()
    different = written(different.withColumn("page", F.monotonically_increasing_id()), "different")
    trees = different.groupBy("host", "tree").agg(F.count(F.lit(1)).alias("n"))
    # the reference is the tree that most pages of the host have, the least of equals
    reference = trees.groupBy("host").agg(
        F.sum("n").alias("n_pages"), F.max(F.struct("n", "tree")).alias("best")
    )
    hosts = written(reference.select("host", "n_pages", F.col("best.tree").alias("reference")), "hosts")
    wide = hosts.where(F.col("n_pages") >= min_pages)
    slots = (
        trees.join(wide, "host")
        .select("host", "tree", "reference")
        .mapInArrow(_aligned, "host string, tree string, slots array<int>")
    )
    slots = written(slots, "slots")
    several = different.join(wide.select("host"), "host", "left_semi")
    filled = several.join(_stories(several, wide), "page").join(slots, ["host", "tree"]).select(
        "host", "story", F.explode(F.arrays_zip("slots", "hashes")).alias("leaf")
    )
    # versions of one story agree because they are one story: they count as one page
    held = filled.where("leaf.slots >= 0").select("host", "leaf.slots", "leaf.hashes", "story").distinct()
    held = written(held, "held")
    counts = held.groupBy("host", "slots", "hashes").agg(F.count(F.lit(1)).alias("n"))
    filling = held.select("host", "slots", "story").distinct().groupBy("host", "slots").agg(
        F.count(F.lit(1)).alias("n_filled")
    )
    share = (F.col("best.n") + 0.5) / (F.col("n_filled") + 1.0)
    constant = (
        counts.groupBy("host", "slots")
        .agg(F.max(F.struct("n", "hashes")).alias("best"))
        .join(filling, ["host", "slots"])
        .where((F.col("best.n") >= 2) & (share >= constant_share))
        .groupBy("host")
        .agg(F.collect_list(F.struct("slots", F.col("best.hashes").alias("hashes"))).alias("template"))
    )
    template = written(constant, "template")
    # pages of hosts without any template keep all their leaves and need no slots
    templated = parsed.join(template.select("host"), "host", "left_semi")
    plain = parsed.join(template.select("host"), "host", "left_anti").select("key", "url", "texts")
    held = left_join_unique(templated.join(slots, ["host", "tree"]), template, "host")
    leaves = F.filter(
        F.arrays_zip("slots", "hashes", "texts"),
        lambda x: ~F.array_contains("template", F.struct(x["slots"].alias("slots"), x["hashes"].alias("hashes"))),
    )
    varying = held.select("key", "url", F.transform(leaves, lambda x: x["texts"]).alias("texts"))
    text = F.array_join("texts", "\n")
    return plain.union(varying).select(
        F.col("key").alias(key), "url", text.alias("text"), F.length(text).cast("long").alias("n_chars")
    )
