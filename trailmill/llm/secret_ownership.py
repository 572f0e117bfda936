"""Secrets in texts, judged by how many owners and repositories hold the same value.

Every text is searched for values after names such as ``password``, for access keys and for long
hexadecimal runs (the base kinds), and for long mixed tokens (``generic``). The hash of every
value is counted over the whole corpus: by distinct owners and distinct repositories. A value
that several owners or many repositories hold is a copied example; a value of one owner in a few
repositories looks live. Base spans always stay; a generic token becomes a span only where it looks live and no base span touches it.

All of it is DataFrame operations. Positions are code points, ends are exclusive. Null text is
searched as an empty one; a null owner is an owner of its own. Rows are never merged: a repeated
row gives a repeated result row, and adds nothing to the number of owners.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmill.operators.joins import left_join_unique
from trailmill.session import written

# The base kinds in their order, the group that holds the value, its least length.
ASSIGN = (
    r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?"
    r"([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = (("assign", ASSIGN, 2, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24))
# What a text must hold before the costlier search for positions is worth it.
SIGNS = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}

# A value looks live up to so many owners and repositories.
MAX_OWNERS = 1
MAX_REPOSITORIES = 10

GENERIC = r"[A-Za-z0-9+/_=-]+"
GENERIC_LEAST = 20
GENERIC_ORDER = len(KINDS)

SPAN = "array<struct<start:int,ord:int,end:int,value:string>>"
CUT = "array<struct<start:int,end:int>>"


def _spans(text: Column, sign: str, pattern: str, group: int, least: int, order: int) -> Column:
    """All matches as structs (start, ord, end, value); too short values are left out.

    The pieces between matches come from ``split``; running sums of their lengths and of the
    matches' lengths give the positions.
    """
    rule = F.lit(pattern)
    found = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, rule, F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, rule, F.lit(group)).alias("value"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + F.length(x["gap"])
        end = begin + F.length(x["hit"])
        span = F.struct(
            begin.alias("start"), F.lit(order).alias("ord"), end.alias("end"), x["value"].alias("value")
        )
        keep = F.length(x["value"]) >= least
        return F.struct(
            F.coalesce(end, begin).alias("at"),
            F.when(keep, F.concat(state["out"], F.array(span).cast(SPAN)))
            .otherwise(state["out"])
            .alias("out"),
        )

    spans = F.aggregate(found, start, step, lambda state: state["out"])
    return F.when(text.rlike(sign), spans).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """Spans of the base kinds by start, then kind."""
    parts = [
        _spans(text, SIGNS[name], pattern, group, least, order)
        for order, (name, pattern, group, least) in enumerate(KINDS)
    ]
    return F.sort_array(F.concat(*parts))


def generic_spans(text: Column) -> Column:
    """Long tokens that hold a digit, a small and a capital letter."""
    sign = f"[A-Za-z0-9+/_=-]{{{GENERIC_LEAST}}}"
    spans = _spans(text, sign, GENERIC, 0, GENERIC_LEAST, GENERIC_ORDER)
    mixed = lambda x: (
        x["value"].rlike("[0-9]") & x["value"].rlike("[a-z]") & x["value"].rlike("[A-Z]")
    )
    return F.filter(spans, mixed)


def untouched(spans: Column, by: Column) -> Column:
    return F.filter(
        spans,
        lambda x: ~F.exists(by, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])),
    )


def written_spans(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    names = F.array(*[F.lit(kind[0]) for kind in KINDS], F.lit("generic"))
    return F.array_join(
        F.transform(
            spans,
            lambda x: F.concat_ws(
                ":", F.get(names, x["ord"]), x["start"].cast("string"), x["end"].cast("string")
            ),
        ),
        ",",
    )


def searched(
    docs: DataFrame, text: str, owner: str, repository: str, keep: list[Column]
) -> DataFrame:
    """``keep`` columns, owner, repository, base and generic spans of every row; no text."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return (
        docs.select(
            *keep,
            F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("__owner"),
            F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("__repo"),
            base_spans(whole).alias("__base"),
            generic_spans(whole).alias("__generic"),
        )
        .withColumn("__generic", untouched(F.col("__generic"), F.col("__base")))
    )


def ownership(candidates: DataFrame) -> DataFrame:
    """(hash) -> rows, distinct owners and distinct repositories that hold it.

    ``candidates`` has hash, owner, repo. Equal triples are merged per task before any shuffle.
    """
    held = candidates.groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    return held.groupBy("hash").agg(
        F.sum("n").alias("n_rows"),
        F.countDistinct("owner").alias("n_owners"),
        F.countDistinct("repo").alias("n_repos"),
    )


def _candidates(found: DataFrame, key: str) -> DataFrame:
    spans = F.explode(F.concat("__base", "__generic")).alias("s")
    return found.select(key, "__owner", "__repo", spans).select(
        key,
        F.col("__owner").alias("owner"),
        F.col("__repo").alias("repo"),
        F.struct("s.start", "s.ord", "s.end", "s.value").alias("span"),
        F.sha2("s.value", 256).alias("hash"),
    )


def find_secrets(
    docs: DataFrame,
    text: str = "text",
    owner: str = "source",
    repository: str = "doc_id",
    keep: tuple[str, ...] = ("doc_id",),
    max_owners: int = MAX_OWNERS,
    max_repositories: int = MAX_REPOSITORIES,
) -> DataFrame:
    """One row per document: ``keep``, ``base`` spans, ``spans`` (all), ``n_live``, ``n_example``.

    ``max_owners`` and ``max_repositories`` are the largest numbers of distinct owners and
    repositories of a value that still looks live.
    """
    found = written(
        searched(docs, text, owner, repository, [F.col(c) for c in keep]).withColumn(
            "__row", F.monotonically_increasing_id()
        ),
        "secrets",
    )
    candidates = _candidates(found, "__row")
    counted = ownership(candidates.select("hash", "owner", "repo"))
    live = (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repositories)
    counted = written(counted, "ownership")
    often = counted.select(F.xxhash64("hash").alias("hash"), F.col("n_rows").alias("n"))
    judged = (
        left_join_unique(candidates, counted, "hash", often)
        .where(live | (F.col("span.ord") < GENERIC_ORDER))
        .groupBy("__row")
        .agg(
            F.sort_array(F.collect_list("span")).alias("__spans"),
            F.sum(live.cast("long")).alias("n_live"),
            F.sum((~live).cast("long")).alias("n_example"),
        )
    )
    return found.join(judged, "__row", "left").select(
        *keep,
        F.col("__base").alias("base"),
        F.coalesce("__spans", F.array().cast(SPAN)).alias("spans"),
        F.coalesce("n_live", F.lit(0).cast("long")).alias("n_live"),
        F.coalesce("n_example", F.lit(0).cast("long")).alias("n_example"),
    )


def secret_report(docs: DataFrame, **options) -> DataFrame:
    """Digest of ``find_secrets``: counts per kind, hash of the base spans, all spans as text."""
    found = find_secrets(docs, **options)
    count = lambda order: F.size(
        F.filter("base", lambda x: x["ord"] == order)
    ).cast("long")
    return found.select(
        "doc_id",
        *[count(order).alias(f"n_{kind[0]}") for order, kind in enumerate(KINDS)],
        F.sha2(written_spans(F.col("base")), 256).alias("base_sha256"),
        written_spans(F.col("spans")).alias("spans"),
        "n_live",
        "n_example",
    )


def redact_secrets(
    docs: DataFrame,
    text: str = "text",
    owner: str = "source",
    repository: str = "doc_id",
    key: str = "doc_id",
    max_owners: int = MAX_OWNERS,
    max_repositories: int = MAX_REPOSITORIES,
    mark: str = "[secret]",
) -> DataFrame:
    """``docs`` with every secret value replaced by ``mark``; rows and other columns stay.

    Only values are cut out: the name before an assigned value stays. Overlapping spans become
    one mark. Null text stays null. Rows are told apart by a number of their own, so ``key`` may be
    null or repeat. Other columns may have any name.
    """
    short = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    text, owner, repository = short[text], short[owner], short[repository]
    rows = docs.select(*[F.col(f"`{c}`").alias(name) for c, name in short.items()])
    numbered = written(rows.withColumn("__number", F.monotonically_increasing_id()), "numbered")
    found = searched(numbered, text, owner, repository, [F.col("__number").alias("__key")])
    generic = written(
        found.where(F.size("__generic") > 0).withColumn("__base", F.array().cast(SPAN)), "generic"
    )
    candidates = _candidates(generic, "__key")
    live = ownership(candidates.select("hash", "owner", "repo")).where(
        (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repositories)
    )
    per_key = (
        candidates.join(live, "hash")
        .groupBy("__key")
        .agg(F.collect_set("span.value").alias("__live"))
    )
    whole = F.coalesce(F.col(text), F.lit(""))
    held = numbered.join(per_key, F.col("__number") == F.col("__key"), "left").drop("__key")
    base = F.transform(
        base_spans(whole),
        lambda x: F.struct(
            # an assigned value ends its match, so its start follows from its length
            (x["end"] - F.length(x["value"])).alias("start"), x["end"].alias("end")
        ),
    )
    added = F.transform(
        F.filter(
            untouched(generic_spans(whole), base_spans(whole)),
            lambda x: F.array_contains("__live", x["value"]),
        ),
        lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")),
    )
    none = F.array().cast(CUT)
    cuts = F.sort_array(
        F.concat(base.cast(CUT), F.when(F.col("__live").isNotNull(), added.cast(CUT)).otherwise(none))
    )

    def step(state: Column, x: Column) -> Column:
        fresh = x["start"] >= state["at"]
        piece = F.substring(state["text"], state["at"] + 1, x["start"] - state["at"])
        return F.struct(
            F.greatest(state["at"], x["end"]).alias("at"),
            F.when(fresh, F.concat(state["out"], piece, F.lit(mark)))
            .otherwise(state["out"])
            .alias("out"),
            state["text"].alias("text"),
        )

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"), whole.alias("text"))
    rest = lambda s: F.concat(s["out"], F.substring(s["text"], s["at"] + 1, F.length(s["text"])))
    cut = held.withColumn("__cuts", cuts)
    clean = F.when(F.size("__cuts") > 0, F.aggregate("__cuts", start, step, rest)).otherwise(F.col(text))
    return cut.withColumn(text, clean).select(*[F.col(name).alias(c) for c, name in short.items()])
