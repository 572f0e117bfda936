"""Language of texts by fusing evidence with Bayes' rule.

Evidence is the text (byte trigrams), a declared language (markup or metadata), the suffix of an
address, and the host's prior. The priors are smoothed hierarchically: a host's counts lean on
its domain's, a domain's on all documents'. They are grouped aggregations over all documents.

The trigram model is fitted on a bounded sample of labelled rows (about ``sample`` different texts
a language, those with the least hashes); its size is fixed. Every document is scored over its whole text.
Text evidence counts the mean over trigrams times a bounded number of them, as neighbouring
trigrams are not independent; so a long text outweighs the other evidence, a short one does not.

The languages are those of the labels. Beside them stands the background: text of no language
among them. Its evidence is the mean log-likelihood below which a text is not written in the
language that fits it best. That floor is fitted on the labelled sample, every text scored by a
model without itself; it leaves room for a share MIXED of unknown text, and is lower for shorter
texts, whose means scatter more.

A document is kept if it has letters and some language reaches ``min_posterior``; a text won by
the background has no language. Null text is empty: not kept. Null or unknown declared languages, suffixes and hosts are no evidence. Repeated
rows are judged alike and each counts for the priors.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StructField, StructType

from trailmill.llm.batches import small_batches, tidy
from trailmill.operators.joins import left_join_unique
from trailmill.session import written

BUCKETS = 1 << 15
SAMPLE = 2000
EVIDENCE = 40.0
DECLARED_RIGHT = 0.9
SUFFIX_RIGHT = 0.7
SMOOTHING = 20.0
MIN_POSTERIOR = 0.5
DEVIATIONS = 4.0  # of the texts of a language, from their median down to the floor
MIXED = 0.2  # share of a text that may be anything, as quotations, names and code
# Country suffixes that speak for a language.
SUFFIX_LANGUAGE = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "uk": "en", "us": "en", "ie": "en"}


def _trigrams(raw: np.ndarray) -> np.ndarray:
    """Hashed trigrams of bytes; A-Z are a-z, ASCII other than letters is one separator."""
    table = np.arange(256, dtype=np.uint32)
    table[:128] = 32
    for low in range(ord("a"), ord("z") + 1):
        table[low] = table[low - 32] = low
    b = table[raw]
    code = b[:-2] * np.uint32(65599) * np.uint32(65599) + b[1:-1] * np.uint32(65599) + b[2:]
    code ^= code >> np.uint32(15)
    code *= np.uint32(2654435761)
    return (code >> np.uint32(17)).astype(np.int64)


def _batch_bytes(column: pa.Array) -> Iterator[np.ndarray]:
    for value in column:
        raw = value.as_buffer()
        yield np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)


PIECE = 1 << 20


def _pieces(raw: np.ndarray) -> Iterator[np.ndarray]:
    """A text as overlapping pieces that hold each trigram once; short texts are padded."""
    padded = np.concatenate([[32], raw, [32]]).astype(np.uint8)
    for start in range(0, max(1, len(padded) - 2), PIECE):
        yield padded[start : start + PIECE + 2]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(language, bucket, n) per task."""
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for language, raw in zip(batch.column(0).to_pylist(), _batch_bytes(batch.column(1)), strict=True):
            counts = totals.setdefault(language, np.zeros(BUCKETS, np.int64))
            for piece in _pieces(raw):
                counts += np.bincount(_trigrams(piece), minlength=BUCKETS)
    for language, counts in totals.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([language] * len(at)), pa.array(at), pa.array(counts[at])], ["language", "bucket", "n"]
        )


class Model(NamedTuple):
    """Trigrams of some languages, one row each, and what texts of a language reach."""

    weights: np.ndarray  # log-probability of every bucket
    floors: np.ndarray  # median of the texts' means, their own variance, variance by 1 / trigrams


def _scored_alone(counts: np.ndarray, languages: list[str]):
    """(language, n, mean, var) of every text under the model of its language without the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for language, raw in zip(batch.column(0).to_pylist(), _batch_bytes(batch.column(1)), strict=True):
                own = np.zeros(BUCKETS)
                for piece in _pieces(raw):
                    own += np.bincount(_trigrams(piece), minlength=BUCKETS)
                at = np.flatnonzero(own)
                n, own, held = own.sum(), own[at], counts[languages.index(language)]
                logs = np.log((np.maximum(held[at] - own, 0) + 0.5) / (max(held.sum() - n, 0) + 0.5 * BUCKETS))
                mean = float(logs @ own / n) if n else 0.0
                rows.append((language, float(n), mean, float((logs - mean) ** 2 @ own / n) if n else 0.0))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            kinds = [pa.string(), *[pa.float64()] * 3]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["language", "n", "mean", "var"]
            )

    return run


def _floor(n: np.ndarray, mean: np.ndarray, var: np.ndarray) -> tuple[float, float, float]:
    """Median, variance between texts and variance by 1 / trigrams, from a language's texts.

    Neighbouring trigrams share two bytes, so a mean scatters as one of a third as many.
    Medians, as labelled junk must not move the floor.
    """
    if not len(n):  # nothing is known of the language: the background never wins over it
        return 0.0, np.inf, 0.0
    short = 3 * float(np.median(var))
    order = np.argsort(mean)
    share = np.cumsum(n[order]) / n.sum()
    middle = float(mean[order][np.searchsorted(share, 0.5)])  # of texts by length
    spare = (mean - middle) ** 2 * 2.2 - short / n  # 2.2: variance from a median of squares
    return middle, max(0.0, float(np.median(spare))), short


def fit_trigrams(
    labelled: DataFrame, languages: list[str], text: str = "text", label: str = "lang", sample: int = SAMPLE
) -> Model:
    """Log-probability of every trigram bucket per language, from about ``sample`` texts each.

    The sample is every text whose hash lies below a bound that follows from the number of
    different texts of the language; copies count once. Labels count by ``language_code``.
    """
    small_batches(labelled.sparkSession)
    if not languages:
        return Model(np.zeros((0, BUCKETS)), np.zeros((0, 3)))
    named = language_code(F.col(label))
    rows = labelled.where(named.isin(languages) & F.col(text).isNotNull()).select(
        named.alias("language"), F.col(text).cast("binary").alias("raw")
    ).withColumn("hash", F.xxhash64("raw"))
    sizes = rows.groupBy("language").agg(F.approx_count_distinct("hash").alias("n")).collect()
    chosen = F.lit(False)
    for row in sizes:  # one row per language
        share = min(sample, row["n"]) * (1 << 64) // max(1, row["n"])
        bound = min((1 << 63) - 1, share - (1 << 63))
        chosen |= (F.col("language") == row["language"]) & (F.col("hash") <= bound)
    picked = rows.where(chosen).dropDuplicates(["language", "hash"]).select("language", "raw")
    picked = written(picked, "sample")
    counts = picked.mapInArrow(tidy(_counted), "language string, bucket long, n long")
    found = counts.groupBy("language", "bucket").agg(F.sum("n").alias("n")).toPandas()
    held = np.zeros((len(languages), BUCKETS))  # as many rows at most
    at = found["language"].map(languages.index).to_numpy(np.int64)
    held[at, found["bucket"].to_numpy(np.int64)] = found["n"].to_numpy(np.float64)
    smooth = held + 0.5
    alone = picked.mapInArrow(
        _scored_alone(held, languages), "language string, n double, mean double, var double"
    ).where("n > 0").toPandas()  # one row a text of the sample
    floors = []
    for name in languages:
        of = alone[alone["language"] == name]
        floors.append(_floor(*(of[c].to_numpy(np.float64) for c in ("n", "mean", "var"))))
    return Model(np.log(smooth / smooth.sum(axis=1, keepdims=True)), np.array(floors))


def with_text_evidence(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``__text`` (log-likelihood per language, then background) and ``__letters``.

    No shuffle.
    """
    names = docs.columns
    at = names.index(text)
    weights = np.ascontiguousarray(model.weights.T.astype(np.float32))  # BUCKETS rows, always
    middle, between, short = model.floors.T
    last = weights.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.zeros((batch.num_rows, last + 1))
            letters = np.zeros(batch.num_rows, bool)
            for i, raw in enumerate(_batch_bytes(batch.column(at).cast(pa.binary()))):
                n = 0
                for piece in _pieces(raw):
                    buckets = _trigrams(piece)
                    scores[i, :last] += weights[buckets].sum(axis=0, dtype=np.float64)
                    n += len(buckets)
                    letters[i] |= bool(((piece >= 128) | ((piece | 32) - 97 < 26)).any())
                if letters[i] and last:
                    best = int(scores[i, :last].argmax())
                    floor = (1 - MIXED) * middle[best] - MIXED * np.log(BUCKETS)
                    floor -= DEVIATIONS * np.sqrt(between[best] + short[best] / n)
                    scores[i, last] = max(floor, -1e6) * n
                scores[i] *= min(n, EVIDENCE) / n if letters[i] else 0.0
            flat = pa.array(scores.ravel())
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * (last + 1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(ends, flat), pa.array(letters)],
                [*names, "__text", "__letters"],
            )

    added = [StructField("__text", ArrayType(DoubleType())), StructField("__letters", BooleanType())]
    return docs.mapInArrow(tidy(run), StructType([*docs.schema, *added]))


def _softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    powers = F.transform(scores, lambda s: F.exp(s - top))
    return F.transform(powers, lambda p: p / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


# Tags that name no language (undetermined, several, uncoded, no linguistic content).
NO_LANGUAGE = ["und", "mul", "mis", "zxx"]


def language_code(value: Column) -> Column:
    """The language of a tag: its two or three letters before any ``-`` or ``_``, in lower case.

    Anything else (``unknown``, ``english``, ``e1``) names no language.
    """
    code = F.regexp_extract(F.lower(F.trim(value)), "^([a-z]{2,3})(?:[-_].*)?$", 1)
    return F.when(~code.isin("", *NO_LANGUAGE), code)


def labelled_languages(labelled: DataFrame, label: str = "lang", text: str = "text") -> list[str]:
    """All languages of the labels that have a text, in order; by their form at most 18,252."""
    rows = labelled.where(F.col(text).isNotNull()).select(language_code(F.col(label)).alias("code"))
    return sorted(r["code"] for r in rows.where("code IS NOT NULL").distinct().collect())


def _claim(value: Column, languages: list[str], right: float) -> Column:
    """Log-likelihood of a claimed language per class; an unknown claim says nothing.

    The last class is the background, for which every claim is wrong.
    """
    wrong = (1 - right) / max(1, len(languages))
    told = F.array(*[F.log(F.when(value == name, right).otherwise(wrong)) for name in languages], F.log(F.lit(wrong)))
    nothing = F.array(*[F.lit(0.0) for _ in [*languages, None]])
    return F.when(value.isin(languages), told).otherwise(nothing)


def _sum(*parts: Column) -> Column:
    total = parts[0]
    for part in parts[1:]:
        total = F.zip_with(total, part, lambda a, b: a + b)
    return total


def host_priors(scored: DataFrame, languages: list[str]) -> DataFrame:
    """(__host, __prior): log prior of every host per language and of the background.

    ``scored`` has __host, __domain and __soft, the posterior without any prior. A host without
    documents enough leans on its domain, a domain on the whole.
    """
    names = [f"p{i}" for i in range(len(languages) + 1)]
    sums = [F.sum(F.col("__soft")[i]).alias(name) for i, name in enumerate(names)]
    hosts = scored.groupBy("__host", "__domain").agg(*sums)
    add = [F.sum(name).alias(f"d_{name}") for name in names]
    domains = hosts.groupBy("__domain").agg(*add)
    whole = hosts.agg(*[F.sum(name).alias(f"w_{name}") for name in names])  # a single row
    joined = hosts.join(domains, "__domain").join(F.broadcast(whole))

    def level(prefix: str, below: list[Column]) -> list[Column]:
        total = sum((F.col(prefix + name) for name in names), F.lit(0.0))
        return [
            (F.col(prefix + name) + SMOOTHING * under) / (total + SMOOTHING)
            for name, under in zip(names, below, strict=True)
        ]

    even = [F.lit(1.0 / len(names)) for _ in names]
    host = level("", level("d_", level("w_", even)))
    return joined.select("__host", F.array(*[F.log(p) for p in host]).alias("__prior"))


OUTCOMES = ("language", "posterior", "kept")


def _fused(
    docs: DataFrame,
    model: Model,
    languages: list[str],
    text: str,
    declared: Column | None,
    host: Column | None,
    suffix: Column | None,
    min_posterior: float,
) -> DataFrame:
    """The columns of ``docs`` as c0, c1, ... and OUTCOMES, so that no name of theirs can clash.

    The text is scored twice, once for the priors and once for the verdict, instead of being
    shuffled between the two.
    """
    none = F.lit(None).cast("string")
    declared = none if declared is None else language_code(declared)
    host = F.lit("") if host is None else F.coalesce(host.cast("string"), F.lit(""))
    ending = F.element_at(F.split(host, r"\."), -1) if suffix is None else suffix
    country = F.create_map(*[F.lit(x) for pair in SUFFIX_LANGUAGE.items() for x in pair])[ending]
    claims = _sum(_claim(declared, languages, DECLARED_RIGHT), _claim(country, languages, SUFFIX_RIGHT))
    labels = F.split(host, r"\.")
    domain = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")

    given = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    rows = docs.select(*given, claims.alias("__claims"), host.alias("__host"), domain.alias("__domain"))
    body = f"c{docs.columns.index(text)}"
    narrow = rows.select("__claims", "__host", "__domain", F.col(body).alias("text"))
    scored = (
        with_text_evidence(narrow, model)
        .where("__letters")
        .select("__host", "__domain", _softmax(_sum(F.col("__text"), F.col("__claims"))).alias("__soft"))
    )
    priors = written(host_priors(scored, languages), "priors")
    whole = left_join_unique(with_text_evidence(rows, model, body), priors, "__host")
    even = F.array(*[F.lit(0.0) for _ in [*languages, None]])
    fused = whole.withColumn(
        "__fused", _softmax(_sum(F.col("__text"), F.col("__claims"), F.coalesce("__prior", even)))
    )
    best = F.array_max("__fused")
    names = F.array(*[F.lit(name) for name in languages], none)
    language = F.get(names, (F.array_position("__fused", best) - 1).cast("int"))
    known = F.col("__letters") & (best >= min_posterior) & language.isNotNull()
    found = (F.when(F.col("__letters"), language), best, known)
    return fused.select(
        *[f"c{i}" for i in range(len(given))],
        *[value.alias(name) for value, name in zip(found, OUTCOMES, strict=True)],
    )


def identified(
    docs: DataFrame,
    model: Model,
    languages: list[str],
    text: str = "text",
    declared: Column | None = None,
    host: Column | None = None,
    suffix: Column | None = None,
    min_posterior: float = MIN_POSTERIOR,
) -> DataFrame:
    """``docs`` with ``language``, ``posterior`` and ``kept``; columns of these names are replaced."""
    fused = _fused(docs, model, languages, text, declared, host, suffix, min_posterior)
    stay = [(i, c) for i, c in enumerate(docs.columns) if c.lower() not in OUTCOMES]
    return fused.select(*[F.col(f"c{i}").alias(c) for i, c in stay], *OUTCOMES)


def _evidence(docs: DataFrame, labelled: DataFrame | None) -> dict:
    labelled = docs if labelled is None else labelled
    languages = labelled_languages(labelled)
    model = fit_trigrams(labelled, languages)
    return {"model": model, "languages": languages, "declared": F.col("lang"), "host": F.col("source")}


def identify_documents(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """Documents with language, posterior and verdict; ``lang`` is their declared language."""
    return identified(docs, **_evidence(docs, labelled))


def of_known_language(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """Documents that ``identify_documents`` keeps, with all their columns, whatever their names."""
    fused = _fused(docs, text="text", suffix=None, min_posterior=MIN_POSTERIOR, **_evidence(docs, labelled))
    return fused.where("kept").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


# Markup, scripts, styles and comments; character references stand for a space.
MARKUP = r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>|&[#0-9a-z]+;"
DECLARED = r"""(?is)<html\b[^>]*?\slang\s*=\s*["']?\s*([a-z]{2,3}(?:[-_][a-z0-9]+)*)"""
HOST = r"://(?:[^/?#]*@)?([^/?#:]*)"


def identify_pages(
    pages: DataFrame, labelled: DataFrame, url: str = "url", html: str = "html", min_posterior: float = MIN_POSTERIOR
) -> DataFrame:
    """``pages`` with declared, host, language, posterior and kept (columns of these names are replaced).

    All four kinds of evidence speak: the text between the markup, the language that the markup
    declares, the suffix of the host and the host's prior, smoothed by its domain and all pages.
    The trigrams come from ``labelled`` (text, lang). A page without url has no host: it leans on
    all pages. Null html is empty: not kept.
    """
    languages = labelled_languages(labelled)
    model = fit_trigrams(labelled, languages)
    kept = [c for c in pages.columns if c not in ("declared", "host", "language", "posterior", "kept", "__page")]
    rows = pages.select(
        *[F.col(f"`{c}`") for c in kept],
        F.nullif(F.regexp_extract(F.col(f"`{html}`"), DECLARED, 1), F.lit("")).alias("declared"),
        F.nullif(F.lower(F.regexp_extract(F.col(f"`{url}`"), HOST, 1)), F.lit("")).alias("host"),
        F.trim(F.regexp_replace(F.regexp_replace(F.col(f"`{html}`"), MARKUP, " "), r"\s+", " ")).alias("__page"),
    )
    judged = identified(
        rows, model, languages, text="__page", declared=F.col("declared"), host=F.col("host"), min_posterior=min_posterior
    )
    return judged.drop("__page")
