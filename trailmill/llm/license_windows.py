"""License texts in documents: MinHash bands over overlapping windows, then exact containment.

A template of m shingles is looked for in windows of 2 c shingles that start every c words, where
c is the least window class of m or more (classes grow by a quarter). Some window holds a whole
occurrence; it shares 0.8 m shingles at least, a Jaccard similarity of 0.29 or more. With one row
a band the chance that no band agrees is (1 - 0.29)^bands: about one in a million at 40 bands.
What the bands retrieve is verified by exact containment of the template's shingles.

Only texts that can hold a template are cut into windows: for every template some words
(anchors) are chosen so that more than a fifth of its shingles hold one; a text without any
anchor cannot reach 0.8. That test loses nothing and is one pass of a regular expression. For the
same reason only windows that hold an anchor are hashed.

All of it is DataFrame operations. Words are runs of ASCII letters and digits, lower-cased.
Null and empty texts, and templates without words, match nothing. A template with fewer words
than a shingle is one shingle of all its words. Repeated rows give repeated results.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
CONTAINED = 0.8
BANDS = 40
CLASS_GROWTH = 1.25

# Short notices and grants of public licenses.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
        "except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("MIT", "Released under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
        "and associated documentation files (the \"Software\"), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions:",
    ),
    (
        "GPL-3.0",
        "This work is licensed under the GNU General Public License, version 3.",
    ),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the "
        "GNU General Public License as published by the Free Software Foundation, either version 3 of "
        "the License, or (at your option) any later version.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met:",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    (
        "CC-BY-4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
]


def template_table(spark: SparkSession, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    rows = [(i, name, text) for i, (name, text) in enumerate(templates)]
    return spark.createDataFrame(rows, "template_id int, license string, template string")


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+", -1), lambda w: w != "")


def shingles_of(words: Column) -> Column:
    """Distinct hashes of all runs of SHINGLE words; fewer words are one shingle, none are none."""
    n = F.size(words)
    count = F.greatest(n - (SHINGLE - 1), F.lit(1))
    runs = F.transform(
        F.sequence(F.lit(1), count), lambda i: F.xxhash64(F.array_join(F.slice(words, i, SHINGLE), " "))
    )
    return F.when(n > 0, F.array_distinct(runs)).otherwise(F.array().cast("array<long>"))


def _minhash(shingles: Column, band: int) -> Column:
    return F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, F.lit(band))))


def _minhashes(shingles: Column, bands: int) -> Column:
    """One struct (band, hash) per band; each band is one row of the MinHash signature."""
    return F.array(
        *[F.struct(F.lit(k).alias("band"), _minhash(shingles, k).alias("hash")) for k in range(bands)]
    )


def _plain_words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def window_class(shingles: int) -> int:
    """The least member of 1, 2, 3, ... (growing by a quarter) that is not below ``shingles``."""
    size = 1
    while size < shingles:
        size = max(size + 1, math.floor(size * CLASS_GROWTH))
    return size


def anchors(templates: list[str]) -> list[str]:
    """Words such that more than 1 - CONTAINED of every template's shingles hold one of them.

    The longest words are taken first: they are the rarest in other texts.
    """
    chosen: set[str] = set()
    for text in templates:
        words = _plain_words(text)
        runs = {tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))} if words else set()
        for word in sorted(set(words), key=lambda w: (w not in chosen, -len(w), w)):
            if sum(any(w in chosen for w in run) for run in runs) > (1 - CONTAINED) * len(runs) + 1e-9:
                break
            chosen.add(word)
    return sorted(chosen)


def find_licenses(
    docs: DataFrame,
    templates: DataFrame,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    bands: int = BANDS,
) -> DataFrame:
    """``keep``, template_id, license, containment and first window place of every match.

    One row per document and template: its best window, the earliest of equals. ``templates`` is
    a small table (template_id, license, template): the caller's list of license texts.
    """
    listed = templates.collect()  # the given list of license texts, not corpus data
    rows = [
        (r["template_id"], r["license"], r["template"], window_class(len(words) - SHINGLE + 1))
        for r in listed
        if (words := _plain_words(r["template"] or ""))
    ]
    spark = docs.sparkSession
    known = spark.createDataFrame(rows, "template_id int, license string, template string, size int")
    known = known.withColumn("wanted", shingles_of(words_of(F.col("template")))).drop("template")
    sizes = sorted({r[3] for r in rows})
    words = anchors([r[2] for r in rows])
    pattern = r"(?i)(?<![a-z0-9])(?:" + "|".join(words) + ")(?![a-z0-9])" if words else "(?!)"

    able = docs.where(F.col(text).rlike(pattern)).select(
        *[F.col(c) for c in keep], words_of(F.col(text)).alias("__words")
    ).withColumn("__row", F.monotonically_increasing_id())
    starts = lambda size: F.transform(
        F.sequence(F.lit(0), F.floor((F.size("__words") - 1) / size).cast("int")),
        lambda k: F.struct(F.lit(size).alias("size"), (k * size).alias("at")),
    )
    none = F.array().cast("array<struct<size:int,at:int>>")
    within = F.slice("__words", F.col("w.at") + 1, 2 * F.col("w.size") + SHINGLE - 1)
    # what holds for texts holds for windows: without an anchor none reaches the containment
    anchored = F.arrays_overlap(within, F.array(*[F.lit(w) for w in words]).cast("array<string>"))
    windows = able.select(
        *keep, "__row", "__words", F.explode(F.concat(none, *[starts(s) for s in sizes])).alias("w")
    ).where(anchored).select(*keep, "__row", "w.size", "w.at", shingles_of(within).alias("__held"))
    banded = windows.select("*", F.explode(_minhashes(F.col("__held"), bands)).alias("b"))
    sought = known.select(
        "template_id", "size", F.explode(_minhashes(F.col("wanted"), bands)).alias("b")
    ).select("template_id", "size", "b.band", "b.hash")
    # a window is verified once for each template, in the first band that retrieves it
    retrieved = (
        banded.select("*", "b.band", "b.hash")
        .drop("b")
        .join(F.broadcast(sought), ["size", "band", "hash"])  # bands rows for each given template
        .groupBy("__row", "size", "at", "template_id")
        .agg(*[F.first(c).alias(c) for c in keep], F.first("__held").alias("__held"))
    )
    share = F.size(F.array_intersect("__held", "wanted")) / F.size("wanted")
    return (
        retrieved.join(F.broadcast(known.drop("size")), "template_id")
        .withColumn("containment", share)
        .where(F.col("containment") >= CONTAINED)
        .groupBy("__row", "template_id", "license")
        .agg(
            *[F.first(c).alias(c) for c in keep],
            F.max(F.struct("containment", (-F.col("at")).alias("back"))).alias("best"),
        )
        .select(
            *keep,
            "template_id",
            "license",
            F.col("best.containment").alias("containment"),
            (-F.col("best.back")).alias("word_start"),
        )
    )
