"""URL rules by a sort-merge range join with a sweep over nested prefix rules.

A rule names a host and the start of a path. Its canonical key is the reversed host, a bracket
and the path, so the URLs that one host rule covers form an interval of keys. A URL is looked up
under its own host and every parent domain. Rules open and close their interval; one sorted
sweep over all openings, closings and URLs keeps the stack of open rules, and its top is the
longest rule of that domain. The longest over the domains wins, ties go to the longer host.

The sweep is split by key range. What a range starts with (depth and stack) follows from the
ranges before it, one row per range. Equal addresses are merged before the sweep, so a crowded
address or host is swept once. Everything is DataFrame operations; rules may be many.

Null URLs and those without ``://`` have an empty host and path and match no rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmill.session import written

OPEN, POINT, CLOSE = 0, 1, 2


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    split = lambda i: F.when(
        at > 0, F.regexp_extract(rest, r"(?s)^([^/?#]*)([^?#]*)", i)
    ).otherwise("")
    capitals, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(split(1), capitals, small)
    return F.coalesce(host, F.lit("")), F.coalesce(split(2), F.lit(""))


def canonical_key(host: Column, path: Column) -> Column:
    """Reversed labels, a bracket, the path; bytes, so that order and prefixes are exact."""
    labels = F.reverse(F.split(host, r"\.", -1))
    return F.concat(F.array_join(labels, ","), F.lit(")"), path).cast("binary")


def _rule_events(rules: DataFrame) -> DataFrame:
    """An opening and a closing event per distinct (host, path), with nesting depth.

    Of rules with equal host and path the one with the least verdict stays.
    """
    single = rules.groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    rule = F.struct("host", "path", "verdict").alias("rule")
    key = canonical_key(F.col("host"), F.col("path"))
    # 0xFF sorts behind every byte of UTF-8 text
    return single.select(key.alias("key"), rule).select(
        F.explode(
            F.array(
                F.struct(F.col("key"), F.lit(OPEN).alias("kind"), F.length("key").alias("tie")),
                F.struct(
                    F.concat("key", F.lit(b"\xff")).alias("key"),
                    F.lit(CLOSE).alias("kind"),
                    (-F.length("key")).alias("tie"),
                ),
            )
        ).alias("e"),
        "rule",
    ).select("e.key", "e.kind", "e.tie", "rule")


def _depth(rules: DataFrame) -> int:
    """The deepest nesting possible: path starts of one host, by distinct lengths."""
    lengths = rules.groupBy("host").agg(F.countDistinct(F.length("path")).alias("n"))
    return lengths.agg(F.max("n")).first()[0] or 0


def innermost_rules(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule) for every address (host, path) that some rule fits.

    ``rules`` has host, path, verdict. ``rule`` is a struct of these.
    """
    spark = addresses.sparkSession
    depth = _depth(rules)
    labels = F.split("host", r"\.", -1)
    parents = F.explode(
        F.when(
            F.col("host") != "",
            F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), ".")),
        )
    )
    points = addresses.select("host", "path", parents.alias("parent")).select(
        canonical_key(F.col("parent"), F.col("path")).alias("key"),
        F.lit(POINT).alias("kind"),
        F.lit(0).alias("tie"),
        F.struct("host", "path").alias("address"),
    )
    events = _rule_events(rules).unionByName(points, allowMissingColumns=True)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    step = F.when(F.col("kind") == OPEN, 1).when(F.col("kind") == CLOSE, -1).otherwise(0)
    ranged = written(
        events.withColumn("step", step)
        .repartitionByRange(parts, "key", "kind", "tie", "address")
        .withColumn("range", F.spark_partition_id()),
        "sweep",
    )
    order = ["key", "kind", "tie"]
    inside = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # depth at the start of each range: one row per range
    starts = ranged.groupBy("range").agg(F.sum("step").alias("sum"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("range", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("from"))
    deep = ranged.join(F.broadcast(starts), "range").withColumn(
        "depth", F.col("from") + F.sum("step").over(inside)
    )
    # the last rule opened at each level; levels above the depth are stale and never read
    level = lambda i: F.when((F.col("kind") == OPEN) & (F.col("depth") == i), F.col("rule"))
    levels = range(1, depth + 1)
    last = deep.groupBy("range").agg(
        *[
            F.max_by(level(i), F.when(level(i).isNotNull(), F.struct(*order))).alias(f"end{i}")
            for i in levels
        ],
        F.lit(0).alias("nothing"),
    )
    carried = last.select(
        "range", *[F.last(f"end{i}", ignorenulls=True).over(earlier).alias(f"carry{i}") for i in levels]
    )
    stack = F.array(
        *[
            F.coalesce(F.last(level(i), ignorenulls=True).over(inside), F.col(f"carry{i}"))
            for i in levels
        ]
    )
    if depth:
        top = F.get(stack, (F.col("depth") - 1).cast("int"))
    else:
        top = F.lit(None).cast("struct<host:string,path:string,verdict:string>")
    best = F.struct(
        (F.length("top.host") + F.length("top.path")).alias("length"),
        F.length("top.host").alias("host_length"),
        F.col("top").alias("rule"),
    )
    return (
        deep.join(F.broadcast(carried), "range")  # one row per range
        .withColumn("top", top)
        .where((F.col("kind") == POINT) & F.col("top").isNotNull())
        .groupBy("address.host", "address.path")
        .agg(F.max(best).alias("best"))
        .select("host", "path", F.col("best.rule").alias("rule"))
    )


def judge_urls(
    pages: DataFrame, rules: DataFrame, url: str = "url", otherwise: str = "allow"
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (host and path as text) and ``verdict``."""
    host, path = url_parts(F.col(url))
    split = pages.withColumn("host", host).withColumn("path", path)
    addresses = split.select("host", "path").distinct()
    found = innermost_rules(addresses, rules)
    return (
        split.join(found.withColumnRenamed("rule", "__rule"), ["host", "path"], "left")
        .withColumn("rule", F.concat("__rule.host", "__rule.path"))
        .withColumn("verdict", F.coalesce("__rule.verdict", F.lit(otherwise)))
        .drop("__rule")
    )
