"""Registered queries of the operators on texts, with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trailmill.llm import (
    bpe_monoid,
    fill_middle,
    host_quality,
    importance_resampling,
    jaccard_groups,
    language_fusion,
    license_windows,
    line_dedup,
    ring_sharding,
    secret_ownership,
    template_leaks,
    url_sweep,
    wrapper_induction,
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _kind_sql(order: int, pattern: str, group: int, least: int) -> str:
    rule = _quoted(pattern)
    return f"""SELECT doc_id, source, text, {order} AS ord, {least} AS least,
      regexp_split_to_array(text, {rule}) AS gaps, regexp_extract_all(text, {rule}, 0) AS hits,
      regexp_extract_all(text, {rule}, {group}) AS vals FROM d"""


_ALL_KINDS = [
    *[(order, *kind[1:]) for order, kind in enumerate(secret_ownership.KINDS)],
    (secret_ownership.GENERIC_ORDER, secret_ownership.GENERIC, 0, secret_ownership.GENERIC_LEAST),
]
_NAMES = "['assign', 'access', 'hex', 'generic']"
_AS_TEXT = f"string_agg({_NAMES}[ord + 1] || ':' || b || ':' || e, ',' ORDER BY b, ord)"

SECRETS_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(_kind_sql(*kind) for kind in _ALL_KINDS)}),
each AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM found),
spans AS (
  SELECT doc_id, source, ord, length(hits[i]) AS n, vals[i] AS val,
    list_sum(list_transform(gaps[1:i], lambda x: length(x)))
      + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS b
  FROM each WHERE length(vals[i]) >= least
    AND (ord < 3 OR (regexp_matches(vals[i], '[0-9]') AND regexp_matches(vals[i], '[a-z]')
      AND regexp_matches(vals[i], '[A-Z]')))),
ends AS (SELECT doc_id, source, ord, val, CAST(b AS BIGINT) AS b, CAST(b + n AS BIGINT) AS e FROM spans),
kept AS (
  SELECT * FROM ends s WHERE ord < 3 OR NOT EXISTS (
    SELECT 1 FROM ends o WHERE o.doc_id = s.doc_id AND o.ord < 3 AND o.b < s.e AND s.b < o.e)),
owners AS (
  SELECT val, count(DISTINCT coalesce(source, '')) > 1 OR count(DISTINCT doc_id) > 10 AS example
  FROM kept GROUP BY val),
judged AS (
  SELECT doc_id,
    count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access,
    count(*) FILTER (ord = 2) AS n_hex,
    {_AS_TEXT} FILTER (ord < 3) AS base,
    {_AS_TEXT} FILTER (ord < 3 OR NOT example) AS spans,
    count(*) FILTER (NOT example) AS n_live,
    count(*) FILTER (example AND ord < 3) AS n_example
  FROM kept JOIN owners USING (val) GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
  coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM d LEFT JOIN judged USING (doc_id)
"""


@query(SECRETS_SQL)
def op1_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_ownership.secret_report(table(spark, sf_dir, "documents"))


@query()
def op2_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring_sharding.shard_documents(table(spark, sf_dir, "documents"), shards=24)


@query()
def op3_license_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    templates = license_windows.template_table(spark)
    return license_windows.find_licenses(table(spark, sf_dir, "documents"), templates)


@query()
def op4_bpe_monoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_monoid.token_digests(table(spark, sf_dir, "documents"))


@query()
def op5_jaccard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return jaccard_groups.jaccard_components(docs, width=3, num=90, den=100)


# Host, path, verdict.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

URLS_SQL = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut),
r(rule_host, rule_path, verdict) AS (VALUES {", ".join(str(rule) for rule in URL_RULES)}),
fits AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
    arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM p, r
  WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM p LEFT JOIN fits USING (page_id)
"""


@query(URLS_SQL)
def op6_url_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_sweep.judge_urls(pages, rules).drop("url")


_RATES = ", ".join(
    f"""CASE WHEN var_pop(f_{n} / c) OVER () > 0
      AND avg(f_{n} / c) OVER () * (1 - avg(f_{n} / c) OVER ()) / var_pop(f_{n} / c) OVER () > 1
    THEN avg(f_{n} / c) OVER () * (1 - avg(f_{n} / c) OVER ()) / var_pop(f_{n} / c) OVER () - 1
    ELSE avg(c) OVER () END AS w_{n}, avg(f_{n} / c) OVER () AS m_{n}"""
    for n in host_quality.HOST_RULES
)
_FAILS = ", ".join(
    f"count(*) FILTER ({rule}) AS f_{name}" for name, rule in host_quality.HOST_RULES.items()
)
_SHRUNK = ", ".join(f"(f_{n} + w_{n} * m_{n}) / (c + w_{n})" for n in host_quality.HOST_RULES)

QUALITY_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word,
    generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS i FROM d),
t AS (SELECT doc_id, i, word AS a, lead(word) OVER o AS b, lead(word, 2) OVER o AS c FROM w
  WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
again AS (SELECT doc_id, i FROM t WHERE c IS NOT NULL
  QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(3) r(k) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dup FROM lines
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
c AS (
  SELECT doc_id, host, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_lines, 0) AS n_lines, coalesce(dup, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN l USING (doc_id)),
hosts AS (SELECT host, count(*) AS c, {_FAILS} FROM c GROUP BY host),
rates AS (SELECT *, {_RATES} FROM hosts),
verdicts AS (SELECT host, greatest({_SHRUNK}) > {host_quality.MAX_HOST_RATE} AS host_refused FROM rates)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  {host_quality.HOST_RULES["base"]} AS base_failed,
  NOT ({host_quality.HOST_RULES["base"]}) AND NOT host_refused AS kept, host_refused
FROM c JOIN verdicts USING (host)
"""


@query(QUALITY_SQL)
def op7_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_quality.judge_quality(table(spark, sf_dir, "documents"))


@query()
def op8_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return language_fusion.identify_documents(docs).select("doc_id", "language", "posterior", "kept")


@query()
def op8_page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    labelled = table(spark, sf_dir, "documents").select("text", "lang")
    judged = language_fusion.identify_pages(pages, labelled)
    return judged.select("page_id", "declared", "host", "language", "posterior", "kept")


@query()
def op9_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    return template_leaks.find_leaks(table(spark, sf_dir, "documents"), items)


@query()
def op10_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper_induction.extract_text(table(spark, sf_dir, "pages"))


# DuckDB has no crc32: the table of its 256 bytes from the rule, then one step per byte.
RESAMPLING_SQL = r"""
WITH crc AS (
  SELECT list(v ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)),
      lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v
    FROM range(256) r(i)) t),
d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word FROM d),
v AS (
  SELECT unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
bytes AS (
  SELECT word, list_transform(range(1, octet_length(encode(word)) + 1),
    lambda i: CAST('0x' || substr(hex(encode(word)), 2 * i - 1, 2) AS BIGINT)) AS b
  FROM (SELECT word FROM w UNION SELECT word FROM v) u),
hashed AS (
  SELECT word, xor(4294967295, list_reduce(list_prepend(4294967295, b),
    lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]))) % 10000 AS bucket
  FROM bytes, crc),
s AS (SELECT bucket, count(*) AS s FROM w JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM v JOIN hashed USING (word) GROUP BY bucket),
gains AS (
  SELECT r.bucket, CAST(floor(1000 * ln(
    CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST((SELECT count(*) FROM w) + 10000 AS DOUBLE)
    / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * CAST((SELECT count(*) FROM v) + 10000 AS DOUBLE)))) AS BIGINT) AS gain
  FROM range(10000) r(bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
sums AS (
  SELECT doc_id, count(*) AS n, CAST(sum(gain) AS BIGINT) AS total
  FROM w JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT doc_id, coalesce(n, 0) AS n_features,
    CASE WHEN n IS NULL THEN 0 ELSE (total - ((total % n) + n) % n) // n END AS weight,
    CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + CAST(0.5 AS DOUBLE))
      / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS noise
  FROM d LEFT JOIN sums USING (doc_id)),
ranked AS (
  SELECT *, weight + noise AS score, n_features >= 20 AS able,
    row_number() OVER (PARTITION BY n_features >= 20 ORDER BY weight + noise DESC, doc_id) AS place
  FROM scored)
SELECT doc_id, n_features, weight, score,
  CASE WHEN able AND place <= (SELECT count(*) FROM ranked WHERE able) * 10 // 100 THEN place END AS rank
FROM ranked
"""


@query(RESAMPLING_SQL)
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return importance_resampling.resample(docs, target)


_ENDS = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"

LINES_SQL = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, {_ENDS}), '{line_dedup.UPPER}', '{line_dedup.LOWER}') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key),
g AS (SELECT k.*, coalesce(doc_id <> first, false) AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM g GROUP BY doc_id
"""


@query(LINES_SQL)
def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated(table(spark, sf_dir, "documents"))


_H = "CAST('0x' || substr(sha256('1:' || doc_id), {}, 8) AS UBIGINT)"

MIDDLE_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS BIGINT) AS n,
    {_H.format(1)} AS h1, {_H.format(9)} AS h2, {_H.format(17)} AS h3, {_H.format(25)} AS h4
  FROM documents),
cuts AS (
  SELECT *, CAST(least(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS a,
    CAST(greatest(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS b,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
      OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
parts AS (
  SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix
  FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text
    WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""


@query(MIDDLE_SQL)
def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.middle_digests(table(spark, sf_dir, "documents"))
