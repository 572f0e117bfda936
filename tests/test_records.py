"""Schema, markers, the accept decision, lookups and ids on small inputs."""

import itertools

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import trailmill as tm
from trailmill.operators.clean import ACCEPTED, accept_condition
from trailmill.operators.dictionary import build_dictionary, encode
from trailmill.operators.joins import fits_broadcast, heavy_keys, left_join_unique
from trailmill.operators.lookup import add_lookup
from trailmill.operators.numbering import numbered
from trailmill.options import OptionsError
from trailmill.sources.lookups import LookupTable


def options(**changes):
    return tm.PrepOptions(**(dict(longitude="lo", latitude="la", time="t") | changes))


def frame(spark, rows, columns="la lo t".split()):
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))


GOOD = ("58.3", "26.7", "1700000000")


def prepared(spark, rows, columns="la lo t".split(), **changes):
    return tm.prepare(spark, options(**changes), records=frame(spark, rows, columns))


# -- options ----------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "changes",
    [
        dict(longitude=""), dict(latitude="lo"), dict(default_type="long"), dict(excluded=["la"]),
        dict(float_columns=["t"]), dict(encoded_columns=["t"]), dict(records_per_file=-1),
        dict(encoded_columns=["x"], retained_id_columns=["x"]),
        dict(encoded_columns=["x"], float_columns=["x"]),
    ],
)
def test_bad_options(changes):
    with pytest.raises(OptionsError):
        options(**changes)


@pytest.mark.parametrize(
    "changes",
    [dict(excluded=["zz"]), dict(radius="zz"), dict(column_null_values={"zz": ["1"]}), dict(column_null_values={"la": ["1"]}), dict(first_seen_by=["zz"])],
)
def test_unknown_columns(spark, changes):
    with pytest.raises(OptionsError):
        prepared(spark, [GOOD], **changes)


def test_names_are_trimmed_but_string_markers_are_not(spark):
    o = options(excluded=[" x "], string_null_values=[" n/a"])
    assert o.excluded == ("x",) and o.string_null_values == [" n/a"]


def test_same_output_name_twice(spark):
    with pytest.raises(ValueError, match="twice"):
        prepared(spark, [(*GOOD, "1")], ["la", "lo", "t", "lat"])


# -- schema -----------------------------------------------------------------------------------


def test_inference_order(spark):
    columns = ["la", "lo", "t", "num", "txt", "none", "moment", "code", "x_IDs"]
    row = (*GOOD, "1.5", "abc", None, "1700000001", "12", "77")
    run = prepared(spark, [row], columns, encoded_columns=["code"], retained_id_columns=["txt"])
    kinds = {c.name: (c.kind, c.role) for c in run.columns if c.role != "geometry"}
    assert kinds == {
        "lat": ("double", "lat"), "lon": ("double", "lon"), "time": ("long", "time"),
        "num": ("float", "value"), "txt": ("string", "value"), "none": ("string", "value"),
        "moment": ("long", "moment"), "code": ("long", "encoded"), "x_IDs": ("float", "value"),
        "txt_IDs": ("long", "ids"),
    }
    assert [c.name for c in run.columns][:3] == ["geometryType", "geometryLatitude", "geometryLongitude"]
    assert len([c for c in run.columns if c.role == "geometry"]) == 10


def test_default_type_and_sample_rows(spark):
    rows = [(*GOOD, "7"), (*GOOD, "abc")]
    one = prepared(spark, rows[:1], ["la", "lo", "t", "v"])
    two = prepared(spark, rows, ["la", "lo", "t", "v"], sample_rows=2, default_type="double")
    assert one.columns[-1].kind == "float" and two.columns[-1].kind == "double"


def test_output_schema_matches_the_records(spark):
    run = prepared(spark, [(*GOOD, "5")], ["la", "lo", "t", "r"], radius="r")
    assert [(f.name, f.dataType) for f in run.records().schema] == [(f.name, f.dataType) for f in run.schema]


def test_names_with_dots_and_quotes(spark):
    columns = ["g.la", "g.lo", "g.t", "cell.id", "tag`x", "who is"]
    rows = [("1", "1", "1700000000", "A", "x", "p"), ("2", "2", "1700000001", "B", "y", "p")]
    table = LookupTable(
        "cell.id", "label.of", "string",
        spark.createDataFrame([("a", "first", 0)], "key string, value string, position int"),
    )
    run = tm.prepare(
        spark,
        tm.PrepOptions(
            longitude="g.lo", latitude="g.la", time="g.t", site_id="cell.id", string_columns=["tag`x"],
            encoded_columns=["who is"], retained_id_columns=["cell.id"],
        ),
        records=spark.createDataFrame(rows, T.StructType([T.StructField(c, T.StringType()) for c in columns])),
        lookups=(table,),
    )
    got = {r["cell.id"]: (r["tag`x"], r["who is"], r["cell.id_IDs"], r["label.of"]) for r in run.records().collect()}
    assert got == {"A": ("x", 1, 1, "first"), "B": ("y", 1, 2, None)}
    assert run.profile().count() == 8 and run.report().count() > 8 and run.rejects().count() == 0


# -- values -----------------------------------------------------------------------------------


def test_declared_long_reads_integers_first_then_dates(spark):
    rows = [(*GOOD, "12345678901"), (*GOOD, "7"), (*GOOD, "1.5")]
    run = prepared(spark, rows, ["la", "lo", "t", "v"], long_columns=["v"])
    assert [r[0] for r in run.records().select("v").collect()] == [12345678901, 7, None]
    dated = [("1", "1", "2019-02-19T10:54:21Z", "2019-02-19T10:54:22Z"), ("1", "1", "2019-02-19T10:54:21Z", "5")]
    run = prepared(spark, dated, ["la", "lo", "t", "v"], long_columns=["v"])
    assert sorted(r[0] for r in run.records().select("v").collect()) == [5, 1550573662000]


def test_a_marker_in_a_main_column_rejects_the_record(spark):
    rows = [GOOD, ("0", "0", "1700000001"), ("1", "1", "1700000002")]
    run = prepared(spark, rows, column_null_values={"lat": ["0"], "time": ["1700000002000"]})
    assert run.records().count() == 1
    assert {r[0] for r in run.rejects().select("reject_reason").collect()} == {"lat_null", "time_null"}


def test_column_markers_replace_type_markers(spark):
    rows = [(*GOOD, "1", "1"), (*GOOD, "2", "2")]
    run = prepared(
        spark, rows, ["la", "lo", "t", "a", "b"], float_columns=["a", "b"],
        float_null_values=[1], column_null_values={"b": ["2"]},
    )
    got = sorted(run.records().select("a", "b").collect(), key=str)
    assert [(r.a, r.b) for r in got] == [(2.0, None), (None, 1.0)] or [(r.a, r.b) for r in got] == [(None, 1.0), (2.0, None)]


LATS = ["58.3", "-90", "90", "90.001", "-91", "bad", "", None, "NaN", "inf", "Infinity", "1e1", " 7 ", "5"]
LONS = ["26.7", "180", "-180.5", "x", "", None]
TIMES = ["1700000000", "1700000500", "1600000000", "17", "now", "", None, "999999999999999999"]


@pytest.mark.parametrize("gate", [(None, None), ("1700000000", "1700000400"), ("1700000001", None)])
def test_condition_and_decision_agree_and_cover_everything(spark, gate):
    rows = list(itertools.product(LATS, LONS, TIMES))
    run = prepared(
        spark, [GOOD, *rows], start_time=gate[0], end_time=gate[1],
        column_null_values={"lat": ["5"]}, time_format="epoch_s",
    )
    kept = run.decided.where(ACCEPTED).count()
    totals = run.totals().first()
    assert run.records().count() == kept == totals["written"]
    assert run.rejects().count() == totals["rejected"]
    assert totals["written"] + totals["rejected"] == totals["total"] == len(rows) + 1
    assert run.rejects().where("reject_reason IS NULL").count() == 0
    days = run.daily().collect()
    assert sum(r["n"] for r in days) == kept


def test_stored_numbers_agree_with_their_text(spark):
    rows = [(1.5, 2.5, 1700000000), (95.0, 2.5, 1700000000), (float("nan"), 0.0, 1700000000),
            (None, 0.0, 1700000000), (1.0, 181.0, 1700000000), (1.0, 1.0, 17), (1.0, 1.0, 1600000000)]
    typed = spark.createDataFrame(rows, "la double, lo double, t long")
    text = typed.select(*[F.col(c).cast("string").alias(c) for c in typed.columns])
    results = []
    for raw in (typed, text):
        run = tm.prepare(spark, options(start_time="1650000000"), records=raw)
        results.append(
            (sorted(map(tuple, run.records().select("lat", "lon", "time").collect())),
             sorted(r[0] for r in run.rejects().select("reject_reason").collect()))
        )
    assert results[0] == results[1] == (
        [(1.5, 2.5, 1700000000000)],
        ["before_start", "lat_null", "lat_out_of_range", "lat_out_of_range", "lon_out_of_range", "time_invalid"],
    )


def test_epoch_zero_is_a_bound_like_any_other(spark):
    rows = [("1", "1", "1970-01-01T00:00:00Z"), ("1", "1", "1969-12-31T23:59:59Z")]
    run = prepared(spark, rows, start_time="1970-01-01T00:00:00Z")
    assert run.records().count() == 1 and run.totals().first()["time_gated"] == 1


def test_bound_in_another_format(spark):
    with pytest.raises(ValueError, match="bound"):
        prepared(spark, [GOOD], start_time="2019-02-19T10:54:21Z")


def test_conditions_on_stored_numbers_reach_the_files(spark, tmp_path):
    path = str(tmp_path / "in.parquet")
    spark.createDataFrame([(1.0, 2.0, 1700000000, 5)], "la double, lo double, t long, extra long").write.parquet(path)
    run = tm.prepare(spark, options(input_path=path, start_time="1650000000", long_columns=["extra"]))
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = run.records().select("lat", "time")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(la,-90.0)" in plan and "LessThanOrEqual(lo,180.0)" in plan
    assert "GreaterThanOrEqual(t,1650000000)" in plan
    assert "extra" not in plan.split("ReadSchema")[1]


# -- ids --------------------------------------------------------------------------------------


def test_ids_count_in_first_seen_order_and_null_stays_null(spark):
    rows = [(3, "a"), (1, "b"), (2, "c"), (9, None), (4, "b"), (1, "a2"), (None, "z")]
    raw = spark.createDataFrame(rows, "k long, v string")
    ids = build_dictionary(raw, ["v"], ["k"])
    assert {r.value: r.id for r in ids.collect()} == {"a2": 1, "b": 2, "c": 3, "a": 4, "z": 5}
    encoded = encode(raw, ids, "v", "id")
    assert encoded.where("v IS NULL").first()["id"] is None and encoded.count() == len(rows)


def test_ids_are_dense_per_column_and_survive_hot_values(spark):
    raw = spark.range(20_000).selectExpr(
        "id", "IF(id % 3 = 0, 'hot', concat('v', id % 4001)) AS a", "IF(id % 5 = 0, NULL, concat('w', id % 17)) AS b"
    )
    ids = build_dictionary(raw, ["a", "b"], ["id"]).cache()
    for column in "ab":
        numbers = sorted(r.id for r in ids.where(F.col("column") == column).collect())
        assert numbers == list(range(1, len(numbers) + 1))
    small = encode(raw, ids, "a", "n").select("id", "n")
    large = encode(raw, ids, "a", "n", max_rows=0).select("id", "n")
    assert small.exceptAll(large).count() == 0 and large.count() == 20_000
    nulls = encode(raw, ids, "b", "n", max_rows=0)
    assert nulls.count() == 20_000 and nulls.where("n IS NULL").count() == 4_000


def test_id_options(spark):
    rows = [("1", "1", "1700000002", "x", "p"), ("1", "1", "1700000001", "y", "p"), ("bad", "1", "1700000000", "z", "q")]
    run = prepared(spark, rows, ["la", "lo", "t", "a", "b"], encoded_columns=["a"], retained_id_columns=["b"])
    got = {r.time: (r.a, r.b, r.b_IDs) for r in run.records().collect()}
    # the rejected record was seen first and keeps its id
    assert got == {1700000002000: (3, "p", 2), 1700000001000: (2, "p", 2)}


def test_numbering_crosses_tasks(spark):
    raw = spark.range(5000).selectExpr("id", "(id * 7919) % 5000 AS k")
    got = numbered(raw, ["k"], "n", "t").orderBy("n").collect()
    assert [r.n for r in got] == list(range(1, 5001)) and [r.k for r in got] == list(range(5000))


# -- joins and lookups ------------------------------------------------------------------------


def test_size_check(spark):
    table = spark.range(100).selectExpr("id", "repeat('x', 100) AS s")
    assert fits_broadcast(table, 100, 20_000)
    assert not fits_broadcast(table, 99, 20_000)
    assert not fits_broadcast(table, 100, 10_000)


def test_heavy_keys_get_parts_by_share(spark):
    counts = spark.createDataFrame([(1, 900), (2, 50), (3, 50)], "hash long, n long")
    assert heavy_keys(counts, 20) == [(1, 18)]


def test_shuffled_join_keeps_every_record(spark):
    records = spark.range(30_000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN NULL ELSE concat('k', id) END AS k")
    table = spark.range(2, 30_000, 6).selectExpr("concat('k', id) AS k", "id AS v").union(
        spark.createDataFrame([("hot", -1)], "k string, v long")
    )
    joined = left_join_unique(records, table, "k", max_rows=0)
    assert joined.columns == ["k", "id", "v"] and joined.count() == 30_000
    assert joined.where("v = -1").count() == 10_000
    assert joined.where("k IS NULL AND v IS NULL").count() == 10_000
    assert joined.where("v IS NULL").count() == 10_000 + 5_000
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "__salt" in plan


def test_records_are_numbered_once_and_only_for_shuffled_joins(spark):
    rows = [(*GOOD, "a", "p"), ("1", "1", "1700000001", "b", "q")]
    columns = ["la", "lo", "t", "x", "y"]
    o = options(encoded_columns=["x"], retained_id_columns=["y"])

    def numbers(**bounds):
        records = tm.prepare(spark, o, records=frame(spark, rows, columns), **bounds).records()
        assert records.columns == [c.name for c in tm.prepare(spark, o, records=frame(spark, rows, columns)).columns]
        plan = records._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("monotonically_increasing_id()")

    assert numbers() == 0
    assert numbers(max_rows=0) == 1


def test_lookup_last_key_wins_and_bad_numbers_are_invalid(spark):
    rows = spark.createDataFrame(
        [("A", "1", 0), ("a", "2", 1), ("b", "x", 2)], "key string, value string, position int"
    )
    table = LookupTable("s", "n", "long", rows)
    raw = spark.createDataFrame([("a",), ("A",), ("B",), ("c",), (None,)], "s string")
    got = add_lookup(raw, table, "s", with_status=True).select("s", "n", "__status_n").collect()
    assert {(r[0], r[1], r[2]) for r in got} == {
        ("a", 2, "ok"), ("A", 2, "ok"), ("B", None, "invalid"), ("c", None, "null"), (None, None, "null"),
    }


def test_lookup_of_an_excluded_column_and_unknown_type(spark, tmp_path):
    path = tmp_path / "l.csv"
    path.write_text("code|label|string\n1|one\n2|two\n1|uno\n")
    run = prepared(
        spark, [(*GOOD, "1"), (*GOOD, "9")], ["la", "lo", "t", "code"], excluded=["code"],
        string_null_values=["two"], lookups=[str(path)],
    )
    assert sorted(str(r[0]) for r in run.records().select("label").collect()) == ["None", "uno"]
    assert "code" not in run.records().columns
    bad = tmp_path / "bad.csv"
    bad.write_text("code,label,date\n1,x\n")
    with pytest.raises(OptionsError, match="unknown type"):
        prepared(spark, [(*GOOD, "1")], ["la", "lo", "t", "code"], lookups=[str(bad)])


def test_condition_is_never_null(spark):
    raw = frame(spark, [(None, None, None), GOOD])
    run = tm.prepare(spark, options(time_format="epoch_s"), records=raw)
    condition = accept_condition(raw, run.options, run.times, None, None)
    assert raw.where(condition).count() + raw.where(f"NOT coalesce({condition}, false)").count() == 2


# -- types and time format from all records ---------------------------------------------------


def test_types_come_from_all_records(spark):
    run = prepared(spark, [(*GOOD, "12"), (*GOOD, "x"), (*GOOD, None)], ["la", "lo", "t", "v"])
    assert run.columns[-1].kind == "string"
    assert sorted(r.v or "" for r in run.records().collect()) == ["", "12", "x"]


def test_the_time_format_is_the_one_most_values_fit(spark):
    rows = [(*GOOD[:2], None), (*GOOD[:2], "17")] + [(*GOOD[:2], f"170000000{i}000") for i in range(3)]
    run = prepared(spark, rows, time_format=None)
    assert run.times.fmt == "epoch_ms" and run.records().count() == 3


def test_stored_numbers_keep_their_type(spark):
    raw = frame(spark, [GOOD], "la lo t".split()).selectExpr(
        "*", "123456789L AS big", "900000.01D AS wide", "DATE'2024-03-31' AS day"
    )
    row = tm.prepare(spark, options(), records=raw).records().first()
    assert (row.big, row.wide, row.day) == (123456789, 900000.01, 1711843200000)


def test_stored_times_need_no_format(spark):
    raw = frame(spark, [GOOD] * 2, "la lo t".split()).selectExpr(
        "la", "lo", "timestamp_seconds(CAST(t AS BIGINT)) AS t"
    )
    run = tm.prepare(
        spark, options(time_format=None, start_time="2023-11-14T00:00:00Z", end_time="1700000000"), records=raw
    )
    assert [r.time for r in run.records().collect()] == [1700000000000] * 2
    late = tm.prepare(spark, options(time_format=None, start_time="1700000001"), records=raw)
    assert late.records().isEmpty()


def test_discarded_tables_are_gone(spark, tmp_path, monkeypatch):
    import os

    from trailmill import session

    monkeypatch.setattr(session, "scratch_path", lambda _, label: f"file://{tmp_path}/{label}")
    kept, gone = (session.written(spark.range(3).toDF("v"), name) for name in ("kept", "gone"))
    session.discard(gone.where("v > 1"), gone)
    session.discard(gone)  # twice does no harm
    assert os.listdir(tmp_path) == ["kept"]
    assert kept.count() == 3


def test_ids_by_one_column_put_nulls_last_without_a_sort(spark):
    from trailmill.operators.dictionary import build_dictionary

    rows = [(None, 0, "n"), (5, 0, "b"), (2, 0, "a"), (7, 0, "a"), (2, 0, "c"), (None, 0, "a"), (None, 0, None)]
    df = spark.createDataFrame(rows, "t long, u long, v string")
    one = {r.value: (r.id, r.n) for r in build_dictionary(df, ["v"], ["t"]).collect()}
    assert one == {"a": (1, 3), "c": (2, 1), "b": (3, 1), "n": (4, 1)}
    two = {r.value: (r.id, r.n) for r in build_dictionary(df, ["v"], ["u", "t"]).collect()}
    assert two == one
    assert build_dictionary(df.where("false"), ["v"], ["t"]).count() == 0
