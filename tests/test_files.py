"""Sources, sinks, report, catalogue, preview and streams."""

import gzip
import json
import zipfile

import pytest
from pyspark.sql import functions as F

import trailmill as tm
from trailmill.operators.preview import column_preview, search_columns
from trailmill.options import OptionsError
from trailmill.plans.sinks import write_records
from trailmill.session import scratch_path
from trailmill.sources.files import FILE_COLUMN, csv_dialect, holds, read_csv, read_parquet, read_records
from trailmill.sources.lookups import read_lookup
from trailmill.streaming import accepted_stream

TEXT = 'la,lo,t,note\n58.3,26.7,1700000000," a ""quoted"", note "\n 59 ,27,1700000001,""\n60,28,1700000002,\n'
ROWS = [
    ("58.3", "26.7", "1700000000", 'a "quoted", note'),
    ("59", "27", "1700000001", None),
    ("60", "28", "1700000002", None),
]


def rows(df):
    return sorted(
        tuple(v.strip() if v else None for v in r) for r in df.select("la", "lo", "t", "note").collect()
    )


def make(folder, kind, name="a", text=TEXT):
    path = folder / f"{name}.{kind}"
    if kind == "csv":
        path.write_text(text)
    elif kind == "csv.gz":
        path.write_bytes(gzip.compress(text.encode()))
    else:
        with zipfile.ZipFile(path, "w") as archive:
            archive.writestr("inner.csv", text)
    return str(path)


@pytest.mark.parametrize("kind", ["csv", "csv.gz", "zip"])
def test_csv_kinds(spark, tmp_path, kind):
    assert rows(read_csv(spark, make(tmp_path, kind))) == ROWS


def test_folder_of_all_csv_kinds_with_files_without_records(spark, tmp_path):
    for i, kind in enumerate(["csv", "csv.gz", "zip"]):
        make(tmp_path, kind, f"f{i}")
    make(tmp_path, "csv", "0empty", "")
    make(tmp_path, "csv", "header", "la,lo,t,note\n")
    make(tmp_path, "zip", "zheader", "la,lo,t,note\n")
    df = read_records(spark, str(tmp_path))
    assert rows(df) == sorted(ROWS * 3)
    assert df.select(FILE_COLUMN).distinct().count() == 3


def test_given_headers(spark, tmp_path):
    body = TEXT.split("\n", 1)[1]
    for kind in ("csv", "zip"):
        assert rows(read_csv(spark, make(tmp_path, kind, "h", body), headers=["la", "lo", "t", "note"])) == ROWS


def test_quoted_line_breaks(spark, tmp_path):
    text = 'la,lo,t,note\n1,2,3,"two\nlines"\n'
    for kind, options in (("csv", dict(multiline=True)), ("zip", {})):
        df = read_csv(spark, make(tmp_path, kind, "m", text), **options)
        assert [r.note for r in df.collect()] == ["two\nlines"]


def test_other_quote(spark, tmp_path):
    df = read_csv(spark, make(tmp_path, "csv", "q", "la,lo,t,note\n1,2,3,'x, y'\n"), quote="'")
    assert df.first()["note"] == "x, y"


def test_short_and_long_records(spark, tmp_path):
    text = "la,lo,t,note\n1,2\n1,2,3,x,surplus\n"
    expected = [("1", "2", "3", "x"), ("1", "2", None, None)]
    for kind in ("csv", "zip"):
        got = read_csv(spark, make(tmp_path, kind, "r", text)).select("la", "lo", "t", "note").collect()
        assert sorted(map(tuple, got), key=str) == expected


def test_headers_in_other_orders(spark, tmp_path):
    make(tmp_path, "csv", "a")
    make(tmp_path, "csv", "b", 't,"note", la,lo\n1700000009,n,1,2\n')
    make(tmp_path, "csv.gz", "c", "note,t,lo,la\n,1700000008,4,3\n")
    make(tmp_path, "zip", "d", "lo,la,t,note\n6,5,1700000007,\n")
    make(tmp_path, "csv", "e", "")
    df = read_csv(spark, str(tmp_path))
    assert df.columns == ["la", "lo", "t", "note", FILE_COLUMN]
    more = [("1", "2", "1700000009", "n"), ("3", "4", "1700000008", None), ("5", "6", "1700000007", None)]
    assert rows(df) == sorted(ROWS + more)
    make(tmp_path, "csv", "f", "la,lo,t,other\n1,2,3,4\n")
    with pytest.raises(OptionsError, match="f.csv: columns missing .'note'., unknown .'other'"):
        read_csv(spark, str(tmp_path))


def test_headers_where_only_spark_reads(spark, tmp_path, monkeypatch):
    from trailmill.sources import access

    monkeypatch.setattr(access, "tasks_can_open", lambda *_: False)
    make(tmp_path, "csv", "a")
    make(tmp_path, "csv", "b", "t,note,la,lo\n1700000009,n,1,2\n")
    assert rows(read_csv(spark, str(tmp_path))) == sorted([*ROWS, ("1", "2", "1700000009", "n")])


def test_unknown_column_in_an_archive(spark, tmp_path):
    make(tmp_path, "csv", "a")
    make(tmp_path, "zip", "d", "lo,la,t,extra\n6,5,1700000007,\n")
    with pytest.raises(Exception, match="unknown .'extra'"):
        read_csv(spark, str(tmp_path)).collect()


def test_entries_of_archives(spark, tmp_path):
    long = "x" * (5 << 20)  # longer than a block
    spaced = 'la,lo,t,note\n' + "1,2,3,plain\n" * 20000 + '7,8,9, "a, b"\n' + "1,2,3,plain\n" * 5
    with zipfile.ZipFile(tmp_path / "many.zip", "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("sub/one.csv", TEXT)
        archive.writestr("notes.md", "not, a, record\n")
        archive.writestr("__MACOSX/sub/._one.csv", b"\x00\x05")
        archive.writestr("header.csv", "la,lo,t,note\n")
        archive.writestr("empty.csv", "")
        archive.writestr("two.CSV", f'note,la,lo,t\n{long},1,2,3\n"two\nlines",4,5,6\n')
        archive.writestr("spaced.csv", spaced)
        archive.writestr("uneven.csv", "la,lo,t,note\n1,2\n\n1,2,3,x,surplus\n")
    with zipfile.ZipFile(tmp_path / "odd.zip", "w") as archive:
        archive.writestr("data.txt", "la,lo,t,note\n9,9,9,text\n")
    with zipfile.ZipFile(tmp_path / "none.zip", "w"):
        pass
    df = read_csv(spark, str(tmp_path))
    expected = [*ROWS, (("1"), "2", "3", long), ("4", "5", "6", "two\nlines"), ("7", "8", "9", "a, b")]
    expected += [("1", "2", "3", "plain")] * 20005 + [("1", "2", None, None), ("1", "2", "3", "x"), ("9", "9", "9", "text")]
    assert sorted(map(str, rows_any(df))) == sorted(map(str, expected))
    assert df.select(FILE_COLUMN).distinct().count() == 2


def rows_any(df):
    return [tuple(v.strip() if v else None for v in r) for r in df.select("la", "lo", "t", "note").collect()]


@pytest.mark.parametrize(
    ("sep", "quote", "lines"),
    [
        (",", '"', ["a,b,c", '1,"x, y",z', "2,it's,q", '3,"say ""hi"", you",w']),
        (",", "'", ["a,b,c", "1,'x, y',z", "2,'p, q, r',s", '3,6" nails,t']),
        (";", '"', ["a;b;c", "1;2,5;3,5", "2;4,5;5", '3;"x;y";7,0']),
        (";", "'", ["a;b", "'1;2';x", "'3;4';y"]),
        ("\t", '"', ["a\tb\tc", "1\tx, y\tz", "2\tp; q\tr"]),
        ("|", '"', ["a|b", "1|x,y", "2|z"]),
        (",", '"', ["a,b", "1,2"]),
        (",", '"', ["single", "column"]),
    ],
)
def test_dialects(spark, tmp_path, sep, quote, lines):
    found = csv_dialect(spark, make(tmp_path, "csv", "d", "\n".join(lines) + "\n"))
    assert (found.sep, found.quote) == (sep, quote)
    zipped = csv_dialect(spark, make(tmp_path, "zip", "d", "\r\n".join(lines) + "\r\n"))
    assert zipped == found


def test_detected_dialect_is_read(spark, tmp_path):
    path = make(tmp_path, "csv", "d", "la;lo;t;note\n1;2;3;'x; y'\n4;5;6;'p; q; r'\n")
    df = read_csv(spark, path, quote="auto", sep="auto")
    assert rows(df) == [("1", "2", "3", "x; y"), ("4", "5", "6", "p; q; r")]


def test_input_checks(spark, tmp_path):
    make(tmp_path, "csv")
    (tmp_path / "b.parquet").write_bytes(b"")
    with pytest.raises(OptionsError, match="both"):
        read_records(spark, str(tmp_path))
    other = tmp_path / "other"
    other.mkdir()
    (other / "a.txt").write_text("x")
    for path in (str(other), str(tmp_path / "missing")):
        with pytest.raises(OptionsError):
            read_records(spark, path)
    assert holds(spark, str(tmp_path), (".csv",)) and not holds(spark, str(tmp_path), (".gz", ".zip"))


def test_rolled_parquet(spark, tmp_path):
    path = str(tmp_path / "out")
    write_records(spark.range(1050).coalesce(1).toDF("id"), path, records_per_file=100, row_group_bytes=1 << 20)
    back = read_parquet(spark, path)
    assert back.count() == 1050 and back.select(FILE_COLUMN).distinct().count() == 11
    assert ".snappy." in back.first()[FILE_COLUMN]


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_lookup_file(spark, tmp_path, sep):
    path = tmp_path / "l.csv"
    path.write_text("\n".join(sep.join(x) for x in [("src", "dst", "Long"), ("A", "1"), ("a", "2"), ("b", "3")]))
    table = read_lookup(spark, tm.Lookup(str(path)))
    assert (table.source, table.target, table.kind) == ("src", "dst", "long")
    assert {tuple(r) for r in table.latest().collect()} == {("a", "2"), ("b", "3")}


def test_scratch_folder_is_the_session_setting(spark):
    root = spark.conf.get("spark.checkpoint.dir", None)
    path = scratch_path(spark, "x")
    assert path.startswith(root) if root else "trailmill" in path
    assert path != scratch_path(spark, "x")


# -- results of a run -------------------------------------------------------------------------


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("run")
    (folder / "in").mkdir()
    lines = ["la,lo,t,cell,num,neg,none,bad,tag"]
    for i in range(10):
        lat = "bad" if i == 3 else "95" if i == 4 else str(50 + i)
        lines.append(f"{lat},26.7,{1700000000 + i * 43200},c{i % 2},{i},{-i - 1}.5,,x{i},t{i}")
    for part in range(2):
        (folder / "in" / f"{part}.csv").write_text("\n".join([lines[0], *lines[1 + part * 5 : 6 + part * 5]]) + "\n")
    options = tm.PrepOptions(
        longitude="lo", latitude="la", time="t", input_path=str(folder / "in"),
        output_path=str(folder / "out"), report_path=str(folder / "report"),
        catalogue_path=str(folder / "catalogue"), float_columns=["none", "bad", "num", "neg"],
        string_columns=["cell", "tag"], site_id="cell", trajectory_id="cell", unique_strings=5,
        retained_id_columns=["cell"], start_time="1700000000", end_time=str(1700000000 + 8 * 43200),
    )
    prepared = tm.prepare(spark, options)
    prepared.write()
    return prepared, folder


def test_totals(run):
    totals = run[0].totals().first().asDict()
    assert totals == {"total": 10, "written": 7, "rejected": 3, "time_gated": 1, "files": 2}


def test_profile(run):
    p = {r["column"]: r for r in run[0].profile().collect()}
    assert (p["lat"].non_null, p["lat"].invalid, p["lat"].nulls, p["lat"].out_of_range) == (9, 1, 1, 1)
    assert (p["lat"].min, p["lat"].max) == (50.0, 59.0)
    assert (p["num"].zeros, p["num"].min, p["num"].max) == (1, 0.0, 9.0)
    assert (p["neg"].min, p["neg"].max) == (-10.5, -1.5)  # all negative
    assert (p["none"].non_null, p["none"].nulls, p["none"].min) == (0, 10, None)
    assert (p["bad"].non_null, p["bad"].invalid) == (10, 10)
    assert (p["cell"].n_distinct, p["tag"].n_distinct, p["num"].n_distinct) == (2, 10, None)
    assert all(r.non_null + r.nulls == 10 for r in p.values())


def test_approximate_distinct(run, spark):
    from trailmill.operators.profile import profile_distinct

    prepared = run[0]
    got = profile_distinct(prepared.decided, prepared.profiled_columns, approximate=True)
    assert {r["column"]: r.n_distinct for r in got.collect()} == {"cell": 2, "tag": 10}


def test_profile_of_no_records_and_of_wide_ones(run, spark):
    from trailmill.operators import profile as profiles

    prepared = run[0]
    none = profiles.profile_counts(prepared.decided.where("false"), prepared.profiled_columns)
    assert none.count() == len(prepared.profiled_columns) and none.agg(F.sum("nulls")).first()[0] == 0
    numbers = [f"CAST(id % {i + 2} AS STRING) AS n{i}" for i in range(200)]
    raw = spark.range(60).selectExpr("'1' AS la", "'2' AS lo", "CAST(1700000000 + id AS STRING) AS t", *numbers)
    wide = tm.prepare(spark, tm.PrepOptions(longitude="lo", latitude="la", time="t"), records=raw)
    found = {r["column"]: (r.non_null, r.zeros, r.max) for r in wide.profile().collect()}
    assert len(found) == 203
    assert all(found[f"n{i}"] == (60, -(-60 // (i + 2)), float(min(i + 1, 59))) for i in range(200))


def test_observed_run_gives_the_same_results(run):
    prepared, watched = run[0], run[0].observed
    for name in ("records", "rejects", "profile", "totals", "daily", "reject_reasons", "catalogue"):
        one, two = getattr(prepared, name)(), getattr(watched, name)()
        assert sorted(one.columns) == sorted(two.columns), name
        two = two.select(*[F.col(f"`{c}`") for c in one.columns])
        assert sorted(map(str, one.collect())) == sorted(map(str, two.collect())), name


def test_one_read_of_the_input(run):
    watched = run[0].observed
    for made in (watched.records(), watched.report(), watched.daily(), watched.totals()):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "FileScan csv" not in plan


def test_closed_run_leaves_no_tables(spark, tmp_path):
    make(tmp_path, "csv")
    options = tm.PrepOptions(longitude="lo", latitude="la", time="t", input_path=str(tmp_path), output_path=str(tmp_path / "out"))
    watched = tm.prepare(spark, options).write()
    assert watched.totals().first()["written"] == 3
    watched.close()
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FILE_NOT_EXIST|does not exist"):
        spark.read.parquet(watched.table.inputFiles()[0]).count()


def test_time_format_of_each_file(spark, tmp_path):
    for name, times in {
        "a": ["1700000000", "1700000001"], "b": ["1700000002000", "1700000003000", "12"],
        "c": ["2023-11-14T22:13:24Z", "2023-11-14T22:13:25+00:00", "bad"], "d": ["", ""],
        "e": ["2023-11-14T22:13:26Z", "2023-11-14T22:13:27Z[UTC]"],
    }.items():
        (tmp_path / f"{name}.csv").write_text("la,lo,t,seen\n" + "".join(f"1,2,{t},{t}\n" for t in times))
    options = tm.PrepOptions(
        longitude="lo", latitude="la", time="t", time_columns=["seen"], input_path=str(tmp_path),
        start_time="2023-11-14T22:13:21Z", end_time="1700000026",
    )
    found = tm.prepare(spark, options)
    assert found.times.formats == ("epoch_ms", "epoch_s", "iso_offset", "iso_zoned")
    expected = [(t * 1000, t * 1000) for t in range(1700000001, 1700000008)]
    assert sorted((r.time, r.seen) for r in found.records().collect()) == expected
    assert [(r.day, r.n) for r in found.daily().collect()] == [("2023-11-14", 7)]


def test_days(run):
    days = run[0].daily().collect()
    assert [r.day for r in days] == sorted(r.day for r in days) and sum(r.n for r in days) == 7


def test_written_records(run, spark):
    back = spark.read.parquet(str(run[1] / "out"))
    assert back.columns == [c.name for c in run[0].columns] and back.count() == 7


def test_report(run):
    (part,) = (run[1] / "report").glob("part-*")
    lines = part.read_text().splitlines()
    assert lines[0] == "Records: 10 from 2 files, written: 7, rejected: 3, outside the time bounds: 1"
    assert "WARNING: tag has 10 distinct strings, more than 5" in lines
    assert "Number columns without any data: none" in lines
    assert "Number columns without any valid data: bad" in lines
    assert any(x.startswith("neg: ") and "min -10.5, max -1.5" in x for x in lines)
    assert lines[-1].startswith("2023-11-")


def test_catalogue(run):
    (part,) = (run[1] / "catalogue").glob("part-*")
    entries = {e["attributeId"]: e for e in json.loads(part.read_text())["data"]}
    assert list(entries)[:3] == ["lat", "lon", "time"]
    assert entries["lat"]["unit"] == "degrees" and entries["lat"]["attributeTooltip"].endswith("equals to la")
    assert entries["time"]["guiType"] == "dateTime" and entries["cell_IDs"]["guiType"] == "ID"
    assert entries["geometryType"]["group"] == "Geographic Location"
    assert entries["trajectory_1"]["hidden"] and entries["trajectory_1"]["idField"] == "cell"
    assert len(entries) == len(run[0].columns) + 1


def test_preview(spark):
    raw = spark.createDataFrame([("1", "", None, "a"), ("2", "x", "y", "b"), ("3", "z", "w", "c"), ("4", "", "", "d")],
                                "NumCol string, gap string, none string, txt string")
    got = {r["column"]: (r.type, r.examples) for r in column_preview(raw.coalesce(1), "NumCol").collect()}
    assert got["gap"] == ("Undetermined", "; x; z; ") and got["txt"] == ("String", "a; b; c; ")
    assert got["none"] == ("Undetermined", "null; y; w; ")
    plain = column_preview(raw.coalesce(1))
    assert plain.where("column = 'NumCol'").first()["type"] == "Float"
    assert [r["column"] for r in search_columns(plain, " numc").collect()] == ["NumCol"]


def test_stream_gives_what_the_batch_gives(spark, run, tmp_path):
    prepared, folder = run
    raw = read_csv(spark, str(folder / "in")).drop(FILE_COLUMN)
    stream = spark.readStream.schema(raw.schema).option("header", True).csv(str(folder / "in"))
    accepted = accepted_stream(
        stream, prepared.columns, prepared.options, prepared.times, prepared.start, prepared.end
    )
    query = (
        accepted.writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    streamed = spark.read.parquet(str(tmp_path / "out"))
    batch = prepared.records().select(*streamed.columns)
    assert streamed.count() == 7 and streamed.exceptAll(batch).count() == 0
    assert streamed.where(F.col("lat").isNull()).count() == 0
