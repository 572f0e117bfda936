"""Neighbours against brute force, radii, geometry."""

import random

import numpy as np
import pytest

import trailmill as tm
from trailmill.functions.geodesic import metres_between
from trailmill.operators import sites
from trailmill.operators.geometry import add_geometry
from trailmill.options import GEOMETRY_COLUMNS


def brute_force(places):
    """{(lat, lon): [distances to all sites elsewhere]} of the four nearest."""
    lat, lon = (np.array(v, dtype=float) for v in zip(*places))
    nearest = {}
    for point in set(places):
        elsewhere = (lat != point[0]) | (lon != point[1])
        d = metres_between(
            np.full(elsewhere.sum(), point[0]), np.full(elsewhere.sum(), point[1]),
            lat[elsewhere], lon[elsewhere],
        )
        nearest[point] = sorted(d)[: sites.NEAREST]
    return nearest


def site_frame(spark, places):
    rows = [(str(i), float(a), float(o), None, i) for i, (a, o) in enumerate(places)]
    return spark.createDataFrame(rows, "site string, lat double, lon double, radius float, last_seen long")


def check(spark, places, **options):
    found = {}
    for r in sites.nearest_neighbours(sites.coordinates_of(site_frame(spark, places)), **options).collect():
        found.setdefault((r.lat, r.lon), []).append((r["rank"], r.distance_m, r.copies))
    for point, expected in brute_force(places).items():
        # nearest coordinates, each as often as there are sites
        got = [d for _, d, n in sorted(found.get(point, [])) for _ in range(n)][: sites.NEAREST]
        assert np.allclose(got, expected, atol=1e-6), point


def world(n, seed=1):
    r = random.Random(seed)
    return [(r.uniform(-90, 90), r.uniform(-180, 180)) for _ in range(n)]


def test_uniform(spark):
    check(spark, world(400))


def test_crowds_copies_poles_and_date_line(spark):
    r = random.Random(2)
    places = [(58.37 + r.random() / 1e3, 26.71 + r.random() / 1e3) for _ in range(300)]
    places += [(59.4, 24.7)] * 50 + [(59.4, 24.7000001)]
    places += [(90.0, 5.0), (90.0, 77.0), (-90.0, 0.0), (89.9999, -120.0), (0.0, 180.0), (0.0, -180.0)]
    places += [(r.uniform(-0.1, 0.1), r.choice([-1, 1]) * (180 - r.random() / 100)) for _ in range(60)]
    places += world(40, 3)
    places += [(58.37 + r.random() / 1e9, 26.71) for _ in range(40)]  # within a tenth of a millimetre
    check(spark, places)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6])
def test_few_sites(spark, n):
    check(spark, world(n, n))


def test_opposite_sites(spark):
    check(spark, [(0.0, 0.0), (0.0, 180.0), (0.3, 179.8)])


def test_window_runs_overlap(spark, monkeypatch):
    monkeypatch.setattr(sites, "_RUN", 7)
    check(spark, world(100, 9))


def test_wanted_points_only(spark):
    places = world(60, 4)
    frame = site_frame(spark, places)
    wanted = frame.where("site IN ('3', '5')").select("lat", "lon")
    got = sites.nearest_neighbours(sites.coordinates_of(frame), wanted).collect()
    assert {(r.lat, r.lon) for r in got} == {places[3], places[5]} and len(got) == 8


def test_no_join_without_keys(spark):
    found = sites.nearest_neighbours(sites.coordinates_of(site_frame(spark, world(50))))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert "WindowGroupLimit" in plan


def radii(spark, rows, **options):
    frame = spark.createDataFrame(rows, "site string, lat double, lon double, radius float, time long")
    stored = sites.distinct_sites(frame, options.pop("tolerance", None))
    return {r.site: r.site_radius for r in sites.radius_per_site(stored, **options).collect()}


def test_radius_given_missing_and_last_seen(spark):
    rows = [
        ("a", 58.37, 26.71, 250.9, 1), ("b", 58.38, 26.71, None, 1),
        ("c", 58.40, 26.71, 10.0, 5), ("c", 58.50, 26.71, None, 4),  # the later one has a radius
        (None, 1.0, 1.0, 5.0, 9),
    ]
    expected = sorted(
        metres_between([58.38] * 3, [26.71] * 3, [58.37, 58.40, 58.50], [26.71] * 3)
    )
    assert radii(spark, rows) == {"a": 250, "b": int(sum(expected) / 3), "c": 10}


def test_lone_site_and_sites_at_one_coordinate(spark):
    assert radii(spark, [("a", 1.0, 1.0, None, 1)]) == {"a": 0}
    crowd = [(f"s{i}", 58.0, 26.0, None, 1) for i in range(6)] + [("t", 58.0, 27.0, None, 1)]
    d = metres_between([58.0], [26.0], [58.0], [27.0])[0]
    assert radii(spark, crowd)["t"] == int(d) and radii(spark, crowd)["s0"] == int(d)


def test_each_site_of_a_coordinate_counts_unless_told_otherwise(spark):
    rows = [("a", 58.0, 26.0, None, 1)] + [(f"n{i}", 58.0, 26.1, None, 1) for i in range(3)]
    rows += [("far", 58.0, 27.0, None, 1), ("farther", 58.0, 28.0, None, 1)]
    near, far, farther = (metres_between([58.0], [26.0], [58.0], [x])[0] for x in (26.1, 27.0, 28.0))
    assert radii(spark, rows)["a"] == int((3 * near + far) / 4)
    assert radii(spark, rows, one_per_coordinate=True)["a"] == int((near + far + farther) / 3)


def test_tolerance_merges_close_sites(spark):
    rows = [("a", 58.000001, 26.0, None, 1), ("a", 58.000002, 26.0, None, 2), ("b", 59.0, 26.0, None, 1)]
    frame = spark.createDataFrame(rows, "site string, lat double, lon double, radius float, time long")
    assert sites.distinct_sites(frame).count() == 3
    assert sites.distinct_sites(frame, 0.00002).count() == 2


# -- geometry ---------------------------------------------------------------------------------


def geometry(spark, radius):
    rows = spark.createDataFrame([(58.371208, 26.7160088, radius)], "lat double, lon double, r int")
    return add_geometry(rows, "r").first()


def test_circle(spark):
    g = geometry(spark, 250)
    assert (g.geometryType, g.startAngle, g.stopAngle) == ("CIRCLE", 0.0, 360.0)
    assert (g.outerSemiMajorRadius, g.outerSemiMinorRadius) == (250.0, 250.0)
    assert (g.geometryLatitude, g.geometryLongitude) == (58.371208, 26.7160088)
    assert (g.innerSemiMajorRadius, g.innerSemiMinorRadius, g.orientationMajorAxis) == (None,) * 3


def test_point(spark):
    g = geometry(spark, 0)
    assert (g.geometryType, g.geometryLatitude) == ("POINT", 58.371208)
    assert (g.startAngle, g.stopAngle, g.outerSemiMajorRadius, g.outerSemiMinorRadius) == (None,) * 4


def test_no_radius_leaves_the_record_unchanged(spark):
    g = geometry(spark, None)
    assert all(g[name] is None for name, _ in GEOMETRY_COLUMNS) and g.lat == 58.371208
    rows = spark.createDataFrame([(1.0, 2.0)], "lat double, lon double")
    assert all(v is None for v in add_geometry(rows, None).first()[2:])


def test_random_points_stay_inside(spark):
    rows = spark.range(2000).selectExpr("58.0D AS lat", "26.0D AS lon", "CAST(id % 3 * 100 AS INT) AS r")
    moved = add_geometry(rows, "r", randomize=True, seed=5).collect()
    d = metres_between(*[[r[c] for r in moved] for c in ("lat", "lon", "geometryLatitude", "geometryLongitude")])
    limit = np.array([r.r for r in moved]) + 1
    assert (d < limit).all() and d[limit == 201].max() > 150
    assert abs(d[limit == 201].mean() - 100) < 15  # uniform in distance, not in area


def test_whole_run_with_sites(spark):
    rows = [
        ("58.37", "26.71", "1700000000", "A", "12.7"), ("58.38", "26.71", "1700000001", "B", ""),
        ("58.40", "26.71", "1700000002", "", "77"), ("99", "26.71", "1700000003", "C", "5"),
    ]
    raw = spark.createDataFrame(rows, "la string, lo string, t string, cell string, r string")
    base = dict(longitude="lo", latitude="la", time="t", radius="r")
    by_site = tm.prepare(spark, tm.PrepOptions(**base, site_id="cell"), records=raw).records()
    got = {r.cell: (r.geometryType, r.outerSemiMajorRadius) for r in by_site.collect()}
    d = metres_between([58.38], [26.71], [58.37], [26.71])[0]
    assert got == {"A": ("CIRCLE", 12.0), "B": ("CIRCLE", float(int(d))), None: (None, None)}
    per_record = tm.prepare(spark, tm.PrepOptions(**base), records=raw).records()
    assert sorted(str(r[0]) for r in per_record.select("outerSemiMajorRadius").collect()) == ["12.0", "77.0", "None"]
    shuffled = tm.prepare(spark, tm.PrepOptions(**base, site_id="cell"), records=raw, max_rows=0).records()
    assert shuffled.exceptAll(by_site).count() == 0 and shuffled.count() == 3


def test_close_sites_by_brute_force(spark):
    """Chains, cells side by side, corners both ways, other identifiers, repeated rows, nulls."""
    from trailmill.operators.closeness import joined_sites

    rnd, tolerance = random.Random(8), 0.01
    rows = []
    for i in range(400):
        rows.append((f"s{rnd.randrange(3)}", round(rnd.uniform(-0.15, 0.15), 4), round(rnd.uniform(-0.15, 0.15), 4), None, i))
    rows += [("edge", 1.0, 1.0, 5.0, 1), ("edge", 1.01, 1.01, None, 2), ("edge", 1.0201, 1.0, None, 3), (None, 0.0, 0.0, None, 4)]
    rows += [("turn", 0.0101, 0.0099, None, 1), ("turn", 0.0099, 0.0101, None, 2), ("alone", 0.0, 0.0, None, 9)]
    rows += rows[:50]
    frame = spark.createDataFrame(rows, "site string, lat double, lon double, radius float, time long")
    latest = {}
    for site, lat, lon, radius, time in rows:
        if site is not None:
            key = (site, lat, lon, radius)
            latest[key] = max(latest.get(key, -1), time)
    points = list(latest)
    label = list(range(len(points)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(points):
            for j, b in enumerate(points):
                close = a[0] == b[0] and abs(a[1] - b[1]) <= tolerance * (1 + 1e-9) and abs(a[2] - b[2]) <= tolerance * (1 + 1e-9)
                if close and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    groups = {}
    for point, comp in zip(points, label):
        groups.setdefault(comp, []).append((latest[point], *point[1:3], point))
    expected = sorted((g[-1][3][0], g[-1][1], g[-1][2], g[-1][0]) for g in (sorted(g, key=lambda m: m[:3]) for g in groups.values()))
    got = sorted((r.site, r.lat, r.lon, r.last_seen) for r in joined_sites(frame, tolerance).collect())
    assert got == expected and len(got) < len(points)
    assert joined_sites(frame.limit(0), tolerance).collect() == []


def test_rolled_files_hold_exactly_so_many(spark, tmp_path):
    from trailmill.plans.sinks import write_rolled

    frame = spark.range(1000).selectExpr("(id * 37) % 1000 AS k", "id").repartition(7)
    for size, expected in ((300, [300, 300, 300, 100]), (500, [500, 500]), (0, [1000]), (5000, [1000])):
        path = str(tmp_path / f"n{size}")
        write_rolled(frame, path, ["k"], size, drop=["id"])
        files = sorted((tmp_path / f"n{size}").glob("*.parquet"))
        parts = [[r.k for r in spark.read.parquet(str(f)).collect()] for f in files]
        assert [len(p) for p in parts] == expected and sum(parts, []) == list(range(1000))
    write_rolled(frame.limit(0), str(tmp_path / "none"), ["k"], 10)
    assert spark.read.parquet(str(tmp_path / "none")).count() == 0


def test_one_file_is_written_in_order_without_a_sort_in_its_task(spark, tmp_path):
    from trailmill.plans import sinks
    from trailmill.session import discard, written

    frame = spark.range(50_000).selectExpr("(id * 7919) % 50000 AS k", "id", "'x' || id AS `a.b`").repartition(9)
    sinks.write_rolled(frame, str(tmp_path / "one"), ["k"], drop=["id"])
    (file,) = (tmp_path / "one").glob("*.parquet")
    got = spark.read.parquet(str(file)).collect()
    assert [r.k for r in got] == list(range(50_000)) and got[0].asDict().keys() == {"k", "a.b"}
    sinks.write_rolled(frame.limit(0), str(tmp_path / "none"), ["k"])
    assert spark.read.parquet(str(tmp_path / "none")).count() == 0
    # more files than ten, and numbers that do not sort as texts
    stored = written(frame.repartitionByRange(12, "k").sortWithinPartitions("k"), "shares")
    whole = sinks._one_after_another(stored)
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert whole.rdd.getNumPartitions() == 1 and "Sort" not in plan and "Exchange" not in plan
    assert [r.k for r in whole.collect()] == list(range(50_000))
    discard(stored)


def test_folded_values(spark):
    from trailmill.operators.folding import fold_rare

    rows = [("a", "x")] * 5 + [("b", "x")] * 3 + [("c", "y")] * 3 + [("d", None), (None, "y")]
    frame = spark.createDataFrame(rows, "one string, two string")
    for bounds in ({}, {"max_rows": 0}):
        found = fold_rare(frame, ["one", "two"], 2, "rest", **bounds).collect()
        assert sorted(map(str, ((r.one, r.two) for r in found))) == sorted(
            map(str, ((v if v in ("a", "b", None) else "rest", w) for v, w in rows))
        )
