import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trailmill.functions import casts, geodesic, times
from trailmill.functions.names import display_name


def test_float_forms(evaluate):
    values = ["1.5", " 2 ", "1f", "1e3", "NaN", "Infinity", "-Infinity", "inf", "nan", "infinity", "x", "", None]
    got = evaluate(f"CAST({casts.to_float('v')} AS STRING)", values)
    assert got == [
        "1.5", "2.0", "1.0", "1000.0", "NaN", "Infinity", "-Infinity",
        None, None, None, None, None, None,
    ]


def test_long_rejects_fractions_and_powers(evaluate):
    assert evaluate(casts.to_long("v"), ["7", "1e5", "1.5", "1L", "99999999999999999999"]) == [7] + [None] * 4


def test_markers_compare_by_value(evaluate):
    hit = casts.is_marker(f"({casts.to_double('v')})", ["1.50", 2], "double")
    assert evaluate(hit, ["1.5", "2.0", "3"]) == [True, True, False]
    quoted = casts.is_marker("v", ["it's", "a\\b"], "string")
    assert evaluate(quoted, ["it's", "a\\b", " it's"]) == [True, True, False]


def test_radius_text(evaluate):
    assert evaluate(casts.radius_text("v"), ["", "null", "5", None]) == [None, None, "5", None]


# -- time -------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text, fmt, millis",
    [
        ("2019-02-19 10:54:21.764 -0500", "spaced_offset", 1550591661764),
        ("2019-02-19T10:54:21.764-05:00", "iso_offset", 1550591661764),
        ("2019-02-19T10:54Z", "iso_offset", 1550573640000),
        ("2019-02-19T10:54:21.7Z", "iso_offset", 1550573661700),
        ("2019-02-19T10:54:21.764-05:00[America/New_York]", "iso_zoned", 1550591661764),
        ("1589414444", "epoch_ms", 1589414444),
        ("1589414444", "epoch_s", 1589414444000),
        ("158941444", "epoch_s", None),
        ("999999999999999999", "epoch_s", None),
        ("2019-02-19T10:54:21", "iso_offset", None),
        ("2019-02-30T10:54:21Z", "iso_offset", None),
    ],
)
def test_to_millis(evaluate, text, fmt, millis):
    assert evaluate(times.to_millis("v", fmt), [text]) == [millis]


def test_local_time_takes_the_zone_whatever_the_session_zone(spark, evaluate):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        got = evaluate(times.to_millis("v", "iso_local", "America/New_York"), ["2019-02-19T10:54:21"])
        day = evaluate(times.to_day("v", "1550534400000", "epoch_ms", "America/New_York"), ["x"])
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [1550591661000]
    assert day == ["2019-02-18"]


def test_day_of_written_dates_and_far_epochs(evaluate):
    assert evaluate(times.to_day("v", "1L", "iso_offset"), ["2019-02-19T23:54:21-05:00"]) == ["2019-02-19"]
    assert evaluate(times.to_day("v", f"{2**63 - 1}L", "epoch_ms"), ["x"]) == [None]


@pytest.mark.parametrize(
    "values, fmt",
    [
        (["2019-02-19 10:54:21.764 -0500"], "spaced_offset"),
        (["2019-02-19T10:54:21Z"], "iso_offset"),
        (["2019-02-19T10:54:21+01:00[Europe/Paris]"], "iso_zoned"),
        (["2019-02-19T10:54:21Z", "2019-02-19T10:54:21+01:00[Europe/Paris]"], "iso_zoned"),
        (["1589414444"], "epoch_s"),
        (["1589414444000"], "epoch_ms"),
        ([None, "2019-02-19T10:54:21"], "iso_local"),
    ],
)
def test_detection(spark, values, fmt):
    sample = spark.createDataFrame([(v,) for v in values], "at string")
    assert times.detect_format(sample, "at") == fmt


def test_detection_fails_on_other_text(spark):
    with pytest.raises(ValueError, match="no known time format"):
        times.detect_format(spark.createDataFrame([("noon",)], "at string"), "at")


# -- geodesics --------------------------------------------------------------------------------


def test_distance_vector():
    assert abs(geodesic.metres_between([58.371074], [26.717262], [59.356770], [28.078634])[0] - 135_000) < 1


def test_direct_vector():
    lat, lon = geodesic.point_after(np.array([58.371074]), np.array([26.717262]), np.array([35.0]), np.array([135_000.0]))
    assert abs(lat[0] - 59.356770) < 1e-5 and abs(lon[0] - 28.078634) < 1e-5


@pytest.mark.parametrize(
    "pair, metres",
    [
        ((0, 0, 0, 10), 1113194.908),
        ((10, 20, 10, 20), 0.0),
        ((0, 179.5, 0, -179.5), 111319.491),
        ((0, 0, 0.5, 179.7), 19944127.421),  # published for this almost antipodal pair
        ((0, 0, 0, 180), 20003931.459),  # half a meridian
        ((90, 0, -90, 77), 20003931.459),
    ],
)
def test_awkward_pairs(pair, metres):
    assert abs(geodesic.metres_between(*[[x] for x in pair])[0] - metres) < 0.002


def test_distance_of_null_is_null(spark):
    rows = spark.createDataFrame([(1.0, 1.0, 2.0, 2.0), (None, 1.0, 2.0, 2.0)], "a double, b double, c double, d double")
    got = [r[0] for r in rows.select(geodesic.distance_m("a", "b", "c", "d")).collect()]
    assert got[0] > 0 and got[1] is None


_DEGREES = st.tuples(st.floats(-90, 90), st.floats(-180, 180))


@settings(max_examples=150, deadline=None)
@given(_DEGREES, st.floats(-180, 180), st.floats(0, 19_000_000))
def test_direct_and_inverse_agree(start, azimuth, metres):
    lat, lon = geodesic.point_after(*[np.array([float(x)]) for x in (*start, azimuth, metres)])
    back = geodesic.metres_between([start[0]], [start[1]], lat, lon)[0]
    assert abs(back - metres) < 0.01 or metres > 19_000_000


@settings(max_examples=150, deadline=None)
@given(_DEGREES, _DEGREES)
def test_straight_distance_bounds_the_geodesic(a, b):
    def place(lat, lon):
        phi, theta = math.radians(lat), math.radians(lon)
        n = geodesic.WGS84_A / math.sqrt(1 - geodesic._E2 * math.sin(phi) ** 2)
        return (
            n * math.cos(phi) * math.cos(theta), n * math.cos(phi) * math.sin(theta),
            n * (1 - geodesic._E2) * math.sin(phi),
        )

    chord = math.dist(place(*a), place(*b))
    metres = geodesic.metres_between([a[0]], [a[1]], [b[0]], [b[1]])[0]
    across = 2 * geodesic._TIGHTEST_RADIUS
    bound = across * math.asin(chord / across) * 1.000000001 + 0.01 if chord < across else geodesic.LONGEST
    assert chord <= metres + 0.001
    assert metres <= bound


def test_display_name(spark):
    names = ["cell_idCount", "aBcDeFg", "lat", "x", "ABCdef", "test_IDs"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(display_name("n")).collect()
    assert [r[0] for r in rows] == ["cell id Count", "a Bc De Fg", "lat", "x", "ABCdef", "test IDs"]
