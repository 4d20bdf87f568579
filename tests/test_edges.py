"""Edges of the formulas: missing values, wrap-around, clock changes, polar day."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sparkmos.functions import decision, geo, text, timefn, weather, wind
from sparkmos.functions.common import clamp, mean_of_present, rnd
from sparkmos.functions.solar import add_solar
from sparkmos.operators import quality, tables
from sparkmos.sources import payload, stations


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_directions(spark):
    lit = F.lit
    r = one(
        spark, wind.direction_error(lit(350.0), lit(10.0)), wind.direction_error(lit(10.0), lit(350.0)), wind.direction_error(lit(0.0), lit(180.0)),
        wind.direction_of(lit(0.0), lit(-5.0)), wind.speed_of(lit(1e-9), lit(0.0)), wind.name_16(lit(360.0)), wind.name_16(lit(348.75), "round"),
        wind.name_16(lit(348.75)), wind.name_8(lit(337.5)),
    )
    assert list(r) == [20.0, 20.0, 180.0, 0.0, 0.0, "N", "N", "NNW", "N"]


def test_rounding_ties_are_half_up(spark):
    assert list(one(spark, rnd(F.lit(0.285), 2), rnd(F.lit(2.675), 2), rnd(F.lit(-0.125), 2))) == [0.29, 2.68, -0.13]


def test_missing_values_stay_missing(spark):
    null = F.lit(None).cast("double")
    r = one(
        spark, clamp(null, 0, 1), mean_of_present(null, F.lit(1.0), at_least=2), mean_of_present(null, F.lit(1.0), F.lit(3.0), at_least=2),
        decision.confidence(null, F.lit(True), F.lit(5)), weather.is_rainy(F.lit(None).cast("int")), weather.sailing_warning(F.lit(None).cast("int"), F.lit(30.0), null),
        decision.observation_confidence(null, null),
    )
    assert list(r) == [None, None, 2.0, None, False, None, 0.0]


@pytest.mark.parametrize("value,deg", [("NORD", 0.0), ("N", 0.0), ("WSW", 247.5), ("variabile", None), ("nne-ne", 33.75), ("370 °", 10.0), ("", None), ("xyz", None)])
def test_cardinal_text(spark, value, deg):
    assert one(spark, text.cardinal_deg(F.lit(value)))[0] == deg


def test_numbers_in_text(spark):
    r = one(spark, text.number_in(F.lit("11,5 km/h")), text.unit_in(F.lit("11,5 km/h")), text.number_in(F.lit("-")), text.number_in(F.lit("-3 °C")))
    assert list(r) == [11.5, "km/h", None, -3.0]


def test_clock_changes(spark):
    at = lambda s: timefn.local(F.lit(s).cast("timestamp_ntz"))
    r = one(spark, at("2024-03-31 00:59:00"), at("2024-03-31 01:00:00"), at("2024-10-27 00:59:00"), at("2024-10-27 01:00:00"))
    assert [x.hour for x in r] == [1, 3, 2, 2]


def test_quiet_hours_over_midnight(spark):
    def quiet(hhmm, lo, hi):
        t = F.lit(f"2024-01-01 {hhmm}:00").cast("timestamp_ntz")
        return timefn.in_quiet_hours(t, F.lit(lo), F.lit(hi))

    r = one(spark, quiet("22:00", "22:00", "07:00"), quiet("07:00", "22:00", "07:00"), quiet("07:01", "22:00", "07:00"), quiet("14:00", "14:00", "18:00"), quiet("13:59", "14:00", "18:00"))
    assert list(r) == [True, True, False, True, False]


def test_solar_spot_values(spark):
    # Lake, midsummer and midwinter noon; the far north in polar day and night.
    rows = [("summer", datetime(2024, 6, 21, 11, 24), 46.1, 9.3), ("winter", datetime(2024, 12, 21, 11, 21), 46.1, 9.3), ("day", datetime(2024, 6, 21, 0, 0), 78.2, 15.6), ("night", datetime(2024, 12, 21, 12, 0), 78.2, 15.6)]
    df = add_solar(spark.createDataFrame(rows, "k string, t timestamp_ntz, lat double, lon double"), "t")
    r = {x.k: x for x in df.collect()}
    assert r["summer"].solar_elevation == pytest.approx(90 - 46.1 + 23.44, abs=0.1)
    assert r["winter"].solar_elevation == pytest.approx(90 - 46.1 - 23.44, abs=0.1)
    assert r["summer"].solar_azimuth == pytest.approx(180, abs=1.5)
    assert r["summer"].solar_is_daytime and r["summer"].solar_day_length_min == pytest.approx(15.7 * 60, abs=12)
    assert r["winter"].solar_day_length_min == pytest.approx(8.7 * 60, abs=12)
    assert r["day"].solar_elevation > 0 and r["day"].solar_day_length_min is None and not r["day"].solar_is_daytime
    assert r["night"].solar_elevation < 0 and r["night"].solar_minutes_since_sunrise is None


def test_polygon(spark):
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    inside = lambda x, y: geo.inside_polygon(F.lit(x), F.lit(y), square)
    r = one(spark, inside(0.5, 0.5), inside(1.5, 0.5), geo.distance_to_polygon_m(F.lit(0.5), F.lit(0.5), square), geo.distance_to_polygon_m(F.lit(2.0), F.lit(2.0), square))
    assert r[0] and not r[1] and r[2] == pytest.approx(55_500) and r[3] == pytest.approx(2**0.5 * 111_000)


def test_limits_flag_only_what_was_removed(spark):
    df = spark.createDataFrame([(360.0, "12", None), (-1.0, "x", 5.0), (10.0, None, 9999.0)], "wind_dir_deg double, pressure string, cape double")
    out = [(r.wind_dir_deg, r.pressure, r.cape, r.suspect) for r in quality.apply_limits(df).collect()]
    assert out == [(0.0, None, None, True), (None, None, 5.0, True), (10.0, None, None, True)]
    clean = quality.apply_limits(spark.createDataFrame([(0.0, None)], "wind_dir_deg double, cape double")).first()
    assert not clean.suspect


def test_payload_arrays_may_be_short_or_absent(spark):
    rows = [
        ("p", "m", '{"hourly": {"time": ["2024-01-01T07:00", "bad", "2024-01-01T09:00Z"], "wind_speed_10m": [1.5]}}'),
        ("p", "m", '{"hourly": {"time": []}}'),
        ("p", "m", "{}"),
        ("p", "m", "not json"),
    ]
    out = payload.forecast_rows(spark.createDataFrame(rows, "point_id string, model_name string, payload string")).orderBy("valid_time").collect()
    assert [(r.valid_time.hour, r.run_time.hour, r.wind_speed_kn) for r in out] == [(7, 6, 1.5), (9, 6, None)]


def test_payload_in_local_time(spark):
    rows = [("p", "m", '{"hourly": {"time": ["2024-07-01T00:00"], "wind_speed_10m": [1]}}')]
    out = payload.forecast_rows(spark.createDataFrame(rows, "point_id string, model_name string, payload string"), tz="Europe/Rome").first()
    assert (out.valid_time, out.run_time) == (datetime(2024, 6, 30, 22), datetime(2024, 6, 30, 18))


def test_page_value_row_is_not_read_as_labels(spark):
    html = '<table><tr><td class="des2">Vento:</td></tr><tr><td>Pressione</td></tr><tr><td>991 Hpa</td></tr></table>'
    rows = spark.createDataFrame([(html, datetime(2024, 1, 1))], "html string, fetched_at timestamp_ntz")
    r = stations.page_observations(rows).first()
    assert r.pressure is None and r.wind_speed_kn is None and r.quality_flag == "suspect"


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "k string, v double, seq int")
    cur = spark.createDataFrame([("a", 1.0)], "k string, v double")
    assert tables.upsert(cur, empty, ["k"], "seq").count() == 1
    assert tables.upsert(cur.limit(0), empty, ["k"], "seq").count() == 0
