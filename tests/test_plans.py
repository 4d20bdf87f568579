"""The shape of the physical plans: what must hold whatever the data's size."""

import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from sparkmos.functions.common import ts
from sparkmos.operators import asof, nearest, tables
from sparkmos.plans import features
from sparkmos.session import materialize, scratch_dir
from sparkmos.settings import OPERATIONAL
from sparkmos.sources import payload

# The training-data operators have tests of their own.
QUERIES = {name: fn for name, (fn, _) in driver.REGISTRY.items()}
# Plans that only read a result written by their own jobs tell nothing here.
LAZY = sorted(n for n in QUERIES if not n.startswith(("t0", "k04", "d04", "d06", "a27", "d14_cross_validation_retrained")))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_all_pairs_join_and_no_python_rows(spark, sf, name):
    p = plan(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "Python" not in p and "InPandas" not in p


def test_library_gives_no_broadcast_hints_and_no_local_checkpoint():
    import pathlib

    root = pathlib.Path(driver.__file__).parent / "sparkmos"
    for f in root.rglob("*.py"):
        if "llm" in f.parts:  # has tests of its own
            continue
        text = f.read_text()
        assert "broadcast(" not in text and "localCheckpoint" not in text and "crossJoin" not in text, f


@pytest.fixture(scope="module")
def stored(spark):
    """A forecast and an observation table partitioned by day."""
    t0 = datetime(2024, 1, 1)
    rows = [(i, "icon_eu", OPERATIONAL[i % 7].point_id, t0 + timedelta(hours=i - 6), t0 + timedelta(hours=i), float(i % 20)) for i in range(24 * 30)]
    fc = spark.createDataFrame(rows, "id bigint, model_name string, point_id string, run_time timestamp_ntz, valid_time timestamp_ntz, wind_speed_kn double")
    others = ["wind_dir_deg", "wind_gust_kn", "pressure_msl", "temperature_2m", "dew_point_2m", "cloud_cover", "shortwave_radiation", "cape", "boundary_layer_height", "precipitation", "visibility"]
    fc = fc.withColumns({c: F.lit(1.0) for c in others}).withColumn("weather_code", F.lit(1)).withColumn("seq", F.col("id"))
    path = scratch_dir(spark)
    tables.upsert_path(spark, path, fc, ["model_name", "point_id", "run_time", "valid_time"], "seq", "valid_time")
    obs = spark.createDataFrame([(i, "s", t0 + timedelta(minutes=20 * i), 46.1, 9.3) for i in range(72 * 30)], "id bigint, source string, timestamp timestamp_ntz, lat double, lon double")
    obs = obs.withColumns({c: F.lit(3.0) for c in ("wind_speed_kn", "wind_dir_deg", "wind_gust_kn", "temperature")}).withColumn("seq", F.col("id"))
    opath = scratch_dir(spark)
    tables.upsert_path(spark, opath, obs, ["source", "timestamp", "lat", "lon"], "seq", "timestamp")
    return spark.read.parquet(path), spark.read.parquet(opath)


def test_features_read_only_the_days_they_need(spark, stored):
    fc, obs = stored
    start, end = ts("2024-01-15 00:00:00"), ts("2024-01-16 00:00:00")
    samples = spark.createDataFrame([(p.point_id, datetime(2024, 1, 15, h)) for p in OPERATIONAL for h in range(24)], "point_id string, t timestamp_ntz")
    pruned = features.build_features(samples, fc, obs, OPERATIONAL, start=start, end=end)
    scans = [line for line in plan(pruned).splitlines() if "FileScan" in line]
    assert scans and all("PartitionFilters: [isnotnull(day" in s for s in scans)
    whole = features.build_features(samples, fc, obs, OPERATIONAL)
    key = ["point_id", "valid_time"]
    a, b = (d.select(*key, "lag240_speed", "thermal_inertia_avg_temp", "obs_nearest_speed", "target_u").orderBy(*key).collect() for d in (pruned, whole))
    assert a == b and len(a) > 0


def history(spark, stored):
    """Climatology beside ``stored``: years of hours, some of them twice, some without values."""
    points = [p.point_id for p in OPERATIONAL] + ["zurich", "milano_linate"]
    t0 = datetime(2021, 12, 1)
    rows = [(points[i % 9], t0 + timedelta(hours=(i * 5) % 20000), None if i % 11 == 0 else float(i % 23), float(i * 7 % 360), float(i % 31), 980.0 + i * 13 % 40) for i in range(30000)]
    path = scratch_dir(spark)
    spark.createDataFrame(rows, "point_id string, timestamp timestamp_ntz, wind_speed_10m double, wind_direction_10m double, temperature_2m double, pressure_msl double").write.parquet(path)
    return spark.read.parquet(path)


def near_equal(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and a == pytest.approx(b, abs=1e-9)


def test_stored_inputs_give_the_same_features(spark, stored):
    """Several runs of a minute, equal runs told apart by id, and rows without keys."""
    fc, obs = stored
    extra = fc.withColumns({"run_time": F.expr("run_time - INTERVAL 6 HOUR"), "wind_speed_kn": F.lit(99.0), "id": F.col("id") + 5000})
    equal = fc.filter("id % 3 = 0").withColumns({"wind_speed_kn": F.col("id") % 7 + 0.5, "id": F.col("id") + 9000})
    other = fc.withColumns({"model_name": F.lit("gfs_seamless"), "valid_time": F.expr("valid_time + INTERVAL 20 MINUTE"), "temperature_2m": F.col("id") * 0.1})
    odd = fc.filter("id < 9").withColumns({"point_id": F.when(F.col("id") % 2 == 0, F.col("point_id")), "model_name": F.when(F.col("id") % 3 == 0, F.col("model_name"))})
    fc = fc.unionByName(extra).unionByName(equal).unionByName(other).unionByName(odd)
    samples = spark.createDataFrame([(p.point_id, datetime(2024, 1, d, h)) for p in OPERATIONAL for d in (1, 15) for h in range(24)], "point_id string, t timestamp_ntz")
    lazy, kept = (
        features.build_features(samples, fc, obs, OPERATIONAL, climatology=history(spark, stored), years_back=2, tie_break=["id"], store=s).orderBy("point_id", "valid_time") for s in (False, True)
    )
    assert lazy.schema == kept.schema
    a, b = lazy.collect(), kept.collect()
    assert len(a) == len(b) > 0
    assert [(x, c) for x, y in zip(a, b) for c in lazy.columns if not near_equal(x[c], y[c])] == []
    assert any(x.climatology_foehn_frequency is not None for x in a) and any(x.seasonal_wind_percentile is not None for x in a)


def test_stored_inputs_are_read_once(spark, sf):
    """Of the history only the percentile's two short reads are left in the plan, of the forecasts none."""
    from checks.featureset import features_df

    scans = [line.split("]")[0] for line in plan(features_df(spark, sf)).splitlines() if "FileScan" in line]
    assert sum("l_shipdate" in s for s in scans) <= 2
    assert sum("user_id" in s or "event_id" in s for s in scans) <= 3  # the nearest observation, the water temperature by minute and by hour


def test_percentile_counts_only_days_in_reach(spark):
    """Days outside every window are gone before the first exchange, and the cutoff days' rows alone are shuffled."""
    from sparkmos.operators import climatology

    path = scratch_dir(spark)
    spark.createDataFrame([("p", datetime(2023, 1, 1) + timedelta(days=i), float(i % 9)) for i in range(700)], "point_id string, timestamp timestamp_ntz, wind_speed_10m double").write.parquet(path)
    asked = spark.createDataFrame([("p", datetime(2024, 1, 20, 5), 4.5), ("p", datetime(2024, 2, 1), 2.5)], "point_id string, t timestamp_ntz, fc_speed double")
    found = climatology.seasonal_percentile(asked, spark.read.parquet(path), years_back=1)
    lines = plan(found).split("Subqueries")[0].splitlines()  # before it is run: the plan as made
    rows = [float(i % 9) for i in range(700)]
    day = lambda i: datetime(2023, 1, 1) + timedelta(days=i)
    for r in found.collect():
        x = 4.5 if r.t.month == 1 else 2.5
        doy = r.t.timetuple().tm_yday
        mine = [v for i, v in enumerate(rows) if abs(day(i).timetuple().tm_yday - doy) <= 15 and day(i) >= r.t - timedelta(days=365)]
        assert r.seasonal_wind_percentile == pytest.approx(100 * sum(v < x for v in mine) / len(mine), abs=0.051)
    above = [next(line for line in reversed(lines[:i]) if "Filter (" in line or "hashpartitioning" in line) for i, line in enumerate(lines) if "FileScan" in line]
    assert len(above) == 2 and all("ubquery" in line for line in above), above


def test_scans_read_only_needed_columns(spark, stored):
    fc, _ = stored
    req = spark.createDataFrame([("dongo_shore", datetime(2024, 1, 15))], "point_id string, t timestamp_ntz")
    p = plan(asof.forecasts_at(req, fc, ["wind_speed_kn"], 90))
    assert "wind_speed_kn" in p and "cape" not in p and "visibility" not in p


def test_lookups_reduce_before_the_shuffle(spark, stored):
    fc, obs = stored
    req = spark.createDataFrame([("dongo_shore", datetime(2024, 1, 15))], "point_id string, t timestamp_ntz")
    for df in (asof.forecasts_at(req, fc, ["wind_speed_kn"], 90), nearest.nearest_observation(req, obs, OPERATIONAL, max_age_min=60)):
        assert "WindowGroupLimit" in plan(df) and ", Partial" in plan(df)


def test_raw_observations_are_not_shuffled(spark, stored):
    """Between the scan and the first exchange the best row per (point, minute) is taken."""
    _, obs = stored
    req = spark.createDataFrame([("dongo_shore", datetime(2024, 1, 15))], "point_id string, t timestamp_ntz")
    lines = plan(nearest.nearest_observation(req, obs, OPERATIONAL, max_age_min=60)).splitlines()
    scan = next(i for i, line in enumerate(lines) if "FileScan" in line)
    above = [line for line in lines[:scan]]
    last_exchange = max(i for i, line in enumerate(above) if "Exchange" in line)
    assert any("WindowGroupLimit" in line for line in above[last_exchange:])


def test_materialized_results_survive_and_keep_their_schema(spark):
    df = spark.createDataFrame([(1, datetime(2024, 1, 1), None)], "a int, t timestamp_ntz, x double")
    out = materialize(df)
    assert out.schema == df.schema and out.collect() == df.collect()


def test_stored_upsert_reads_only_touched_days(spark, monkeypatch):
    """The day list of the batch is a partition filter of the scan."""
    t0 = datetime(2024, 1, 1)
    kind = "id bigint, k string, at timestamp_ntz, seq bigint"
    path, seen = scratch_dir(spark), []
    tables.upsert_path(spark, path, spark.createDataFrame([(i, "a", t0 + timedelta(days=i), i) for i in range(9)], kind), ["k", "at"], "seq", "at", keep=["id"])
    whole = tables.upsert
    monkeypatch.setattr(tables, "upsert", lambda old, *a: seen.append(old) or whole(old, *a))
    tables.upsert_path(spark, path, spark.createDataFrame([(100, "a", t0 + timedelta(days=4), 1)], kind), ["k", "at"], "seq", "at", keep=["id"])
    assert "= 2024-01-05" in plan(seen[0]).split("PartitionFilters:")[1].split("]")[0]
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == list(range(9))  # the old id stays


def test_ring_takes_any_number_of_points(spark):
    from sparkmos.functions.geo import haversine_km  # noqa: F401  the same distance as the look-up's
    from sparkmos.operators import spatial
    from sparkmos.settings import Point
    from sparkmos.sources.points import points_df

    points = [Point(f"p{i}", 45.0 + (i % 40) / 10, 8.0 + (i // 40) / 8) for i in range(1000)]
    centres = points_df(spark, points[500:503])
    got = {(r.centre_id, r.direction): (r.point_id, round(r.km, 6)) for r in spatial.ring_sources(centres, points).collect()}
    ring = centres.select(F.col("point_id").alias("c"), F.inline(spatial.geo.compass_ring(F.col("lat"), F.col("lon"), 20.0)))
    every = ring.select("c", "direction", "lat", "lon", F.inline(spatial.inline_points(points)))
    every = every.withColumn("km", haversine_km(F.col("lat"), F.col("lon"), F.col("p_lat"), F.col("p_lon"))).where("km <= 25")
    want = {(r.c, r.direction): (r.m.point_id, round(r.m.km, 6)) for r in every.groupBy("c", "direction").agg(F.min(F.struct("km", "point_id")).alias("m")).collect()}
    assert got == want and len(got) == 27


def test_look_ups_find_their_own_days(spark):
    """Without bounds from the caller, the targets' span prunes the partitions of the predictions."""
    from sparkmos.operators import serve

    t0 = datetime(2024, 1, 1)
    rows = [(i, "p", t0 + timedelta(hours=i), t0 + timedelta(hours=i), i) for i in range(24 * 20)]
    made = spark.createDataFrame(rows, "id bigint, point_id string, generated_at timestamp_ntz, valid_time timestamp_ntz, seq bigint")
    path = scratch_dir(spark)
    tables.upsert_path(spark, path, made, ["id", "valid_time"], "seq", "valid_time")
    asked = spark.createDataFrame([("p", t0 + timedelta(days=9, hours=5))], "point_id string, target timestamp_ntz")
    found = serve.prediction_at(asked, spark.read.parquet(path), ["point_id", "target"])
    assert [r.id for r in found.collect()] == [9 * 24 + 5]
    scans = [x.split("]")[0] for x in plan(found).split("PartitionFilters:")[1:]]
    assert any("day" in x and "ubquery" in x for x in scans), scans


def test_pairs_read_observations_once(spark, sf):
    """One scan of the observations' table; predictions are read for their distinct times and for the join."""
    for name, scans in (("j05_verification_pairs", 3), ("a16_accuracy_report", 3), ("w09_last_pairs", 3), ("d21_validation_report", 3), ("a29_error_histogram", 2)):
        p = plan(QUERIES[name](spark, sf)).split("Subqueries")[0]
        assert p.count("FileScan") <= scans, (name, p.count("FileScan"))


def test_spread_is_parsed_once_per_row(spark):
    """All fields come from one parse of the text, whatever it holds."""
    texts = ['{"n_members": 3, "speed_mean": 1.5, "dir_std": null}', "{}", None, "", "no json", '{"n_members": 2, "more": [1]}', '{"speed_std": "x"}']
    s = payload.spread_from_json(F.col("raw"))
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, raw string").select("i", s["n_members"].alias("n"), s["speed_mean"].alias("m"), s["dir_std"].alias("d"))
    assert len(set(re.findall(r"from_json\((.*?), raw#", got._jdf.queryExecution().optimizedPlan().toString()))) == 1
    assert [tuple(r) for r in got.orderBy("i").collect()] == [(0, 3, 1.5, None), (1, None, None, None), (2, None, None, None), (3, None, None, None), (4, None, None, None), (5, 2, None, None), (6, None, None, None)]
