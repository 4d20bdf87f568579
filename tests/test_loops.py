"""Operators against plain loops of the documented rules, on random small inputs."""

import itertools
import math
import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sparkmos.operators import alerts, asof, climatology, crossval, limits, nearest, tables, verify
from sparkmos.settings import OPERATIONAL, Point

T0 = datetime(2024, 3, 1)


def minute(t):
    return math.floor((t - datetime(1970, 1, 1)).total_seconds() / 60)


def km(a, b, c, d):
    x = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(x))


@pytest.mark.parametrize("seed,window,causal", [(1, 30, False), (2, 90, False), (3, 120, True)])
def test_forecast_lookup(spark, seed, window, causal):
    rnd = random.Random(seed)
    rows = [
        (i, rnd.choice("ab"), rnd.choice("pq"), T0 + timedelta(hours=6 * rnd.randint(0, 3)), T0 + timedelta(seconds=rnd.randint(0, 20000)), rnd.random())
        for i in range(300)
    ]
    fc = spark.createDataFrame(rows, "id bigint, model_name string, point_id string, run_time timestamp_ntz, valid_time timestamp_ntz, wind_speed_kn double")
    times = [T0 + timedelta(seconds=rnd.randint(0, 20000)) for _ in range(20)] + [T0, T0 + timedelta(minutes=59, seconds=59)]
    req = [(p, t) for p in "pq" for t in times]
    got = asof.forecasts_at(spark.createDataFrame(req, "point_id string, t timestamp_ntz"), fc, ["id"], window, causal=causal, tie_break=["id"])
    got = {(r.point_id, r.t, r.model_name): r.id for r in got.collect()}
    want = {}
    for p, t in req:
        best = {}
        for i, m, q, run, v, _ in rows:
            d = minute(v) - minute(t)
            if q == p and abs(d) <= window and not (causal and d > 0):
                key = (-run.timestamp(), abs(d), v, -i)
                if m not in best or key < best[m][0]:
                    best[m] = (key, i)
        want |= {(p, t, m): i for m, (_, i) in best.items()}
    assert got == want and want


@pytest.mark.parametrize("min_age,max_age", [(0, 60), (30, 120)])
def test_nearest_observation(spark, min_age, max_age):
    rnd = random.Random(min_age)
    rows = []
    for i in range(400):
        t = T0 + timedelta(seconds=rnd.randint(0, 6 * 3600))
        if i % 5 == 0:
            t = t.replace(minute=30 * rnd.randint(0, 1), second=0)
        lat = None if i % 97 == 0 else 46 + rnd.randint(4, 16) / 100
        rows.append((i, rnd.choice(["s1", "s2"]), t, lat, 9.3 + rnd.randint(0, 3) / 100, rnd.random()))
    obs = spark.createDataFrame(rows, "id bigint, source string, timestamp timestamp_ntz, lat double, lon double, wind_speed_kn double")
    req = [(p.point_id, T0 + timedelta(minutes=30 * k)) for p in OPERATIONAL for k in range(14)]
    got = nearest.nearest_observation(
        spark.createDataFrame(req, "point_id string, t timestamp_ntz"), obs, OPERATIONAL, max_age_min=max_age, min_age_min=min_age,
        payload=["id", "source", "timestamp"], tie_break=["id"],
    )
    got = {(r.point_id, r.t): r.id for r in got.collect()}
    where = {p.point_id: p for p in OPERATIONAL}
    want = {}
    for pid, t in req:
        p = where[pid]
        near = [
            (km(p.lat, p.lon, la or 0.0, lo), -ts.timestamp(), s, -i)
            for i, s, ts, la, lo, _ in rows
            if t - timedelta(minutes=max_age) <= ts <= t - timedelta(minutes=min_age)
        ]
        if near:
            want[pid, t] = -min(near)[3]
    assert got == want and want


def test_nearest_observation_with_a_thousand_points(spark):
    obs = spark.createDataFrame([(1, "s", T0, 46.1, 9.3)], "id bigint, source string, timestamp timestamp_ntz, lat double, lon double")
    points = [Point(f"p{i}", 46.0 + i / 1000, 9.3) for i in range(1000)]
    req = spark.createDataFrame([(p.point_id, T0) for p in points], "point_id string, t timestamp_ntz")
    got = nearest.nearest_observation(req, obs, points, max_age_min=60, payload=["id", "source", "timestamp"])
    assert {r.point_id for r in got.collect()} == {p.point_id for p in points}


def test_newest_value_over_days(spark):
    rnd = random.Random(7)
    rows = [(i, T0 + timedelta(seconds=rnd.randint(0, 8 * 86400)), rnd.choice([None, 1.0, 2.0])) for i in range(60)]
    rows += [(100, T0 + timedelta(days=2), 9.0), (101, T0 + timedelta(days=5, minutes=30), 8.0)]
    obs = spark.createDataFrame(rows, "id bigint, timestamp timestamp_ntz, temperature double")
    times = [T0 + timedelta(minutes=30 * rnd.randint(0, 400)) for _ in range(60)] + [T0 + timedelta(days=2), T0 + timedelta(days=5)]
    got = nearest.newest_value(spark.createDataFrame([(t,) for t in set(times)], "t timestamp_ntz"), obs, "temperature", max_age_hours=72, tie_break=["id"])
    got = {r.t: r.temperature for r in got.collect()}
    want = {}
    for t in set(times):
        ok = [(ts, i, v) for i, ts, v in rows if v is not None and t - timedelta(hours=72) <= ts <= t]
        if ok:
            want[t] = max(ok)[2]
    assert got == want and want


def history(rnd, n=3000):
    days = [datetime(2017, 1, 1) + timedelta(days=rnd.randint(0, 2500), hours=rnd.randint(0, 23)) for _ in range(n)]
    point = lambda: rnd.choice(["zurich", "milano_linate", "p"])
    return [(point(), d, rnd.choice([None, rnd.random() * 20]), rnd.random() * 360, rnd.random() * 30, 980 + rnd.random() * 40) for d in days]


CLIM = "point_id string, timestamp timestamp_ntz, wind_speed_10m double, wind_direction_10m double, temperature_2m double, pressure_msl double"


def in_window(ts, t, years):
    doy = lambda d: d.timetuple().tm_yday
    return max(1, doy(t) - 15) <= doy(ts) <= min(366, doy(t) + 15) and ts >= t - timedelta(days=365 * years)


def test_climatology(spark):
    rnd = random.Random(11)
    rows = history(rnd)
    # Year ends, the leap day, and times of day around the cutoff.
    times = [datetime(2023, 1, 3, 5), datetime(2023, 12, 30, 17), datetime(2024, 2, 29, 12), datetime(2023, 7, 1, 0), datetime(2023, 7, 1, 23)]
    years = 6
    clim = spark.createDataFrame(rows, CLIM)
    samples = spark.createDataFrame([("p", t, 7.5) for t in times], "point_id string, t timestamp_ntz, fc_speed double")
    got = {r.t: r for r in climatology.normals(samples, clim, years_back=years).collect()}
    pct = {r.t: r.seasonal_wind_percentile for r in climatology.seasonal_percentile(samples, clim, years_back=years).collect()}
    freq = {r.t: r for r in climatology.foehn_frequency(samples, clim, years_back=years).collect()}
    for t in times:
        mine = [r for r in rows if r[0] == "p" and in_window(r[1], t, years)]
        speeds = [r[2] for r in mine if r[2] is not None]
        assert got[t].climatology_wind_speed_normal == pytest.approx(sum(speeds) / len(speeds))
        temps = [r[4] for r in mine]
        assert got[t].climatology_temp_normal == pytest.approx(sum(temps) / len(temps))
        s, c = (sum(f(math.radians(r[3])) for r in mine) for f in (math.sin, math.cos))
        assert got[t].climatology_wind_dir_normal == pytest.approx((math.degrees(math.atan2(s, c)) + 360) % 360, abs=1e-6)
        noon = [r[2] for r in mine if r[2] is not None and 11 <= r[1].hour <= 16]
        assert got[t].climatology_breva_strength == pytest.approx(sum(noon) / len(noon))
        assert pct[t] == pytest.approx(100 * sum(v < 7.5 for v in speeds) / len(speeds), abs=0.051)
        means = {}
        for name in ("zurich", "milano_linate"):
            per_day = defaultdict(list)
            for r in rows:
                if r[0] == name and in_window(r[1], t, years):
                    per_day[r[1].date()].append(r[5])
            means[name] = {d: sum(v) / len(v) for d, v in per_day.items()}
        both = means["zurich"].keys() & means["milano_linate"].keys()
        hits = sum(means["zurich"][d] - means["milano_linate"][d] >= 8 for d in both)
        n_days = len({r[1].date() for r in rows if r[0] == "zurich" and r[1] >= t - timedelta(days=365 * years)})
        assert freq[t].n_north_days == n_days
        assert freq[t].climatology_foehn_frequency == pytest.approx(100 * hits / len(both), abs=0.006)


def test_foehn_frequency_needs_thirty_days(spark):
    rows = [(p, datetime(2023, 6, 1) + timedelta(days=i), 1.0, 1.0, 1.0, 1000.0) for i in range(29) for p in ("zurich", "milano_linate")]
    t = spark.createDataFrame([(datetime(2023, 6, 15),)], "t timestamp_ntz")
    r = climatology.foehn_frequency(t, spark.createDataFrame(rows, CLIM), years_back=1).first()
    assert r.climatology_foehn_frequency is None and r.n_north_days == 29


@pytest.mark.parametrize("seed,per_chunk", [(0, 1), (1, 3), (2, 7), (3, 100)])
def test_run_lengths(spark, seed, per_chunk):
    rnd = random.Random(seed)
    rows = [(k, i, rnd.choice([None, 1.0, 9.0, 9.0])) for k in "abc" for i in range(rnd.randint(1, 30))]
    df = spark.createDataFrame(rows, "k string, i int, v double").withColumn("chunk", F.floor(F.col("i") / per_chunk))
    got = {r.k: r.max_run for r in alerts.run_lengths(df, ["k"], [F.col("i")], F.col("v") >= 8, "chunk").collect()}
    for k in {r[0] for r in rows}:
        flags = [(v or 0) >= 8 for kk, _, v in rows if kk == k]
        assert got[k] == max((len(list(g)) for ok, g in itertools.groupby(flags) if ok), default=0)


@pytest.mark.parametrize("seed", range(4))
def test_purge_labels(spark, seed):
    rnd = random.Random(seed)
    n, g = rnd.randint(20, 60), rnd.randint(3, 6)
    k, purge, embargo = rnd.randint(1, 2), rnd.randint(0, 4), rnd.randint(0, 8)
    df = spark.range(n).withColumnRenamed("id", "idx")
    got = {(r.path_id, r.idx): r.label for r in crossval.training_labels(df, n, g, k, purge, embargo).collect()}
    size = n // g
    groups = [list(range(i * size, (i + 1) * size if i < g - 1 else n)) for i in range(g)]
    want = {}
    for path, combo in enumerate(itertools.combinations(range(g), k)):
        test = [i for c in combo for i in groups[c]]
        for idx in (i for c in range(g) if c not in combo for i in groups[c]):
            label = "train"
            for t in test:
                if abs(idx - t) <= purge:
                    label = "purged"
                    break
                if idx > t and idx - t <= embargo:
                    label = "embargo"
                    break
            want[path, idx] = label
    assert got == want


def test_sample_index_and_previous_sample(spark):
    rnd = random.Random(5)
    rows = []
    for h in range(80):
        t = T0 + timedelta(hours=3 * h)
        for p in rnd.sample(range(4), rnd.choice([1, 1, 2, 3])):
            rows.append((f"p{p}", p, t, rnd.random()))
    df = spark.createDataFrame(rows, "point_id string, p_order int, valid_time timestamp_ntz, obs_speed double")
    ordered = sorted(rows, key=lambda r: (r[2], r[1]))
    got = {(r.point_id, r.valid_time): r.idx for r in crossval.sample_index(df).collect()}
    assert got == {(r[0], r[2]): i for i, r in enumerate(ordered)}
    prev = {(r.point_id, r.valid_time): r.pers_speed for r in verify.previous_observation(df, ["valid_time"]).collect()}
    want = {
        (r[0], r[2]): ordered[i - 1][3] if i and ordered[i - 1][0] == r[0] else None for i, r in enumerate(ordered)
    }
    assert prev == want and any(v is not None for v in want.values())


def test_purge_labels_by_time(spark):
    """300 random tables of interleaved points, in 12 settings, against plain loops over time spans."""
    rnd = random.Random(4)
    kinds = [(g, k, *rnd.choice([(0, 0), (0, 6), (1, 3), (2.5, 6), (5, 2)])) for g in (2, 3, 4, 6) for k in (1, 2, 3) if k < g] + [(5, 2, 2, 6), (5, 1, 0, 3), (3, 1, 2, 6)]
    rows, want = [], {}
    for case in range(300):
        setting = case % len(kinds)
        g, test, purge, embargo = kinds[setting]
        n, points = rnd.randrange(g, 60), rnd.randrange(1, 5)
        hours = sorted(rnd.choice([0, 1, 1.5]) * (i // points) for i in range(n)) if case % 2 else [i // points for i in range(n)]
        group = [min(i // (n // g), g - 1) for i in range(n)]
        spans = [(min(h for h, x in zip(hours, group) if x == c), max(h for h, x in zip(hours, group) if x == c)) for c in range(g)]
        at = [tuple(T0 + timedelta(hours=h) for h in s) for s in spans]
        rows += [(case, setting, i, T0 + timedelta(hours=h), n, at) for i, h in enumerate(hours)]
        for path, combo in enumerate(itertools.combinations(range(g), test)):
            for i, h in enumerate(hours):
                if group[i] not in combo:
                    near = any(spans[c][0] - purge <= h <= spans[c][1] + purge for c in combo)
                    after = any(spans[c][1] < h <= spans[c][1] + embargo for c in combo)
                    want[case, path, i] = "purged" if near else "embargo" if after else "train"
    df = spark.createDataFrame(rows, "case int, setting int, idx long, valid_time timestamp_ntz, n long, spans array<struct<first:timestamp_ntz,last:timestamp_ntz>>").cache()
    got = {}
    for k, (g, test, purge, embargo) in enumerate(kinds):
        grp = crossval.group_of(F.col("idx"), F.col("n"), g)
        labels = [
            F.when(~grp.isin(*c), crossval.purge_label_by_time(F.col("valid_time"), F.col("spans"), c, purge, embargo)) for c in crossval.paths(g, test)
        ]
        for r in df.where(F.col("setting") == k).select("case", "idx", F.array(*labels).alias("l")).collect():
            got |= {(r.case, p, r.idx): v for p, v in enumerate(r.l) if v is not None}
    assert got == want and set(want.values()) == {"train", "purged", "embargo"}
    # The whole operators on one of the tables.
    for case, setting in ((len(kinds) - 3, len(kinds) - 3), (len(kinds) - 1, len(kinds) - 1)):
        one = df.where(F.col("case") == case).select("idx", "valid_time")
        n, options = one.count(), dict(zip(("n_groups", "n_test", "purge", "embargo"), kinds[setting]))
        mine = {(p, i): v for (c, p, i), v in want.items() if c == case}
        assert {(r.path_id, r.idx): r.label for r in crossval.training_labels(one, n, **options, by_time="valid_time").collect()} == mine
        flags = {(p, r.idx) for r in crossval.training_flags(one, n, **options, by_time="valid_time").collect() for p, f in enumerate(r.use) if f}
        assert flags == {key for key, v in mine.items() if v == "train"}
        for r in crossval.label_counts(one, n, **options, by_time="valid_time").collect():
            here = [v for (p, _), v in mine.items() if p == r.path_id]
            assert [r.n_train, r.n_purged, r.n_embargo] == [here.count(x) for x in ("train", "purged", "embargo")]


@pytest.mark.parametrize("train,test,step,days", [(7, 5, 3, 30), (10, 4, 2, 14), (10, 10, 1, 12)])
def test_walk_forward_windows(spark, train, test, step, days):
    end = T0 + timedelta(days=days)
    want, cur = [], T0 + timedelta(days=train)
    while cur + timedelta(days=test) <= end:
        want.append((cur, cur + timedelta(days=test)))
        cur += timedelta(days=step)
    if not want:
        want = [(end - timedelta(days=test), end)]
    got = crossval.walk_forward_windows(spark, T0, end, train, test, step).orderBy("window_id").collect()
    assert [(r.test_start, r.test_end) for r in got] == want
    s = spark.createDataFrame([(T0 + timedelta(hours=5 * i),) for i in range(days * 5)], "valid_time timestamp_ntz")
    hits = {(r.valid_time, r.window_id) for r in crossval.with_windows(s, T0, end, train, test, step).collect()}
    assert hits == {(t.valid_time, i) for t in s.collect() for i, (a, b) in enumerate(want) if a <= t.valid_time < b}


def test_upsert_in_place(spark):
    cur = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id int, k string, v double")
    batch = spark.createDataFrame([(7, "b", 3.0, 1), (8, "b", None, 2), (9, "c", 4.0, 1)], "id int, k string, v double, seq int")
    got = {r.k: (r.id, r.v) for r in tables.upsert(cur, batch, ["k"], "seq", keep=["id"]).collect()}
    assert got == {"a": (1, 1.0), "b": (2, None), "c": (9, 4.0)}


def test_commands_in_the_last_hour(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice("ab"), T0 + timedelta(seconds=rnd.randint(0, 5 * 3600))) for i in range(150)]
    df = spark.createDataFrame(rows, "id int, u string, ts timestamp_ntz")
    got = {r.id: r.n_last_hour for r in limits.commands_last_hour(df, "u", "ts").collect()}
    assert got == {i: sum(v == u and t - timedelta(hours=1) <= s <= t for _, v, s in rows) for i, u, t in rows}


def test_normalized_scores_undo_the_scale_of_the_shift(spark):
    from sparkmos.operators import conformal

    rows = [(1.0, 2.0, 0.5, 0.5, 0.4), (0.0, -1.0, 0.0, 0.0, 0.05), (None, 1.0, 0.0, 0.0, 0.2)]
    df = spark.createDataFrame(rows, "target_u double, target_v double, bias_u_q50 double, bias_v_q50 double, expected double")
    got = {(r.target, round(r.score, 9)) for r in conformal.scores_of(df, [0.5], "expected").collect()}
    assert got == {("u", 0.125), ("v", 0.375), ("u", 0.0), ("v", 1.0), ("v", 0.5)}


def test_pairs_in_a_crowded_hour(spark):
    """Many readings and valid times in one hour: the same as the nearest of all, newer first on ties."""
    from sparkmos.operators import verify

    rnd = random.Random(8)
    times = [(T0 + timedelta(seconds=rnd.randint(0, 7200)),) for _ in range(80)]
    obs = [(T0 + timedelta(seconds=rnd.randint(0, 3600)), rnd.choice("abc"), float(i)) for i in range(2000)] + [(T0 - timedelta(minutes=20), "z", -1.0)]
    got = verify.nearest_of_all(
        spark.createDataFrame(times, "valid_time timestamp_ntz").distinct(),
        spark.createDataFrame(obs, "obs_time timestamp_ntz, obs_source string, obs_speed double"), 1800, ["obs_speed"],
    ).collect()
    want = {}
    for (t,) in times:
        near = [(abs((o - t).total_seconds()), -o.timestamp(), s, -v) for o, s, v in obs if abs((o - t).total_seconds()) <= 1800]
        if near:
            want[t] = -min(near)[3]
    assert {r.valid_time: r.obs_speed for r in got} == want and want
