"""File streams in several micro-batches equal the batch rules."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sparkmos.session import scratch_dir
from sparkmos.streaming import keyed, sources, stateful

T0 = datetime(2024, 5, 1)
SCHEMA = "id bigint, source string, timestamp timestamp_ntz, lat double, lon double, wind_speed_kn double, wind_dir_deg double"


@pytest.fixture(scope="module")
def slices(spark, tmp_path_factory):
    """Observations in time order over six files; every 97th row is held back to the last."""
    rnd = random.Random(0)
    rows = [
        (i, rnd.choice(["a", "b", "c"]), T0 + timedelta(seconds=60 * i + rnd.randint(0, 50)), 46.1, 9.3, rnd.choice([5.0, 12.0, 12.0, 14.0, 150.0]), rnd.random() * 360)
        for i in range(900)
    ]
    late = [r for r in rows if r[0] % 97 == 96]
    rest = [r for r in rows if r[0] % 97 != 96]
    path = str(tmp_path_factory.mktemp("obs"))
    for k in range(6):
        part = rest[k * 150 : (k + 1) * 150 if k < 5 else None] + (late if k == 5 else [])
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path, rows


def stream(spark, path):
    return sources.file_stream(spark, path, spark.read.parquet(path).schema, files_per_batch=1)


def read(spark, df, path):
    return spark.read.schema(df.schema).parquet(path)


def test_ingest_equals_batch(spark, slices):
    path, _ = slices
    out = scratch_dir(spark)
    s = sources.clean_observations(stream(spark, path))
    sources.run_available(s, path=out)
    batch = sources.clean_observations(spark.read.parquet(path))
    assert sorted(read(spark, s, out).collect()) == sorted(batch.collect())


def test_upsert_sink_is_repeatable(spark, slices):
    path, _ = slices
    out = scratch_dir(spark)
    sink = keyed.upsert_sink(spark, out, ["source", "hr"], "hr", order="id")
    s = stream(spark, path).withColumn("hr", F.date_trunc("hour", "timestamp").cast("timestamp_ntz"))

    def twice(batch, batch_id):
        sink(batch, batch_id)
        sink(batch, batch_id)  # a retried micro-batch

    sources.run_available(s, sink=twice)
    got = {(r.source, r.hr) for r in spark.read.parquet(out).collect()}
    batch = spark.read.parquet(path).withColumn("hr", F.date_trunc("hour", "timestamp").cast("timestamp_ntz"))
    assert got == {(r.source, r.hr) for r in batch.select("source", "hr").distinct().collect()}
    assert spark.read.parquet(out).count() == len(got)


def test_windows_equal_batch(spark, slices):
    path, _ = slices
    out = scratch_dir(spark)
    s = keyed.source_statistics(stream(spark, path), "timestamp", "2 days")
    sources.run_available(s, "update", sink=keyed.upsert_sink(spark, out, ["source", "window_start"], "window_start"))
    got = {(r.source, r.window_start): (r.n, round(r.mean_speed, 6)) for r in spark.read.parquet(out).collect()}
    b = spark.read.parquet(path).groupBy("source", F.date_trunc("hour", "timestamp").cast("timestamp_ntz").alias("w")).agg(F.count("*").alias("n"), F.avg("wind_speed_kn").alias("m"))
    assert got == {(r.source, r.w): (r.n, round(r.m, 6)) for r in b.collect()}


def test_deduplicate_across_batches(spark, slices, tmp_path):
    path, rows = slices
    twice = str(tmp_path)
    for _ in range(2):
        spark.read.parquet(path).write.mode("append").parquet(twice)
    out = scratch_dir(spark)
    s = keyed.deduplicate(stream(spark, twice), ["id"], "timestamp", "2 days")
    sources.run_available(s, path=out)
    assert sorted(r.id for r in read(spark, s, out).collect()) == [r[0] for r in rows]


def test_future_rows_are_dropped(spark, slices):
    path, rows = slices
    cut = F.lit("2024-05-01 05:00:00").cast("timestamp_ntz")
    out = scratch_dir(spark)
    s = sources.drop_future(stream(spark, path), "timestamp", cut)
    sources.run_available(s, path=out)
    assert read(spark, s, out).count() == sum(r[2] <= T0 + timedelta(hours=6) for r in rows)


def test_sessions_close_after_the_gap(spark, slices):
    path, rows = slices
    out = scratch_dir(spark)
    s = keyed.windy_sessions(stream(spark, path), "timestamp", "2 days", "3 minutes", 10.0)
    sources.run_available(s, path=out)
    assert read(spark, s, out).count() == 0  # the watermark has not passed any session yet
    out2 = scratch_dir(spark)
    s2 = keyed.windy_sessions(stream(spark, path), "timestamp", "5 minutes", "3 minutes", 10.0)
    sources.run_available(s2, path=out2)
    assert read(spark, s2, out2).count() > 0


@pytest.fixture(scope="module")
def commands(spark, tmp_path_factory):
    rnd = random.Random(9)
    rows = sorted(((i, rnd.choice("uv"), T0 + timedelta(seconds=rnd.randint(0, 6 * 3600))) for i in range(400)), key=lambda r: (r[2], r[0]))
    path = str(tmp_path_factory.mktemp("cmd"))
    for k in range(5):
        spark.createDataFrame(rows[k * 80 : (k + 1) * 80], "id bigint, user string, ts timestamp_ntz").coalesce(1).write.mode("append").parquet(path)
    return path, rows


def test_rate_limit_equals_loop(spark, commands):
    path, rows = commands
    out = scratch_dir(spark)
    s = stateful.rate_limit(stream(spark, path), "user", "ts", "id", per_hour=10)
    sources.run_available(s, path=out)
    got = {r.row_id: r.accepted for r in read(spark, s, out).collect()}
    recent, want = {"u": [], "v": []}, {}
    for i, u, t in rows:
        recent[u] = [x for x in recent[u] if (t - x).total_seconds() < 3600]
        want[i] = len(recent[u]) < 10
        if want[i]:
            recent[u].append(t)
    # The last hour waits for the watermark.
    passed = {i for i, _, t in rows if t < rows[-1][2].replace(microsecond=0) - timedelta(hours=1)}
    assert got == {i: ok for i, ok in want.items() if i in passed} and not all(got.values())


@pytest.mark.parametrize("rule", ["rate_limit", "cool_down"])
def test_answers_do_not_depend_on_the_cut(spark, tmp_path, rule):
    """One file a batch, all at once, and files in another order: always the same rows."""
    rnd = random.Random(4)
    rows = [(i, rnd.choice("uv"), T0 + timedelta(minutes=rnd.randint(0, 600))) for i in range(200)]
    rows.sort(key=lambda r: (r[2] + timedelta(minutes=rnd.randint(0, 100)), r[0]))  # late, but within the delay
    answers = []
    for name, step, order in (("one", 40, rows), ("all", 200, rows), ("other", 40, [*rows[40:80], *rows[:40], *rows[80:]])):
        path = str(tmp_path / name)
        for k in range(0, 200, step):
            spark.createDataFrame(order[k : k + step], "id bigint, user string, ts timestamp_ntz").coalesce(1).write.mode("append").parquet(path)
        s = stream(spark, path)
        s = stateful.rate_limit(s, "user", "ts", "id", 2, "9 hours") if rule == "rate_limit" else stateful.cool_down(s, "user", "ts", "id", 1.0, "9 hours")
        out = scratch_dir(spark)
        sources.run_available(s, path=out)
        answers.append(sorted(tuple(r) for r in read(spark, s, out).collect()))
    assert answers[0] == answers[1] == answers[2] and answers[0]


class FakeState(dict):
    """Value and map states of one key, and its timers, in memory."""

    def getValueState(self, name, schema):
        return self.setdefault(name, FakeValue())

    def getMapState(self, name, key, value):
        return self.setdefault(name, FakeMap())

    def registerTimer(self, ms):
        self.setdefault("timers", set()).add(ms)

    def deleteTimer(self, ms):
        self["timers"].remove(ms)


class FakeValue:
    held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, v):
        self.held = v

    def clear(self):
        self.held = None


class FakeMap(dict):
    getValue, updateValue, removeKey, containsKey, iterator = dict.get, dict.__setitem__, dict.pop, dict.__contains__, dict.items

    def iterator(self):
        return iter(list(self.items()))


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms

    getExpiryTimeInMs = getCurrentWatermarkInMs


@pytest.mark.parametrize("seed", range(6))
def test_a_hot_key_holds_one_slice(seed):
    """All of a key's rows in the first batch, in any order: no more than a slice and a batch in memory."""
    import pandas as pd

    rnd = random.Random(seed)
    minute = 60_000_000
    rows = sorted((rnd.randrange(0, 600) * minute // 2, i, 0.0) for i in range(2000))
    judge = stateful.limit_judge(3)
    want, memory = [], []
    for us, i, v in rows:
        row, memory, _ = judge("k", us, i, v, memory, 0.0)
        want.append(row)
    p = stateful.InOrder(["key", "row_id", "us", "ok"], judge, lambda m: m[-1] + stateful.HOUR_US, None, inline=20, slice_us=5 * minute)
    state = FakeState()
    p.init(state)
    late = rnd.sample(rows, 300)
    first = [r for r in rows if r not in set(late)] if seed % 2 else rows
    batches = [first[k : k + 50] for k in range(0, len(first), 50)]
    rnd.shuffle(batches)
    frames = [pd.DataFrame(b, columns=["us", "row_id", "v"]) for b in batches]
    list(p.handleInputRows(("k",), iter(frames), Clock(0)))
    if seed % 2:
        list(p.handleInputRows(("k",), iter([pd.DataFrame(sorted(late, key=lambda r: r[1]), columns=["us", "row_id", "v"])]), Clock(0)))
    got, clock = [], 0
    while state["timers"]:
        clock = max(clock + rnd.randrange(1, 2_000_000), min(state["timers"]))
        for t in sorted(t for t in state["timers"] if t <= clock):
            if t in state["timers"]:
                state["timers"].remove(t)
                timer = Clock(clock)
                timer.getExpiryTimeInMs = lambda t=t: t
                for f in p.handleExpiredTimer(("k",), timer, timer):
                    got += [tuple(r) for r in f.itertuples(index=False)]
    assert got == want
    slices = [sum(r[0] // (5 * minute) == k for r in rows) for k in range(60)]
    assert p.most <= max(max(slices), 20 + 50 if not seed % 2 else 20 + 300) and p.most < 400
    assert not state["slices"] and not state["chunks"] and not state["memory"].exists() and not state["wait"].exists()


def test_sliced_state_gives_the_same_stream(spark, commands):
    path, rows = commands
    answers = []
    for options in ({}, {"inline": 5, "slice_us": 60_000_000}):
        out = scratch_dir(spark)
        s = stateful.rate_limit(stream(spark, path), "user", "ts", "id", per_hour=10, **options)
        sources.run_available(s, path=out)
        answers.append(sorted(tuple(r) for r in read(spark, s, out).collect()))
    assert answers[0] == answers[1] and answers[0]


@pytest.mark.parametrize("silence", [None, 1.5])
def test_runs_of_a_table_equal_a_loop(spark, silence):
    rnd = random.Random(3)
    rows = [(i, rnd.choice("ab"), T0 + timedelta(minutes=rnd.choice([1, 40]) * i), rnd.choice([None, 5.0, 12.0, 13.0, 14.0, 12.0])) for i in range(400)]
    df = spark.createDataFrame(rows, "id bigint, source string, timestamp timestamp_ntz, v0 double").repartition(4)
    want = []
    for key in "ab":
        run, before = [], None
        for r in [*sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0])), None]:
            high = r is not None and (r[3] or 0) >= 10
            gap = r is not None and silence is not None and before is not None and (r[2] - before).total_seconds() > silence * 3600
            if run and (not high or gap):
                want.append((key, len(run), run[0][2], run[-1][2], max(x[3] for x in run), r is None)) if len(run) >= 3 else None
                run = []
            if high:
                run.append(r)
            before = r[2] if r else None
    us = lambda t: round((t - datetime(1970, 1, 1)).total_seconds() * 1e6)
    got = stateful.sustained_runs_of(df, "source", "timestamp", "id", "v0", 10.0, 3, silence).collect()
    assert sorted(map(tuple, got)) == sorted((k, n, us(a), us(b), p, o) for k, n, a, b, p, o in want)


def test_silent_keys_leave_no_state_and_close_their_run(spark, tmp_path):
    rows = [(i, "a", T0 + timedelta(minutes=i), 12.0) for i in range(5)] + [(99, "b", T0 + timedelta(hours=9), 1.0)]
    spark.createDataFrame(rows[:5], "id bigint, source string, timestamp timestamp_ntz, v0 double").coalesce(1).write.mode("append").parquet(str(tmp_path))
    spark.createDataFrame(rows[5:], "id bigint, source string, timestamp timestamp_ntz, v0 double").coalesce(1).write.mode("append").parquet(str(tmp_path))
    out = scratch_dir(spark)
    s = stateful.sustained_runs(stream(spark, str(tmp_path)), "source", "timestamp", "id", "v0", 10.0, 3, silence_hours=2.0)
    sources.run_available(s, path=out)
    assert [(r.key, r.n) for r in read(spark, s, out).collect()] == [("a", 5)]


def test_cool_down_equals_loop(spark, commands):
    path, rows = commands
    out = scratch_dir(spark)
    s = stateful.cool_down(stream(spark, path), "user", "ts", "id", hours=1.5)
    sources.run_available(s, path=out)
    got = {r.row_id: r.fired for r in read(spark, s, out).collect()}
    last, want = {}, {}
    for i, u, t in rows:
        want[i] = u not in last or (t - last[u]).total_seconds() >= 5400
        if want[i]:
            last[u] = t
    passed = {i for i, _, t in rows if t < rows[-1][2].replace(microsecond=0) - timedelta(hours=1)}
    assert got == {i: ok for i, ok in want.items() if i in passed}


def test_unbroken_runs_equal_loop(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(i, "s", T0 + timedelta(minutes=i), rnd.choice([5.0, 12.0, 13.0, 14.0])) for i in range(200)]
    for k in range(4):
        spark.createDataFrame(rows[k * 50 : (k + 1) * 50], "id bigint, source string, timestamp timestamp_ntz, v0 double").coalesce(1).write.mode("append").parquet(str(tmp_path))
    out = scratch_dir(spark)
    s = stateful.sustained_runs(stream(spark, str(tmp_path)), "source", "timestamp", "id", "v0", 10.0, 3)
    sources.run_available(s, path=out)
    want, run = [], []
    for r in rows:
        if r[2] >= rows[-1][2] - timedelta(hours=1):
            break
        if r[3] >= 10:
            run.append(r)
            continue
        if len(run) >= 3:
            want.append((len(run), max(x[3] for x in run)))
        run = []
    assert sorted((r.n, r.peak) for r in read(spark, s, out).collect()) == sorted(want) and want


def test_stream_stream_pairs_equal_batch(spark, slices, tmp_path):
    path, rows = slices
    preds = [(i, T0 + timedelta(minutes=45 * i)) for i in range(20)]
    for k in range(4):
        spark.createDataFrame(preds[k * 5 : (k + 1) * 5], "id bigint, valid_time timestamp_ntz").coalesce(1).write.mode("append").parquet(str(tmp_path))
    out = scratch_dir(spark)
    sources.run_available(keyed.nearest_pairs(stream(spark, str(tmp_path)), stream(spark, path), "1 day"), sink=keyed.nearest_sink(out))
    got = {r.valid_time: r.id for r in keyed.nearest_of(spark, out).collect()}
    want = {}
    for _, v in preds:
        near = [(abs((r[2] - v).total_seconds()), -r[2].timestamp(), r[1], -r[0]) for r in rows if abs((r[2] - v).total_seconds()) <= 3600]
        if near:
            want[v] = -min(near)[3]
    assert got == want


def test_a_busy_hour_leaves_two_rows_per_minute(spark, tmp_path):
    """20,000 readings of one hour, some at equal times: at most 120 go on, the first and the last of each minute."""
    rnd = random.Random(6)
    rows = [(i, rnd.choice(["a", "b"]), T0 + timedelta(milliseconds=rnd.randrange(36_000) * 100), float(i)) for i in range(20_000)]
    spark.createDataFrame(rows, "id bigint, source string, timestamp timestamp_ntz, wind_speed_kn double").coalesce(1).write.parquet(str(tmp_path / "o"))
    out = scratch_dir(spark)
    edges = keyed.minute_edges(stream(spark, str(tmp_path / "o")), "2 hours")
    sources.run_available(edges, path=out)
    got = {(r.id, r.source, r.obs_speed) for r in read(spark, edges, out).collect()}
    want = set()
    for m in range(60):
        mine = [r for r in rows if (r[2] - T0) // timedelta(minutes=1) == m]
        want.add(min(mine, key=lambda r: (r[2], r[1], -r[0])))
        want.add(min(mine, key=lambda r: (T0 - r[2], r[1], -r[0])))
    assert got == {(r[0], r[1], r[3]) for r in want} and len(got) <= 120
