"""Rules that need memory per key: rate limit, cool-down, unbroken windy runs.

Rows wait in the key's state until the watermark has passed them and are then judged in the
order of their event times, ties by id. So the answer does not depend on how the stream is cut
into micro-batches or on the order of arrival, as long as rows arrive within ``delay``; rows
later than that are dropped, and the last ``delay`` of a stream waits for more to come (the
batch twins ``rate_limit_of``, ``cool_down_of`` and ``sustained_runs_of`` answer for all rows).

A key's few waiting rows are one state value. From ``INLINE`` rows on they go to map state, in
chunks by small slices of event time (``SLICE_US``), as they arrive; when the watermark passes,
one slice after the other is read, judged and dropped. So a key with a third of all rows, or one
whose whole history arrives in the first micro-batch, holds one slice and one chunk of input in
memory; the rest is in the state store. One timer per key is set to its oldest waiting row.
State is removed when nothing waits and what it remembers cannot matter to any later row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sparkmos import settings as cfg

HOUR_US = 3_600_000_000
#: Waiting rows that a key keeps in one value; more are kept by slices of time of this length.
INLINE, SLICE_US = 1_000, 300_000_000
ROWS = "us array<bigint>, ids array<bigint>, v array<double>"

# Judges rows in time order: (key, us, id, value, memory, peak) -> (row or None, memory, peak).
Judge = Callable[[object, int, int, float, list[int], float], tuple[tuple | None, list[int], float]]


class InOrder(StatefulProcessor):
    """``judge`` over the rows of each key in event-time order."""

    def __init__(
        self, names: list[str], judge: Judge, keep_us: Callable[[list[int]], int | None],
        close: Callable[[object, list[int], float], tuple | None] | None, inline: int = INLINE, slice_us: int = SLICE_US,
    ):
        self.names, self.judge, self.keep_us, self.close_run = names, judge, keep_us, close
        self.inline, self.slice_us = inline, slice_us
        self.most = 0  # rows held at a time, for tests

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.wait = handle.getValueState("wait", ROWS)
        # What the rule remembers, the timer that is set, and how many slices there are.
        self.memory = handle.getValueState("memory", "m array<bigint>, peak double, due bigint, slices int")
        self.index = handle.getMapState("slices", "slice bigint", "first bigint, chunks int")
        self.chunks = handle.getMapState("chunks", "slice bigint, chunk int", ROWS)

    def close(self) -> None:
        pass

    def _remembered(self) -> tuple[list[int], float, int | None, int]:
        m = self.memory.get() if self.memory.exists() else None
        return (list(m[0]), float(m[1]), m[2], int(m[3])) if m else ([], 0.0, None, 0)

    def _waiting(self) -> list[tuple[int, int, float]]:
        return list(zip(*map(list, self.wait.get()))) if self.wait.exists() else []

    def _keep(self, rows: list[tuple[int, int, float]]) -> None:
        if rows:
            self.wait.update(tuple(list(c) for c in zip(*rows)))
        elif self.wait.exists():
            self.wait.clear()

    def _spill(self, rows: list[tuple[int, int, float]], slices: int) -> int:
        """Rows to their slices, one chunk each; the new number of slices."""
        parts: dict[int, list] = {}
        for r in rows:
            parts.setdefault(r[0] // self.slice_us, []).append(r)
        for at, mine in parts.items():
            old = self.index.getValue((at,)) if self.index.containsKey((at,)) else None
            first, n = (min(old[0], min(r[0] for r in mine)), old[1]) if old else (min(r[0] for r in mine), 0)
            self.chunks.updateValue((at, n), tuple(list(c) for c in zip(*mine)))
            self.index.updateValue((at,), (first, n + 1))
            slices += old is None
        return slices

    def _settle(self, memory: list[int], peak: float, old_due: int | None, due: int | None, slices: int) -> None:
        if due != old_due:
            if old_due is not None:
                self.handle.deleteTimer(old_due)
            if due is not None:
                self.handle.registerTimer(due)
        self.memory.update(([int(m) for m in memory], float(peak), due, slices))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        memory, peak, due, slices = self._remembered()
        waiting, first = self._waiting(), None
        for batch in rows:
            new = list(zip(batch["us"].tolist(), batch["row_id"].tolist(), batch["v"].tolist()))
            if new:
                oldest = min(r[0] for r in new)
                first = oldest if first is None else min(first, oldest)
            waiting += new
            self.most = max(self.most, len(waiting))
            if slices or len(waiting) > self.inline:
                slices = self._spill(waiting, slices)
                waiting = []
        self._keep(waiting)
        soon = due if first is None else max(first // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1)
        if due is not None:
            soon = min(due, soon)  # an early call does no harm
        self._settle(memory, peak, due, soon, slices)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        memory, peak, due, slices = self._remembered()
        if due is not None and due <= expiredTimerInfo.getExpiryTimeInMs():
            due = None  # it has just gone off
        waiting, oldest = self._waiting(), None
        if slices and waiting:
            slices = self._spill(waiting, slices)
            waiting = []
        if slices:
            left = []
            for at, (first, n) in sorted((k[0], v) for k, v in self.index.iterator()):
                if first >= passed:
                    left.append(first)
                    continue
                rows = [r for c in range(n) for r in zip(*map(list, self.chunks.getValue((at, c))))]
                self.most = max(self.most, len(rows))
                for c in range(n):
                    self.chunks.removeKey((at, c))
                found, rest, memory, peak = self._judged(key[0], rows, passed, memory, peak)
                if rest:
                    self.chunks.updateValue((at, 0), tuple(list(c) for c in zip(*rest)))
                    self.index.updateValue((at,), (rest[0][0], 1))
                    left.append(rest[0][0])
                else:
                    self.index.removeKey((at,))
                    slices -= 1
                if found:
                    yield pd.DataFrame(found, columns=self.names)
            oldest = min(left, default=None)
        else:
            found, waiting, memory, peak = self._judged(key[0], waiting, passed, memory, peak)
            oldest = waiting[0][0] if waiting else None
            if found:
                yield pd.DataFrame(found, columns=self.names)
        self._keep(waiting)
        until = self.keep_us(memory) if memory else 0
        if oldest is None and until is not None and until < passed:
            last = self.close_run(key[0], memory, peak) if self.close_run and memory else None
            if last is not None:
                yield pd.DataFrame([last], columns=self.names)
            if due is not None:
                self.handle.deleteTimer(due)
            self.memory.clear()
        else:
            at = oldest if oldest is not None else until
            soon = None if at is None else max(at // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1)
            self._settle(memory, peak, due, soon, slices)

    def _judged(self, key, rows: list, passed: int, memory: list[int], peak: float) -> tuple[list, list, list[int], float]:
        """(answers, rows that still wait, memory, peak); the rows are of one slice."""
        rows = sorted(rows)
        found, k = [], 0
        while k < len(rows) and rows[k][0] < passed:
            row, memory, peak = self.judge(key, *rows[k], memory, peak)
            if row is not None:
                found.append(row)
            k += 1
        return found, rows[k:], memory, peak


def _in_time_order(
    df: DataFrame, key: str, time: str, row_id: str, delay: str, out: str, judge: Judge, keep_us: Callable[[list[int]], int | None],
    close: Callable[[object, list[int], float], tuple | None] | None = None, value: str | None = None, inline: int = INLINE, slice_us: int = SLICE_US,
) -> DataFrame:
    """``judge`` over the rows of each key in event-time order.

    ``keep_us`` says until which time a key's memory matters (None: for ever); when the
    watermark has passed that, ``close`` may give a last row and the state is removed.
    """
    names = [c.split()[0] for c in out.split(", ")]
    src = _rows(df, key, time, row_id, value).withColumn("event_time", F.col("at").cast("timestamp")).drop("at").withWatermark("event_time", delay)
    kind = dict(src.dtypes)["key"]
    processor = InOrder(names, judge, keep_us, close, inline, slice_us)
    return src.groupBy("key").transformWithStateInPandas(processor, out.replace("key key", f"key {kind}"), "Append", "EventTime")


def _rows(df: DataFrame, key: str, time: str, row_id: str, value: str | None) -> DataFrame:
    worth = F.col(value).cast("double") if value else F.lit(0.0)
    at = F.col(time).cast("timestamp")
    return df.select(F.col(key).alias("key"), F.col(row_id).cast("bigint").alias("row_id"), F.unix_micros(at).alias("us"), worth.alias("v"), at.alias("at"))


LIMITED = "key key, row_id bigint, us bigint, accepted boolean"
COOLED = "key key, row_id bigint, us bigint, fired boolean"


def limit_judge(per_hour: int) -> Judge:
    def judge(k, us, row_id_, v, recent, peak):
        recent = [t for t in recent if us - t < HOUR_US]
        ok = len(recent) < per_hour
        return (k, row_id_, us, ok), [*recent, us] if ok else recent, peak

    return judge


def cool_judge(gap: int) -> Judge:
    def judge(k, us, row_id_, v, last, peak):
        ok = not last or us - last[0] >= gap
        return (k, row_id_, us, ok), [us] if ok else last, peak

    return judge


def rate_limit(events: DataFrame, key: str, time: str, row_id: str, per_hour: int = cfg.COMMANDS_PER_HOUR, delay: str = "1 hour", **options: int) -> DataFrame:
    """Each event with ``accepted``: fewer than ``per_hour`` accepted ones in the hour before.

    Refused events do not count. Remembered are the times of the last hour's accepted events,
    at most ``per_hour`` of them.
    """

    return _in_time_order(events, key, time, row_id, delay, LIMITED, limit_judge(per_hour), lambda recent: recent[-1] + HOUR_US, **options)


def cool_down(events: DataFrame, key: str, time: str, row_id: str, hours: float = cfg.ALERT_COOLDOWN_HOURS, delay: str = "1 hour", **options: int) -> DataFrame:
    """Each event with ``fired``: at least ``hours`` since the last one of its key that fired."""
    gap = int(hours * HOUR_US)
    return _in_time_order(events, key, time, row_id, delay, COOLED, cool_judge(gap), lambda last: last[0] + gap, **options)


def sustained_runs(
    readings: DataFrame, key: str, time: str, row_id: str, value: str, threshold: float, min_rows: int, delay: str = "1 hour",
    silence_hours: float | None = None, **options: int,
) -> DataFrame:
    """Runs of at least ``min_rows`` consecutive readings at the threshold, when they end.

    A reading below the threshold ends a run, whatever the time between them. With
    ``silence_hours`` a run also ends when its key has been silent for so long; without it an
    open run, four numbers, waits for ever.
    """
    silence = None if silence_hours is None else int(silence_hours * HOUR_US)

    def ended(k, run, peak):
        return (k, run[0], run[1], run[2], peak) if run and run[0] >= min_rows else None

    def judge(k, us, row_id_, v, run, peak):
        last = None
        if silence is not None and run and us - run[2] > silence:
            last, run, peak = ended(k, run, peak), [], 0.0
        if v >= threshold:
            return last, [run[0] + 1, run[1], us] if run else [1, us, us], max(peak, v) if run else v
        return last or ended(k, run, peak), [], 0.0

    return _in_time_order(
        readings, key, time, row_id, delay, "key key, n bigint, start_us bigint, end_us bigint, peak double", judge,
        lambda run: None if silence is None else run[2] + silence, ended, value, **options,
    )


# The same rules over a stored table, to its last row.


def _of_table(df: DataFrame, key: str, time: str, row_id: str, out: str, judge: Judge) -> DataFrame:
    """``judge`` over each key's rows in time order: sorted by Spark, read in a stream, one key after the other."""
    names = [c.split()[0] for c in out.split(", ")]
    src = _rows(df, key, time, row_id, None).drop("at")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, memory, peak = None, [], 0.0
        for batch in batches:
            found = []
            for k, i, us, v in zip(batch["key"], batch["row_id"].tolist(), batch["us"].tolist(), batch["v"].tolist()):
                if k != at:
                    at, memory, peak = k, [], 0.0
                row, memory, peak = judge(k, us, i, v, memory, peak)
                if row is not None:
                    found.append(row)
            yield pd.DataFrame(found, columns=names)

    kind = dict(src.dtypes)["key"]
    return src.repartition("key").sortWithinPartitions("key", "us", "row_id").mapInPandas(run, out.replace("key key", f"key {kind}"))


def rate_limit_of(events: DataFrame, key: str, time: str, row_id: str, per_hour: int = cfg.COMMANDS_PER_HOUR) -> DataFrame:
    return _of_table(events, key, time, row_id, LIMITED, limit_judge(per_hour))


def cool_down_of(events: DataFrame, key: str, time: str, row_id: str, hours: float = cfg.ALERT_COOLDOWN_HOURS) -> DataFrame:
    return _of_table(events, key, time, row_id, COOLED, cool_judge(int(hours * HOUR_US)))


def sustained_runs_of(
    readings: DataFrame, key: str, time: str, row_id: str, value: str, threshold: float, min_rows: int, silence_hours: float | None = None
) -> DataFrame:
    """Runs of at least ``min_rows`` readings, the unfinished ones too, which are ``open``.

    Breaks are counted within a day and over the days of a key, so that a busy key is sorted a
    day at a time; a run is what lies between two breaks, added up with partial sums.
    """
    rows = _rows(readings, key, time, row_id, value).withColumn("day", F.floor(F.col("us") / (24 * HOUR_US)))
    low = F.coalesce(F.col("v") < threshold, F.lit(True))
    in_day = Window.partitionBy("key", "day").orderBy("us", "row_id")
    over_days = Window.partitionBy("key").orderBy("day")
    seen = rows.groupBy("key", "day").agg(F.max("us").alias("newest"), F.max_by(low, F.struct("us", "row_id")).alias("last_low"))
    # One row per key and day.
    ends = seen.select(
        "key", "day", F.lag("newest").over(over_days).alias("before"), F.max("newest").over(Window.partitionBy("key")).alias("key_newest"),
        F.max_by("last_low", "day").over(Window.partitionBy("key")).alias("key_low"),
    )
    broken = low
    if silence_hours is not None:
        previous = F.coalesce(F.lag("us").over(in_day), F.col("before"))
        broken = low | F.coalesce(F.col("us") - previous > int(silence_hours * HOUR_US), F.lit(False))
    marked = rows.join(ends, ["key", "day"]).withColumn("low", low).withColumn("broken", broken.cast("int"))
    per_day = marked.groupBy("key", "day").agg(F.sum("broken").alias("n"))
    before = per_day.select("key", "day", F.coalesce(F.sum("n").over(over_days.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    upto = in_day.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = marked.withColumn("upto", F.sum("broken").over(upto)).join(before, ["key", "day"]).withColumn("run", F.col("earlier") + F.col("upto"))
    runs = numbered.filter(~F.col("low")).groupBy("key", "run").agg(
        F.count("*").alias("n"), F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.max("v").alias("peak"),
        F.first("key_newest").alias("key_newest"), F.first("key_low").alias("key_low"),
    )
    is_open: Column = (F.col("end_us") == F.col("key_newest")) & ~F.col("key_low")
    return runs.filter(F.col("n") >= min_rows).select("key", "n", "start_us", "end_us", "peak", is_open.alias("open"))
