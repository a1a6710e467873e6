"""Stateful services with timers: watches, schedules, silent jobs and events that are accepted at a distance.

Each is a StatefulProcessor over a keyed stream. Rows of a key are taken in the order of their time; what falls due between two rows is given before the later one, what
falls due behind the last by a timer once the watermark (or the clock) has passed. So the result doesn't depend on how the stream is cut into batches, but for rows later than
the watermark, which are dropped. State of a key: a few numbers, at most HISTORY entries of a watch, and of accepted times those the watermark hasn't passed.
Frames made for a key cost far more than its rows do, so keys are dealt to GROUPS groups, and frames and timers are those of a group; each key has its own entry in the group's map.
GROUPS is part of a checkpoint and can't change while one is in use; new rows of a group are in memory together, so more keys than tens of millions want more groups.
Streams need the RocksDB state store: ``run_to_end`` sets it for a query that reads what is there.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .services import excerpt

HISTORY, BUSY_MINUTES, SILENT_SECONDS, GROUPS, FRAME_ROWS = 20, 10, 180, 1024, 10_000
MINUTE = 60_000_000
STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _in_order(batches: Iterator[pd.DataFrame], key: str, *columns: str) -> list[tuple]:
    """(key, us, *columns), the rows of each key together and by their time."""
    rows = pd.concat(list(batches))
    rows = rows.sort_values([key, "us", *columns], kind="stable", na_position="first")
    return list(zip(rows[key].tolist(), rows["us"].astype("int64").tolist(), *[rows[c].tolist() for c in columns], strict=True))


def _ms(us: int) -> int:
    return -(-us // 1000)


class _Timed(StatefulProcessor):
    """One timer for each grouping key. Times are microseconds; a key's timer is moved, not added to."""

    columns: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.timer = handle.getValueState("timer", "ms long")

    def set_timer(self, us: int | None) -> None:
        old = self.timer.get()[0] if self.timer.exists() else None
        ms = None if us is None else _ms(us)
        if ms == old:
            return
        if old is not None:
            self.handle.deleteTimer(old)
        if ms is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(ms)
            self.timer.update((ms,))

    def rang(self) -> None:
        self.timer.clear()

    def frame(self, out: list[tuple]) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


class _Grouped(_Timed):
    """The keys of a group: a map of their states, (due, *state), and one timer, not behind the earliest due time.

    ``see`` takes a key's state (or None) and its new rows in order, ``fall_due`` a state whose time has passed; both append rows to ``out`` and return the new state.
    """

    taken: list[str]
    state: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.keys = handle.getMapState("keys", "key string", f"due long, {self.state}")

    def see(self, key: str, state: tuple | None, rows: Iterable[tuple], now_us: int, out: list) -> tuple:
        raise NotImplementedError

    def fall_due(self, key: str, state: tuple, until: int, out: list) -> tuple:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        known, now_us = self.keys.exists(), timerValues.getCurrentProcessingTimeInMs() * 1000
        out: list = []
        dues = [self.timer.get()[0] * 1000] if self.timer.exists() else []
        for k, seen in groupby(_in_order(rows, self.columns[0], *self.taken), itemgetter(0)):
            old = self.keys.getValue((k,)) if known else None
            state = self.see(k, old and tuple(old), (row[1:] for row in seen), now_us, out)
            self.keys.updateValue((k,), state)
            dues.append(state[0])
            if len(out) >= FRAME_ROWS:
                yield from self.frame(out)
                out = []
        self.set_timer(min((d for d in dues if d is not None), default=None))
        yield from self.frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        self.rang()
        passed, out, dues = self.passed_ms(timerValues), [], []
        for (k,), state in list(self.keys.iterator()):
            if state[0] is not None and _ms(state[0]) <= passed:
                state = self.fall_due(k, tuple(state), passed * 1000, out)
                self.keys.updateValue((k,), state)
            dues.append(state[0])
        self.set_timer(min((d for d in dues if d is not None), default=None))
        yield from self.frame(out)

    def passed_ms(self, timerValues) -> int:  # noqa: N803
        return timerValues.getCurrentWatermarkInMs()


class _Watch(_Grouped):
    columns = ["watch_id", "kind", "us", "before", "now", "history"]
    taken = ["text", "minutes"]
    state = "hash string, shown string, history array<string>"

    def __init__(self, processing: bool):
        self.processing = processing

    def passed_ms(self, timerValues) -> int:  # noqa: N803
        return timerValues.getCurrentProcessingTimeInMs() if self.processing else super().passed_ms(timerValues)

    def see(self, key, state, rows, now_us, out):
        due, digest, shown, kept = state or (None, None, None, [])
        for us, text, minutes in rows:
            if due is not None and not self.processing and us > due:
                out.append((key, "due", due, None, None, kept))
            new, words = excerpt(text)
            if new != digest:
                kept = [words, *kept][:HISTORY]
                if digest is not None:
                    out.append((key, "changed", us, shown, words, kept))
                digest, shown = new, words
            due = (now_us if self.processing else us) + int(minutes) * MINUTE
        return due, digest, shown, kept

    def fall_due(self, key, state, until, out):
        due, digest, shown, kept = state
        out.append((key, "due", due, None, None, kept))
        return None, digest, shown, kept


class _Silence(_Grouped):
    columns = ["job_id", "us"]
    taken: list[str] = []
    state = "last long, warned boolean"

    def __init__(self, seconds: float):
        self.gap = int(seconds * 1e6)

    def see(self, key, state, rows, now_us, out):
        _, last, warned = state or (None, None, False)
        for (us,) in rows:
            if not warned and last is not None and us - last >= self.gap:
                out.append((key, last))
                warned = True
            last = us if last is None else max(last, us)
        return None if warned else last + self.gap, last, warned

    def fall_due(self, key, state, until, out):
        out.append((key, state[1]))
        return None, state[1], True


class _Schedule(_Grouped):
    columns = ["schedule_id", "us", "action"]
    taken = ["event", "minutes"]
    state = "every long, busy boolean"

    def see(self, key, state, rows, now_us, out):
        state = state or (None, None, False)
        for us, event, minutes in rows:
            next_us, every, busy = self.fall_due(key, state, us, out)
            if event == "plan":
                every = max(1, int(minutes)) * MINUTE
                next_us = us + every
            elif event == "stop":
                next_us = None
            elif event in ("busy", "free"):
                busy = event == "busy"
            state = next_us, every, busy
        return state

    def fall_due(self, key, state, until, out):
        next_us, every, busy = state
        while next_us is not None and next_us <= until:
            out.append((key, next_us, "waiting" if busy else "start"))
            next_us += BUSY_MINUTES * MINUTE if busy else every
        return next_us, every, busy


class _Spaced(_Timed):
    columns = ["kind", "n", "us"]

    def __init__(self, gap_us: int, most: int | None):
        self.gap, self.most = gap_us, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "us long, n int")
        self.waiting = handle.getListState("waiting", "us long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        new = {int(us) for frame in rows for us in frame["us"].unique()}
        last, n = self.last.get() if self.last.exists() else (None, 0)
        if last is not None:  # rows too close to the last accepted one never count
            new = {us for us in new if us >= last + self.gap} if self.most is None or n < self.most else set()
        old = {w[0] for w in self.waiting.get()}
        if new - old:
            self.waiting.appendList([(us,) for us in sorted(new - old)])
            self.set_timer(min(new | old))
        yield from self.frame([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        self.rang()
        passed, out = timerValues.getCurrentWatermarkInMs() * 1000, []
        last, n = self.last.get() if self.last.exists() else (None, 0)
        rest = []
        for us in sorted(w[0] for w in self.waiting.get()):
            if us > passed:
                rest.append(us)
            elif (last is None or us >= last + self.gap) and (self.most is None or n < self.most):
                out.append((key[0], n, us))
                last, n = us, n + 1
        if self.most is not None and n >= self.most:
            rest = []
        if last is not None:
            self.last.update((last, n))
        if rest:
            self.waiting.put([(us,) for us in rest])
            self.set_timer(rest[0])
        else:
            self.waiting.clear()
        yield from self.frame(out)


def _keyed(rows: DataFrame, key: str, late: str, processor: StatefulProcessor, schema: str, time_mode: str = "EventTime") -> DataFrame:
    timed = rows.withWatermark("ts", late) if time_mode == "EventTime" else rows
    timed = timed.filter(F.col(key).isNotNull() & F.col("ts").isNotNull()).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    if isinstance(processor, _Grouped):
        timed = timed.withColumn("group", F.pmod(F.xxhash64(key), F.lit(GROUPS)).cast("int"))
    out = timed.groupBy("group" if isinstance(processor, _Grouped) else key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode=time_mode)
    return out.withColumn("ts", F.timestamp_micros("us")).drop("us")


def watch_stream(observations: DataFrame, late: str = "10 minutes", time_mode: str = "EventTime") -> DataFrame:
    """(watch_id, kind, ts, before, now, history): a change of the watched text, or that the next check is due.

    observations(watch_id, ts, text, minutes) is a stream; the first text of a watch is its baseline, and ``minutes`` after an observation without another the next is due, once. history: excerpts of
    the baseline and all changes, newest first, the last HISTORY. With time_mode ProcessingTime checks fall due by the clock. Null texts are empty; rows without id or time are left out.
    """
    return _keyed(observations.select(F.col("watch_id").cast("string").alias("watch_id"), "ts", "text", "minutes"), "watch_id", late, _Watch(time_mode == "ProcessingTime"), "watch_id string, kind string, us long, before string, now string, history array<string>", time_mode)


def stalled_stream(updates: DataFrame, seconds: float = SILENT_SECONDS, late: str = "10 minutes") -> DataFrame:
    """(job_id, ts): the last update (job_id, ts) before a job was silent for ``seconds``, the first time only."""
    return _keyed(updates.select(F.col("job_id").cast("string").alias("job_id"), "ts"), "job_id", late, _Silence(seconds), "job_id string, us long")


def schedule_stream(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(schedule_id, ts, action): each time a schedule falls due: start, or waiting where its site is busy, which puts it off by BUSY_MINUTES.

    events(schedule_id, ts, event, minutes): plan (runs every ``minutes`` from then on), stop, busy, free. Of events at the time of a run the run comes first.
    """
    return _keyed(events.select(F.col("schedule_id").cast("string").alias("schedule_id"), "ts", "event", "minutes"), "schedule_id", late, _Schedule(), "schedule_id string, us long, action string")


def spaced_stream(times: DataFrame, gap_seconds: float, most: int | None = None, late: str = "10 minutes") -> DataFrame:
    """(kind, n, ts): ``services.spaced`` over a stream: of the times of each kind the first, then each one at least the gap behind the last accepted.

    A time is decided on when the watermark has passed it, so the order of arrival doesn't matter.
    """
    return _keyed(times.select(F.coalesce(F.col("kind").cast("string"), F.lit("")).alias("kind"), "ts"), "kind", late, _Spaced(int(gap_seconds * 1e6), most), "kind string, n int, us long")


def run_to_end(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream over what is there, to Parquet in ``folder``, and read its rows. The same folder again goes on from its checkpoint."""
    spark = stream.sparkSession
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        q = stream.writeStream.format("parquet").trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/rows").start()
        q.awaitTermination()
    finally:
        spark.conf.set(STORE, before)
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
