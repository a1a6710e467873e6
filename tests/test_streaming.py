import random
from datetime import datetime, timedelta

import pandas as pd
import pytest

from webstrata.operators import services as O
from webstrata.streaming import services as S
from webstrata.streaming import timers as T


def test_watch_stream(spark, tmp_path):
    t = lambda n: datetime(2024, 1, 1, 0, n)
    schema = "watch_id string, ts timestamp, text string"
    for i, part in enumerate([[("w", t(1), "価格 1,000円"), ("v", t(1), None)], [("w", t(2), "価格  1,000円")], [("w", t(3), "価格 900円"), ("v", t(3), "x")]]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    q = S.watch_notifications(stream).writeStream.format("memory").queryName("watch_out").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.watch_id, r.before, r.now) for r in spark.table("watch_out").collect()) == [("v", "", "x"), ("w", "価格 1,000円", "価格 900円")]


def test_miss_stream(spark, tmp_path):
    t = lambda n: datetime(2024, 1, 1, 0, n)
    for i in range(2):
        spark.createDataFrame([("/a", t(i)), ("/b", t(i + 5))], "url string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("url string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = S.miss_counts(stream).writeStream.outputMode("update").foreachBatch(S.merge_into(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.url, r.n) for r in S.read_merged(spark, str(tmp_path / "out")).collect()) == [("/a", 2), ("/b", 2)]


def day(minutes):
    return datetime(2024, 1, 1) + timedelta(minutes=minutes)


def in_batches(spark, tmp_path, rows, schema, make, cuts):
    """Rows of a stream that is stopped after each part of its input and goes on from its checkpoint."""
    source = str(tmp_path / f"in{len(cuts)}")
    folder = f"file://{tmp_path}/out{len(cuts)}"
    out, parts = None, spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")  # fewer state stores to open for each batch
    for lo, hi in zip([0, *cuts], [*cuts, len(rows)], strict=True):
        spark.createDataFrame(rows[lo:hi], schema).coalesce(1).write.mode("append").parquet(source)
        out = T.run_to_end(make(spark.readStream.schema(schema).parquet(source)), folder)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    return sorted(out.collect(), key=str)


# the last row only moves the watermark past all others
WATCH = [("w", 0, "a"), ("v", 0, None), ("w", 3, "a  "), ("w", 30, "b"), ("v", 31, "x"), ("w", 33, "c"), (None, 34, "lost"), ("w", 36, None), ("z", 500, "end")]


@pytest.mark.parametrize("cuts", [[2, 4]])
def test_watch_with_timers_goes_on_from_its_checkpoint(spark, tmp_path, cuts):
    rows = [(w, day(m), t, 5) for w, m, t in WATCH]
    got = in_batches(spark, tmp_path, rows, "watch_id string, ts timestamp, text string, minutes int", T.watch_stream, cuts)
    plain = [(r.watch_id, r.kind, int((r.ts - day(0)).total_seconds() // 60), r.before, r.now, list(r.history)) for r in got]
    assert sorted(plain, key=str) == sorted([
        ("w", "due", 8, None, None, ["a"]), ("w", "changed", 30, "a", "b", ["b", "a"]), ("w", "changed", 33, "b", "c", ["c", "b", "a"]), ("w", "changed", 36, "c", "", ["", "c", "b", "a"]),
        ("w", "due", 41, None, None, ["", "c", "b", "a"]), ("v", "due", 5, None, None, [""]), ("v", "changed", 31, "", "x", ["x", ""]), ("v", "due", 36, None, None, ["x", ""]),
    ], key=str)


def test_watch_keeps_the_last_of_a_long_history(spark, tmp_path):
    rows = [("w", day(m), f"t{m}", 10_000) for m in range(50)]
    got = in_batches(spark, tmp_path, rows, "watch_id string, ts timestamp, text string, minutes int", T.watch_stream, [])
    last = max(got, key=lambda r: r.ts)
    assert len(got) == 49 and list(last.history) == [f"t{m}" for m in range(49, 29, -1)]


@pytest.mark.parametrize("cuts", [[4]])
def test_stall_is_warned_of_once(spark, tmp_path, cuts):
    rows = [("a", day(0)), ("a", day(2)), ("b", day(2)), ("a", day(6)), ("a", day(20)), ("c", day(60))]
    got = in_batches(spark, tmp_path, rows, "job_id string, ts timestamp", lambda s: T.stalled_stream(s, 180, "1 minute"), cuts)
    assert [(r.job_id, r.ts) for r in got] == [("a", day(2)), ("b", day(2))]


@pytest.mark.parametrize("cuts", [[2]])
def test_schedule_waits_while_its_site_is_busy(spark, tmp_path, cuts):
    rows = [("s", day(0), "plan", 60), ("s", day(50), "busy", None), ("s", day(85), "free", None), ("s", day(160), "stop", None), ("t", day(170), "plan", 30), ("u", day(400), "free", None)]
    got = in_batches(spark, tmp_path, rows, "schedule_id string, ts timestamp, event string, minutes int", T.schedule_stream, cuts)
    s = sorted((r.ts, r.action) for r in got if r.schedule_id == "s")
    assert s == [(day(60), "waiting"), (day(70), "waiting"), (day(80), "waiting"), (day(90), "start"), (day(150), "start")]
    assert sorted(r.ts for r in got if r.schedule_id == "t") == [day(m) for m in range(200, 391, 30)]


@pytest.mark.parametrize("cuts", [[150]])
def test_spaced_times_do_not_depend_on_their_order(spark, tmp_path, cuts):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), day(rng.randrange(3000))) for _ in range(300)]
    rows.sort(key=lambda r: r[1] + timedelta(minutes=rng.randrange(25)))  # out of order by less than the watermark allows
    rows += [("z", day(5000))]
    schema = "kind string, ts timestamp"
    got = in_batches(spark, tmp_path, rows, schema, lambda s: T.spaced_stream(s, 3600, 12, "30 minutes"), cuts)
    want = O.spaced(spark.createDataFrame(rows, schema).fillna("", ["kind"]).filter("kind <> 'z'"), 3_600_000_000, 12)
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.collect()))


class Kept:
    """State of one grouping key in a dictionary; counts the timers that are set."""

    def __init__(self):
        self.values, self.timers, self.set = {}, set(), 0

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def getMapState(self, name, key, schema):  # noqa: N802
        return KeptMap()

    def getListState(self, name, schema):  # noqa: N802
        return self

    def exists(self):
        return "v" in self.values

    def get(self):
        return self.values.get("v")

    def update(self, v):
        self.values["v"] = v

    put = update

    def clear(self):
        self.values.clear()

    def registerTimer(self, ms):  # noqa: N802
        self.timers.add(ms)
        self.set += 1

    def deleteTimer(self, ms):  # noqa: N802
        self.timers.discard(ms)


class KeptMap(dict):
    def exists(self):
        return bool(self)

    def getValue(self, key):  # noqa: N802
        return self.get(key)

    def updateValue(self, key, value):  # noqa: N802
        self[key] = value

    def iterator(self):
        return iter(list(self.items()))


class At:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.ms

    def getCurrentProcessingTimeInMs(self):  # noqa: N802
        return self.ms


def test_watches_of_a_group_share_frames_and_timer():
    handle, watch = Kept(), T._Watch(False)
    watch.init(handle)
    rows = [(f"w{i}", us, text, 1 + i % 2) for i in range(200) for us, text in ((5_000_000, "b"), (1_000_000, "a"))]
    frames = list(watch.handleInputRows((0,), iter([pd.DataFrame(rows[:77], columns=["watch_id", "us", "text", "minutes"]), pd.DataFrame(rows[77:], columns=["watch_id", "us", "text", "minutes"])]), At(0)))
    assert len(frames) == 1 and handle.set == 1 and handle.timers == {65_000}
    got = list(zip(frames[0]["watch_id"], frames[0]["before"], frames[0]["now"], frames[0]["history"].map(tuple), strict=True))
    assert sorted(got) == sorted((f"w{i}", "a", "b", ("b", "a")) for i in range(200))
    for ms, due, timers in ((65_000, range(0, 200, 2), {125_000}), (125_000, range(1, 200, 2), set())):
        handle.timers.clear()  # as Spark does for a timer that has rung
        (frame,) = watch.handleExpiredTimer((0,), At(ms), None)
        assert sorted(frame["watch_id"]) == sorted(f"w{i}" for i in due) and set(frame["us"]) == {ms * 1000} and handle.timers == timers


def test_watches_of_a_group_are_kept_apart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "GROUPS", 2)
    rng = random.Random(5)
    seen = [(f"w{rng.randrange(12)}", minute, rng.choice("abc")) for minute in range(0, 240, 2)] + [("end", 280, "e")]
    rows = [(w, day(m), t, 15 + int(w[1:], 36) % 3) for w, m, t in seen]
    got = in_batches(spark, tmp_path, rows, "watch_id string, ts timestamp, text string, minutes int", T.watch_stream, [50])
    want = []
    for w in {r[0] for r in rows}:
        own, kept = [r for r in rows if r[0] == w], []
        for (_, ts, text, minutes), after in zip(own, [*[r[1] for r in own[1:]], day(270)], strict=True):
            if kept[:1] != [text]:
                kept = [text, *kept][:20]
                if len(kept) > 1:
                    want.append((w, "changed", kept[1], text, kept, ts))
            if ts + timedelta(minutes=minutes) < after:
                want.append((w, "due", None, None, kept, ts + timedelta(minutes=minutes)))
    assert len(want) > 100 and sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


@pytest.mark.parametrize("cut", [3])
def test_schedules_and_silent_jobs_of_a_group_are_kept_apart(spark, tmp_path, monkeypatch, cut):
    monkeypatch.setattr(T, "GROUPS", 1)
    rows = [("s", day(0), "plan", 60), ("t", day(10), "plan", 45), ("s", day(50), "busy", None), ("s", day(85), "free", None), ("t", day(110), "stop", None), ("u", day(200), "free", None)]
    got = in_batches(spark, tmp_path / "a", rows, "schedule_id string, ts timestamp, event string, minutes int", T.schedule_stream, [cut])
    assert sorted((r.schedule_id, r.ts, r.action) for r in got) == [("s", day(60), "waiting"), ("s", day(70), "waiting"), ("s", day(80), "waiting"), ("s", day(90), "start"), ("s", day(150), "start"), ("t", day(55), "start"), ("t", day(100), "start")]
    rows = [("a", day(0)), ("b", day(1)), ("b", day(3)), ("a", day(6)), ("c", day(7)), ("b", day(8)), ("d", day(60))]
    got = in_batches(spark, tmp_path / "b", rows, "job_id string, ts timestamp", lambda s: T.stalled_stream(s, 180, "1 minute"), [cut])
    assert sorted((r.job_id, r.ts) for r in got) == [("a", day(0)), ("b", day(3)), ("c", day(7))]
