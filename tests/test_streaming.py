"""Streams against the batch operators on the same rows."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import Row

from logloom.operators.attribution import INACTIVITY, time_by_session, with_gaps
from logloom.streaming import live
from logloom.streaming.live import activity_windows

SCHEMA = """session_id string, line_no bigint, ts_us bigint, record_type string,
  has_tool_result boolean"""


def messages(n):
    rng, out, clock = random.Random(1), [], 0
    for line in range(n):
        clock += rng.choice([1, 30, 700, 1800, 1801, -5]) * 1_000_000
        kind = rng.choice(["user", "assistant"])
        out.append((f"s{rng.randint(0, 2)}", line, clock, kind, kind == "user" and rng.random() < 0.5))
    return out


class Feed:
    """A folder of messages and the stream of changes over it, stopped and started again for each run."""

    def __init__(self, spark, folder):
        self.spark, self.feed, self.out, self.state = spark, f"{folder}/feed", f"{folder}/out", f"{folder}/state"

    def run(self, rows):
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.feed)
        stream = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(self.feed)
        (live.live_time(stream).writeStream.format("parquet").option("path", self.out)
         .option("checkpointLocation", self.state).trigger(availableNow=True).start().awaitTermination())
        return self.spark.read.schema(live.CHANGES).parquet(self.out)


def test_live_totals_equal_the_batch_result(spark, tmp_path):
    rows, feed = messages(90), Feed(spark, tmp_path)
    feed.run(rows[:50])
    changes = feed.run(rows[50:])  # goes on from the checkpoint, nothing counts twice
    whole = spark.createDataFrame(rows, SCHEMA)
    got = {r.session_id: r.asDict() for r in live.live_totals(changes).collect()}
    for r in time_by_session(with_gaps(whole)).collect():
        for k, v in r.asDict().items():
            assert got[r.session_id][k] == v
    assert sum(r["messages"] for r in got.values()) == 90
    assert live.late_lines(changes).count() == 0

    far = [("other", 0, 10 ** 15, "user", False)]  # the clock moves on, all others are idle
    feed.run(far)
    changes = feed.run([("other", 1, 10 ** 15 + 1, "user", False)])
    idle = {r.session_id: r.idle for r in live.live_totals(changes).collect()}
    assert idle == {"s0": True, "s1": True, "s2": True, "other": False}
    want = {(r.session_id, r._start if r._start >= 0 else r.first): (r.start_us, r.end_us, r.messages) for r in
            _windows(spark, whole)}
    assert {(r.session_id, r.start_line): (r.start_us, r.end_us, r.messages)
            for r in live.live_windows(changes).filter("session_id <> 'other'").collect()} == want


def _windows(spark, whole):
    """Stretches of each session, line by line."""
    out = []
    for sid in ("s0", "s1", "s2"):
        open_, last = None, None
        for r in whole.filter(f"session_id = '{sid}'").orderBy("line_no").collect():
            if open_ is None or r.ts_us - last > INACTIVITY * 1_000_000:
                open_ = Row(session_id=sid, first=r.line_no, _start=r.line_no, times=[])
                out.append(open_)
            open_.times.append(r.ts_us)
            last = r.ts_us
    return [Row(session_id=w.session_id, first=w.first, _start=w._start, start_us=w.times[0], end_us=w.times[-1],
                messages=len(w.times)) for w in out]


@pytest.mark.parametrize("size", [1, 16])
def test_late_lines_are_kept_and_corrected(spark, tmp_path, size):
    rng = random.Random(size)
    rows = messages(120)
    late = [r for r in rows[20:100] if rng.random() < 0.15]
    feed = Feed(spark, tmp_path)
    feed.run([r for r in rows if r not in late])
    changes = feed.run(late)
    assert {(r.session_id, r.line_no) for r in live.late_lines(changes).collect()} == {r[:2] for r in late}
    whole = spark.createDataFrame(rows, SCHEMA)
    counts = {r.session_id: r["count"] for r in whole.groupBy("session_id").count().collect()}
    got = {r.session_id: r.asDict() for r in live.corrected_totals(changes, whole, size=size).collect()}
    for r in time_by_session(with_gaps(whole)).collect():
        assert got[r.session_id] == {**r.asDict(), "messages": counts[r.session_id]}


def test_state_needs_its_provider(spark):
    old = spark.conf.get(live.PROVIDER)
    spark.conf.unset(live.PROVIDER)
    try:
        if spark.conf.get(live.PROVIDER) != live.ROCKSDB:
            with pytest.raises(RuntimeError):
                live.live_time(spark.readStream.format("rate").load())
    finally:
        spark.conf.set(live.PROVIDER, old)


def test_windows_split_after_thirty_minutes_and_drop_late_rows(spark, tmp_path):
    t0 = datetime(2026, 1, 5, tzinfo=timezone.utc)
    folder = str(tmp_path / "w")

    def add(*seconds):
        rows = [("s", t0 + timedelta(seconds=x)) for x in seconds]
        spark.createDataFrame(rows, "session_id string, ts timestamp").coalesce(1).write.mode(
            "append").parquet(folder)

    def run():
        feed = spark.readStream.schema("session_id string, ts timestamp").parquet(folder)
        return (activity_windows(feed).writeStream.format("parquet").outputMode("append")
                .option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out"))
                .trigger(availableNow=True).start().awaitTermination())

    add(0, 1799, 5400)
    run()
    add(20)  # far behind the watermark by now
    run()
    add(90_000)
    run()
    got = sorted((r.start, r.messages) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert [n for _, n in got] == [2, 1]
