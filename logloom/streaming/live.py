"""Live forms: activity windows with a watermark, and running time attribution per session."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from logloom.functions.dates import SECOND
from logloom.operators.attribution import INACTIVITY, MODEL_TIMEOUT, time_by_session, with_gaps

# the processor runs in workers, which may not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

S = "session_id"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SUMS = ["messages", "model_us", "tool_us", "user_us", "inactive_us", "model_timeout_count"]
_STATE = ("line_no bigint, ts_us bigint, timer bigint, start_line bigint, start_us bigint, in_window bigint, "
          + ", ".join(f"{c} bigint" for c in SUMS))
_CHANGE = ["session_id", "kind", "line_no", "ts_us", "start_line", "start_us", "end_us", *SUMS]
CHANGES = "session_id string, kind string, " + ", ".join(f"{c} bigint" for c in _CHANGE[2:])


def activity_windows(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Active stretches of an event feed of (session_id, ts).

    A row later than the watermark is dropped unseen; `live_time` gives windows that lose no row.
    """
    return events.withWatermark("ts", late).groupBy(S, F.session_window("ts", gap).alias("w")).agg(
        F.count("*").alias("messages")).select(
        S, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "messages")


class _Session(StatefulProcessor):
    """The last line of a session, its open window and its sums; nothing else is kept."""

    def __init__(self, inactivity_us: int, timeout_us: int) -> None:
        self.inactivity_us, self.timeout_us = inactivity_us, timeout_us

    def init(self, handle) -> None:
        self.handle, self.state = handle, handle.getValueState("session", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        lines = pd.concat([r[~r["tick"]] for r in rows]).sort_values("line_no")
        if not len(lines):
            return
        s = dict(zip(["line_no", "ts_us", "timer", "start_line", "start_us", "in_window", *SUMS], self.state.get() or ())) or None
        out: list[dict] = []
        for line, at, kind, result in zip(lines["line_no"].tolist(), lines["ts_us"].tolist(),
                                          lines["record_type"].tolist(), lines["has_tool_result"].tolist()):
            if s is not None and line <= s["line_no"]:
                out.append({"kind": "late", "line_no": line, "ts_us": at})
                continue
            if s is None:
                s = {"timer": -1, "start_line": line, "start_us": at, "in_window": 0, **dict.fromkeys(SUMS, 0)}
                gap = None
            else:
                gap = at - s["ts_us"]
            if gap is not None and gap > self.inactivity_us:
                out.append(self._window(s))
                s.update(start_line=line, start_us=at, in_window=0)
                s["inactive_us"] += gap
            elif gap is not None and gap >= 0:
                if kind == "assistant":
                    s["model_us"] += gap
                    s["model_timeout_count"] += gap > self.timeout_us
                elif kind == "user":
                    s["tool_us" if result else "user_us"] += gap
            s.update(line_no=line, ts_us=at, messages=s["messages"] + 1, in_window=s["in_window"] + 1)
        if any(o["kind"] == "late" for o in out) and len(out) == len(lines):  # nothing new
            yield self._frame(key, out)
            return
        if s["timer"] >= 0:
            self.handle.deleteTimer(s["timer"])
        s["timer"] = max((s["ts_us"] + self.inactivity_us) // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1)
        self.handle.registerTimer(s["timer"])
        self.state.update(tuple(int(s[c]) for c in ["line_no", "ts_us", "timer", "start_line", "start_us", "in_window", *SUMS]))
        out.append({"kind": "totals", "line_no": s["line_no"], "ts_us": s["ts_us"], **{c: s[c] for c in SUMS}})
        yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s = dict(zip(["line_no", "ts_us", "timer", "start_line", "start_us", "in_window", *SUMS], self.state.get()))
        idle = {"kind": "idle", "line_no": s["line_no"], "ts_us": s["ts_us"], **{c: s[c] for c in SUMS}}
        self.state.update(tuple(int(-1 if c == "timer" else s[c])
                                for c in ["line_no", "ts_us", "timer", "start_line", "start_us", "in_window", *SUMS]))
        yield self._frame(key, [idle, self._window(s)])

    def close(self) -> None:
        pass

    @staticmethod
    def _window(s: dict) -> dict:
        return {"kind": "window", "line_no": s["line_no"], "start_line": s["start_line"], "start_us": s["start_us"],
                "end_us": s["ts_us"], "messages": s["in_window"]}

    @staticmethod
    def _frame(key, rows: list[dict]) -> pd.DataFrame:
        frame = pd.DataFrame([{**r, "session_id": key[0]} for r in rows], columns=_CHANGE)
        return frame.astype({c: "Int64" for c in _CHANGE[2:]})


def live_time(messages: DataFrame, inactivity: float = INACTIVITY, model_timeout: float = MODEL_TIMEOUT) -> DataFrame:
    """A feed of messages (session_id, line_no, ts_us, record_type, has_tool_result) to changes.

    Kinds of change: `totals` after each batch of a session, `window` when an active stretch ends (again
    if it turns out longer), `idle` when the feed's clock has passed the session's last line by the
    inactivity, and `late` for a line that comes after a later one of its session. Sums follow
    line order, as in the batch rule, whatever the times. Lines come with their times on a row of
    their own, a tick, which moves the clock; the lines themselves have no event time and are never
    dropped as too late. A checkpoint holds one small state per session.
    """
    spark = messages.sparkSession
    if spark.conf.get(PROVIDER, "") != ROCKSDB:
        raise RuntimeError(f"set {PROVIDER} to {ROCKSDB}")
    rows = messages.select(S, "line_no", "ts_us", "record_type", F.coalesce("has_tool_result", F.lit(False)).alias("has_tool_result"),
                           F.explode(F.array(F.lit(False), F.lit(True))).alias("tick"))
    ticking = rows.withColumn("clock", F.when(F.col("tick"), F.timestamp_micros("ts_us"))).withWatermark("clock", "0 seconds")
    return ticking.groupBy(S).transformWithStateInPandas(
        _Session(int(inactivity * SECOND), int(model_timeout * SECOND)), CHANGES, "Append", "EventTime")


def live_totals(changes: DataFrame) -> DataFrame:
    """The newest sums of each session."""
    sums = changes.filter("kind IN ('totals', 'idle')")
    newest = F.max_by(F.struct(*SUMS, "line_no", "ts_us", (F.col("kind") == "idle").alias("idle")),
                      F.struct("line_no", F.col("kind") == "idle")).alias("r")
    return sums.groupBy(S).agg(newest).select(S, "r.*")


def live_windows(changes: DataFrame) -> DataFrame:
    """Active stretches that have ended, each as it was when it was last reported."""
    newest = F.max_by(F.struct("start_us", "end_us", "messages"), "messages").alias("r")
    return changes.filter("kind = 'window'").groupBy(S, "start_line").agg(newest).select(S, "start_line", "r.*")


def late_lines(changes: DataFrame) -> DataFrame:
    return changes.filter("kind = 'late'").select(S, "line_no", "ts_us").distinct()


def _sums_near(messages: DataFrame, touched: DataFrame, size: int, inactivity: float, model_timeout: float) -> DataFrame:
    """Sums over the lines of touched segments and the line behind each run of them."""
    near = messages.join(touched.select(S).distinct(), S, "left_semi").withColumn("segment", F.floor(F.col("line_no") / size))
    line = F.struct("line_no", "ts_us", "record_type", "has_tool_result", F.col("segment").alias("lies_in"))
    cut = touched.select(S, F.col("segment").alias("t"))
    inside = near.join(touched, [S, "segment"]).select(S, F.col("segment").alias("t"), line.alias("r"), F.lit(True).alias("counts"))
    # two lines a segment stand for all of it
    ends = near.groupBy(S, "segment").agg(F.min_by(line, "line_no").alias("first"), F.max_by(line, "line_no").alias("last")).join(cut, S)
    before = ends.filter("segment < t").groupBy(S, "t").agg(F.max_by("last", "segment").alias("r")).withColumn("counts", F.lit(False))
    after = ends.filter("segment > t").groupBy(S, "t").agg(F.min_by("first", "segment").alias("r"))
    # a line behind several touched segments counts behind the last; one in a touched segment counts there
    after = (after.groupBy(S, F.col("r.line_no").alias("at")).agg(F.max_by("r", "t").alias("r"), F.max("t").alias("t"))
             .withColumn("segment", F.col("r.lies_in")).join(touched, [S, "segment"], "left_anti")
             .select(S, "t", "r", F.lit(True).alias("counts")))
    rows = inside.unionByName(before).unionByName(after)
    # each touched segment is a small session of its own, with its neighbours on both sides
    alone = rows.select(F.struct(S, "t").alias("own"), "counts", "r.*").withColumn(S, F.to_json("own"))
    gaps = with_gaps(alone, inactivity, model_timeout).filter("counts").withColumn(S, F.col(f"own.{S}"))
    counted = gaps.groupBy(S).agg(F.count_if(F.col("lies_in") == F.col("own.t")).alias("messages"))
    return time_by_session(gaps).join(counted, S)


def corrections(late: DataFrame, messages: DataFrame, inactivity: float = INACTIVITY,
                model_timeout: float = MODEL_TIMEOUT, size: int = 4096) -> DataFrame:
    """What late lines (session_id, line_no) add to the sums of their sessions.

    messages holds all lines. Only segments of `size` line numbers that a late line falls into are
    reckoned, once with and once without the late lines, and the difference is the correction: live
    totals plus corrections equal the batch rule.
    """
    late = late.select(S, "line_no").distinct()
    touched = late.select(S, F.floor(F.col("line_no") / size).alias("segment")).distinct()
    whole = messages.select(S, "line_no", "ts_us", "record_type", F.coalesce("has_tool_result", F.lit(False)).alias("has_tool_result"))
    args = (touched, size, inactivity, model_timeout)
    with_late = _sums_near(whole, *args)
    without = _sums_near(whole.join(late, [S, "line_no"], "left_anti"), *args)
    minus = without.select(S, *[(-F.col(c)).alias(c) for c in SUMS])
    return with_late.select(S, *SUMS).unionByName(minus).groupBy(S).agg(*[F.sum(c).alias(c) for c in SUMS])


def corrected_totals(changes: DataFrame, messages: DataFrame, **options) -> DataFrame:
    """Live totals with the corrections of their late lines."""
    both = live_totals(changes).select(S, *SUMS).unionByName(corrections(late_lines(changes), messages, **options))
    return both.groupBy(S).agg(*[F.sum(c).alias(c) for c in SUMS])
