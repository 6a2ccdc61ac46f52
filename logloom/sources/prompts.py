"""Matching prompts that come over two channels, with a state of one time window.

Prompts of one file and text are gone through in line order. A copy on the item channel that has
an earlier event copy within the window is dropped. An event copy takes the place of the last item
copy within the window that no other one has taken, and that copy is dropped. What later rows can
still meet are event times and free item copies within the window of them; that is the state.

A text that a client repeats without end is no group of its own: lines are cut into pieces of at
most `piece` line numbers, each a small group. All pieces run at first as if nothing came before
them. Their end states are then handed to the next piece, and only pieces that start from another
state than before run again, until none does. A round settles at least one more piece of every
text; where windows fall apart between pieces, and that is where a client pauses, two rounds do.
"""

from __future__ import annotations

import sys
from bisect import bisect_left, insort

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.plans.staging import stage

# the functions below run in workers, which may not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PIECE = 1 << 15
_KEYS = ["source_path", "k", "piece"]
_STATE = "events array<bigint>, item_lines array<bigint>, item_us array<bigint>"
_OUT = f"source_path string, k string, piece bigint, line_no bigint, place bigint, {_STATE}"


class Matcher:
    """The rule over rows (line, time, whether on the event channel) in line order."""

    def __init__(self, width: int, events: list[int], items: list[tuple[int, int]]) -> None:
        self.width, self.events, self.items = width, sorted(events), list(items)

    def add(self, line: int, at: int, event: bool) -> list[tuple[int, int | None]]:
        """(line, its new place or None if it is dropped) of the rows this one moves."""
        if not event:
            k = bisect_left(self.events, at - self.width)
            if k < len(self.events) and self.events[k] <= at + self.width:
                return [(line, None)]
            self.items.append((line, at))
            return []
        insort(self.events, at)
        for k in range(len(self.items) - 1, -1, -1):
            if abs(self.items[k][1] - at) <= self.width:
                place = self.items.pop(k)[0]
                return [(line, place), (place, None)]
        return []

    def forget(self, earliest: int) -> None:
        """Drop what no row from `earliest` on can meet."""
        del self.events[:bisect_left(self.events, earliest - self.width)]
        if self.items and min(t for _, t in self.items) < earliest - self.width:
            self.items = [(n, t) for n, t in self.items if t >= earliest - self.width]


def _runner(width: int):
    def run(key, rows: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("line_no")
        if not len(rows):
            return pd.DataFrame([], columns=["source_path", "k", "piece", "line_no", "place", "events", "item_lines", "item_us"])
        first = start.iloc[0] if len(start) else None
        state = Matcher(width, [] if first is None else list(first["events"]),
                        [] if first is None else list(zip(first["item_lines"], first["item_us"])))
        times = rows["ts_us"].tolist()
        left = [int(rows["rest_us"].iloc[0])]  # the earliest time behind the piece
        for t in reversed(times):
            left.append(min(left[-1], t))
        moved: dict[int, int | None] = {}
        for n, (line, at, event, earliest) in enumerate(zip(rows["line_no"].tolist(), times, rows["event"].tolist(), left[-2::-1])):
            moved.update(state.add(line, at, event))
            if n % 64 == 63:
                state.forget(earliest)
        state.forget(left[0])
        out = [(*key, line, place, None, None, None) for line, place in moved.items()]
        out.append((*key, None, None, state.events, [n for n, _ in state.items], [t for _, t in state.items]))
        return pd.DataFrame(out, columns=["source_path", "k", "piece", "line_no", "place", "events", "item_lines", "item_us"]).astype(
            {"line_no": "Int64", "place": "Int64"})

    return run


def match_prompts(prompts: DataFrame, width: int, piece: int = PIECE) -> DataFrame:
    """Prompts (source_path, k, line_no, ts_us, event) to the moved ones: source_path, line_no, place.

    place is the line whose place the prompt takes, null if it is dropped.
    """
    cut = prompts.withColumn("piece", F.floor(F.col("line_no") / piece).cast("bigint"))
    least = cut.groupBy(*_KEYS).agg(F.min("ts_us").alias("least"))
    behind = Window.partitionBy("source_path", "k").orderBy("piece").rowsBetween(1, Window.unboundedFollowing)
    rest = least.select(*_KEYS, F.coalesce(F.min("least").over(behind), F.lit(1 << 62)).alias("rest_us"))
    rows = stage(cut.join(rest, _KEYS).select(*_KEYS, "line_no", "ts_us", "event", "rest_us"), "prompts")
    spark = prompts.sparkSession
    used = spark.createDataFrame([], f"source_path string, k string, piece bigint, {_STATE}")
    order = Window.partitionBy("source_path", "k").orderBy("piece")
    done = None
    todo = rows
    while True:
        new = stage(todo.groupBy(*_KEYS).cogroup(used.groupBy(*_KEYS)).applyInPandas(_runner(width), _OUT), "matched")
        done = new if done is None else stage(
            done.join(new.select(*_KEYS).distinct(), _KEYS, "left_anti").unionByName(new), "matched")
        ends = done.filter("line_no is null").select(*_KEYS, F.struct("events", "item_lines", "item_us").alias("end"))
        starts = ends.select(*_KEYS, F.lag("end").over(order).alias("start")).filter("start is not null")
        empty = (F.size("start.events") == 0) & (F.size("start.item_lines") == 0)
        before = used.select(*_KEYS, F.struct("events", "item_lines", "item_us").alias("was"))
        changed = stage(starts.join(before, _KEYS, "left").filter(
            (F.col("was").isNull() & ~empty) | (F.col("was").isNotNull() & (F.col("start") != F.col("was")))).select(
            *_KEYS, "start.*"), "starts")
        if changed.isEmpty():
            return done.filter("line_no is not null").select("source_path", "line_no", "place")
        todo = rows.join(changed.select(*_KEYS), _KEYS, "left_semi")
        used = stage(used.join(changed.select(*_KEYS), _KEYS, "left_anti").unionByName(changed), "used")
