"""Wall-clock coverage: the measure of a union of intervals, split into day and night.

Intervals are cut at minute borders. A long interval adds at most two partial pieces and
a +1 / -1 pair for the full minutes between them, so no interval is exploded and no group
holds more than the distinct start instants of one minute.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.dates import SECOND, night_micros, window_bounds
from logloom.operators.overview import ROLES, session_span

MINUTE = 60 * SECOND


def merge_intervals(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Union of [start_us, end_us) per key; touching intervals join.

    For keys whose groups are bounded; `union_measure` measures unions of any size.
    """
    longest = intervals.groupBy(*keys, "start_us").agg(F.max("end_us").alias("end_us"))
    order = Window.partitionBy(*keys).orderBy("start_us")
    reach = F.max("end_us").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(reach.isNull() | (F.col("start_us") > reach), 1).otherwise(0)
    island = F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    flagged = longest.withColumn("_new", starts).withColumn("_island", island)
    return flagged.groupBy(*keys, "_island").agg(
        F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us")).drop("_island")


def union_measure(intervals: DataFrame, keys: list[str], tz: str = "UTC") -> DataFrame:
    """(keys, covered_us, night_us) of the union of [start_us, end_us) per key."""
    s, e = F.col("start_us"), F.col("end_us")
    first, last = F.floor(s / MINUTE), F.floor((e - 1) / MINUTE)
    cut = intervals.filter(e > s).select(*keys, "start_us", "end_us", first.alias("m1"),
                                         last.alias("m2"))
    one = F.struct(F.col("m1").alias("minute"), s.alias("start_us"), e.alias("end_us"))
    head = F.struct(F.col("m1").alias("minute"), s.alias("start_us"),
                    ((F.col("m1") + 1) * MINUTE).alias("end_us"))
    tail = F.struct(F.col("m2").alias("minute"), (F.col("m2") * MINUTE).alias("start_us"),
                    e.alias("end_us"))
    pieces = cut.select(*keys, F.explode(
        F.when(F.col("m1") == F.col("m2"), F.array(one)).otherwise(F.array(head, tail))
    ).alias("p")).select(*keys, "p.*")
    merged = merge_intervals(pieces, [*keys, "minute"])
    span = F.col("end_us") - F.col("start_us")
    local = merged.groupBy(*keys, "minute").agg(
        F.sum(span).alias("covered_us"),
        F.sum(night_micros(F.col("start_us"), span, tz)).alias("night_us"))

    steps = cut.filter(F.col("m2") - F.col("m1") > 1).select(*keys, F.explode(F.array(
        F.struct((F.col("m1") + 1).alias("minute"), F.lit(1).alias("step")),
        F.struct(F.col("m2").alias("minute"), F.lit(-1).alias("step")))).alias("p")
    ).select(*keys, "p.*").groupBy(*keys, "minute").agg(F.sum("step").alias("step"))

    events = local.unionByName(steps, allowMissingColumns=True).groupBy(*keys, "minute").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("covered_us", "night_us", "step")])
    # one row per touched minute: as long as the analysed period, whatever the row count
    by_time = Window.partitionBy(*keys).orderBy("minute")
    depth = F.sum("step").over(by_time.rowsBetween(Window.unboundedPreceding, 0))
    full = (F.coalesce(F.lead("minute").over(by_time), F.col("minute")) - F.col("minute")) * MINUTE
    runs = events.select("*", depth.alias("depth"), full.alias("full_us"))
    begin = F.col("minute") * MINUTE
    covered = F.when(F.col("depth") > 0, F.col("full_us")).otherwise(F.col("covered_us"))
    night = F.when(F.col("depth") > 0, night_micros(begin, F.col("full_us"), tz)).otherwise(
        F.col("night_us"))
    return runs.groupBy(*keys).agg(F.sum(covered).alias("covered_us"),
                                   F.sum(night).alias("night_us"))


def role_coverage(rows: DataFrame, start: str, end: str, tz: str = "UTC") -> DataFrame:
    """Per role: day and night seconds with any session in which the role was active.

    Session spans are clipped to the window; a role counts if its time is above zero.
    """
    low, high = window_bounds(start, end, tz)
    span = session_span()
    clipped = rows.filter(F.col("created_us").isNotNull() & (span > 0)).select(
        F.greatest("created_us", F.lit(low)).alias("start_us"),
        F.least(F.col("created_us") + span, F.lit(high)).alias("end_us"),
        F.array_compact(F.array(*[F.when(F.col(f"{r}_us") > 0, F.lit(r)) for r in ROLES]))
        .alias("roles"))
    intervals = clipped.select(F.explode("roles").alias("role"), "start_us", "end_us")
    measured = union_measure(intervals, ["role"], tz)
    night_window = night_micros(F.lit(low), F.lit(high - low), tz)
    roles = rows.sparkSession.createDataFrame([(r,) for r in ROLES], "role string")
    out = F.broadcast(roles).join(measured, "role", "left").na.fill(0).withColumn(
        "_night", night_window)
    day_window = F.lit(high - low) - F.col("_night")
    return out.select(
        "role",
        (F.least(F.col("covered_us") - F.col("night_us"), day_window) / SECOND).alias("day_seconds"),
        (F.least(F.col("night_us"), F.col("_night")) / SECOND).alias("night_seconds"),
        (day_window / SECOND).alias("day_window_seconds"),
        (F.col("_night") / SECOND).alias("night_window_seconds"),
    )


def coverage_ratios(coverage: DataFrame) -> DataFrame:
    """Coverage as a share of its window, clamped to [0, 1]."""
    def clamp(p: str):
        window = F.greatest(F.col(f"{p}_window_seconds"), F.lit(0.0))
        value = F.greatest(F.col(f"{p}_seconds"), F.lit(0.0))
        part = F.when(window > 0, F.least(value / window, F.lit(1.0))).otherwise(F.lit(0.0))
        return part.alias(f"{p}_coverage")

    return coverage.select("role", clamp("day"), clamp("night"))
