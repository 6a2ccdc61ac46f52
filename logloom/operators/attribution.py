"""Where the time of a session goes: gaps between consecutive messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions.dates import SECOND
from logloom.operators.segments import with_carried, with_neighbours

INACTIVITY = 1800.0
MODEL_TIMEOUT = 600.0


def with_gaps(messages: DataFrame, inactivity: float = INACTIVITY,
              model_timeout: float = MODEL_TIMEOUT, size: int | None = None) -> DataFrame:
    """Add gap_us, gap_kind (model / tool / user / inactive) and is_timeout.

    Order is file order. A negative gap has no kind but still moves the cursor.
    """
    kind = F.col("record_type")
    rows = with_neighbours(messages, ["session_id"], previous={"prev_us": "ts_us"}, size=size)
    gap = F.col("ts_us") - F.col("prev_us")
    rows = rows.withColumn("gap_us", F.when(gap >= 0, gap)).drop("prev_us")
    gap = F.col("gap_us")
    idle = gap > F.lit(int(inactivity * SECOND))
    return rows.withColumn(
        "gap_kind",
        F.when(gap.isNull(), None)
        .when(idle, F.lit("inactive"))
        .when(kind == "assistant", F.lit("model"))
        .when((kind == "user") & F.coalesce("has_tool_result", F.lit(False)), F.lit("tool"))
        .when(kind == "user", F.lit("user")),
    ).withColumn(
        "is_timeout",
        F.coalesce((F.col("gap_kind") == "model")
                   & (gap > F.lit(int(model_timeout * SECOND))), F.lit(False)),
    )


def time_by_session(gaps: DataFrame) -> DataFrame:
    """Micros per kind and the model-timeout count, one row per session."""
    def total(kind: str):
        return F.coalesce(F.sum(F.when(F.col("gap_kind") == kind, F.col("gap_us"))), F.lit(0))

    return gaps.groupBy("session_id").agg(
        *[total(k).alias(f"{k}_us") for k in ("model", "tool", "user", "inactive")],
        F.count_if("is_timeout").alias("model_timeout_count"),
    )


def activity_windows(messages: DataFrame, inactivity: float = INACTIVITY,
                     size: int | None = None) -> DataFrame:
    """Split each session where a gap passes the threshold; one row per active stretch."""
    flagged = with_gaps(messages, inactivity, size=size).withColumn(
        "_cut", F.when(F.col("gap_kind") == "inactive", F.col("line_no")))
    marked = with_carried(flagged.select("session_id", "line_no", "ts_us", "_cut"),
                          ["session_id"], {"_earlier_cut": F.col("_cut")},
                          order=["line_no"], size=size)
    start = F.coalesce("_cut", "_earlier_cut", F.lit(-1))
    return marked.withColumn("_start", start).groupBy("session_id", "_start").agg(
        F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"),
        F.count("*").alias("messages"),
    ).drop("_start")
