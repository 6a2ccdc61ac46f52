"""Incremental report since a watermark, and the state of the ingest tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions.dates import iso_text
from logloom.functions.text import truncate_ellipsis
from logloom.operators.overview import total
from logloom.operators.session_stats import ratio
from logloom.sources.store import TableStore

S = "session_id"


def since(sessions: DataFrame, watermark_us: int | None) -> DataFrame:
    """Sessions created strictly after the watermark."""
    rows = sessions.filter(F.col("created_us").isNotNull())
    return rows if watermark_us is None else rows.filter(F.col("created_us") > watermark_us)


def summary_totals(sessions: DataFrame, stats: DataFrame, watermark_us: int | None) -> DataFrame:
    new = since(sessions, watermark_us).select(S, "total_messages", "total_tokens", "total_tool_calls")
    sums = ["total_input_tokens", "total_output_tokens", "tool_error_count",
            "trajectory_file_size_bytes", "total_chars", "cjk_chars", "latin_chars", "model_us",
            "tool_us", "user_us", "inactive_us", "model_timeout_count"]
    both = new.join(stats.select(S, *sums), S, "left")
    active = F.col("model_us") + F.col("tool_us") + F.col("user_us")
    return both.agg(
        F.count("*").alias("sessions"),
        *[total(c) for c in ("total_messages", "total_tokens", "total_tool_calls", *sums)],
    ).withColumn("active_time_ratio", F.coalesce(
        ratio(active, active + F.col("inactive_us")), F.lit(0.0)))


def summary_counts(sessions: DataFrame, errors: DataFrame, watermark_us: int | None) -> DataFrame:
    """(section, key, count) for sources, bottlenecks and error categories."""
    new = since(sessions, watermark_us)
    def part(df, section, key):
        return df.groupBy(key.alias("key")).agg(F.count("*").alias("count")).select(
            F.lit(section).alias("section"), "key", "count")

    source = F.coalesce(F.nullif("ecosystem", F.lit("")), F.lit("unknown"))
    slow = F.lower(F.coalesce(F.nullif("bottleneck", F.lit("")), F.lit("unknown")))
    failed = errors.join(new.select(S), S, "left_semi")
    return (part(new, "source", source)
            .unionByName(part(new, "bottleneck", slow))
            .unionByName(part(failed, "error_category", F.col("category"))))


def error_excerpts(sessions: DataFrame, errors: DataFrame, watermark_us: int | None,
                   limit: int = 8) -> DataFrame:
    """The first errors in order of session creation, as short previews."""
    new = since(sessions, watermark_us).select(S, "created_us")
    rows = errors.join(new, S).orderBy("created_us", S, "line_no", "block_no").limit(limit)
    return rows.select(S, "line_no", iso_text(F.col("ts_us")).alias("timestamp"), "tool_name",
                       "category", truncate_ellipsis(F.col("summary"), 120).alias("preview"))


def top_error_categories(counts: DataFrame, limit: int = 6) -> DataFrame:
    rows = counts.filter(F.col("section") == "error_category")
    return rows.select("key", "count").orderBy(F.col("count").desc(), "key").limit(limit)


def run_report(store: TableStore, manual: bool, now_iso: str, send: Callable[[], bool]) -> bool:
    """Send a report; the stored watermark moves only after success and only in auto mode."""
    ok = send()
    if ok and not manual:
        row = store.spark.createDataFrame([(now_iso,)], "last_report_sent_at string")
        store.write("report_state", row.coalesce(1))
        store.commit()
    return ok


def read_watermark(store: TableStore) -> str | None:
    state = store.read("report_state")
    return state.first()["last_report_sent_at"] if state is not None else None


def ingest_status(tracked: DataFrame, sessions: DataFrame) -> DataFrame:
    """Files by status, bytes, last parse time, and logical and physical session counts."""
    status = F.lower(F.trim(F.coalesce("parse_status", F.lit(""))))
    files = tracked.agg(
        F.count("*").alias("total_files"),
        F.count_if(status == "parsed").alias("parsed_files"),
        F.count_if(status == "error").alias("error_files"),
        F.count_if(~status.isin("parsed", "error")).alias("pending_files"),
        F.coalesce(F.sum("file_size"), F.lit(0)).alias("total_file_size_bytes"),
        F.max(F.when(F.col("parse_status") == "parsed", F.col("last_parsed_at"))).alias("last_parsed_at"))
    logical = sessions.select("ecosystem", F.coalesce("logical_session_id", S).alias("l")).distinct()
    return files.withColumns({
        "physical_sessions": sessions.agg(F.count("*")).scalar(),
        "logical_sessions": logical.agg(F.count("*")).scalar()})
