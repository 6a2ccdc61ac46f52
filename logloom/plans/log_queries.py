"""Queries over log files: scan, both normalisers, ingest and the tables it writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.plans.log_store import GrownStore, LogStore, session_of
from logloom.schemas import explode_blocks

S = "session_id"


def log_files(s: LogStore) -> DataFrame:
    return s.table("tracked_files").select("ecosystem", session_of(F.col("file_path")).alias("session"),
                                           "parse_status", "last_parsed_at")


def log_ingest_runs(s: LogStore) -> DataFrame:
    """Files parsed, skipped and in error by a first run and one over unchanged files."""
    rows = [(n, r.parsed, r.skipped, r.errors) for n, r in enumerate(s.runs)]
    return s.spark.createDataFrame(rows, "run bigint, parsed bigint, skipped bigint, errors bigint")


def log_ingest_errors(s: LogStore) -> DataFrame:
    return s.table("ingest_errors").select(session_of(F.col("file_path")).alias("session"), "line_no", "reason")


def log_messages_a(s: LogStore) -> DataFrame:
    return s.done_a.messages.groupBy(S, "record_type", "role").agg(
        F.count("*").alias("messages"), F.sum("line_no").alias("line_sum"),
        F.count_if("inferred_ts").alias("inferred"), F.count_if("has_usage").alias("with_usage"),
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.count_if("content_string").alias("plain"))


def log_inferred_times(s: LogStore) -> DataFrame:
    return s.done_a.messages.filter("inferred_ts").select(S, "line_no", "uuid", "timestamp", "ts_us")


def log_results_a(s: LogStore) -> DataFrame:
    """Tool results by their three-state error flag."""
    blocks = explode_blocks(s.done_a.messages)
    return blocks.groupBy(S, "block_type", F.coalesce(F.col("is_error").cast("string"), F.lit("unknown")).alias(
        "flag")).agg(F.count("*").alias("blocks"), F.sum(F.length("result_text")).alias("result_chars"))


def log_compactions(s: LogStore) -> DataFrame:
    return s.table("compact_events").select(S, "line_no", "trigger", "pre_tokens")


def log_sessions(s: LogStore) -> DataFrame:
    return s.table("sessions").select("ecosystem", S, "parent_session_id", "root_session_id", "logical_session_id",
                                      "total_messages", "total_tokens", "total_tool_calls")


def log_compact_counts(s: LogStore) -> DataFrame:
    return s.table("session_statistics").select(S, "compact_count")


def log_messages_b(s: LogStore) -> DataFrame:
    return s.done_b.messages.groupBy(S, "record_type", "role").agg(
        F.count("*").alias("messages"), F.sum("line_no").alias("line_sum"),
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.sum("cache_read_tokens").alias("cache_read_tokens"))


def log_results_b(s: LogStore) -> DataFrame:
    """Outcomes of tools from plain, structured and nested output."""
    blocks = explode_blocks(s.done_b.messages).filter("block_type = 'tool_result'")
    return blocks.groupBy(S, "is_error").agg(F.count("*").alias("results"))


def log_diagnostics_b(s: LogStore) -> DataFrame:
    return s.done_b.diagnostics.select(session_of(F.col("source_path")).alias("session"), "section", "key", "count")


def log_lineage_b(s: LogStore) -> DataFrame:
    return s.done_b.lineage.select(S, "parent_session_id", "root_session_id")


def log_grown_runs(s: GrownStore) -> DataFrame:
    """A run over the first lines, and one that reads grown files on and a rewritten one whole."""
    rows = [(n, r.parsed, r.skipped, r.errors, r.resumed) for n, r in enumerate(s.runs)]
    return s.spark.createDataFrame(rows, "run bigint, parsed bigint, skipped bigint, errors bigint, resumed bigint")


def log_grown_compactions(s: GrownStore) -> DataFrame:
    return log_compactions(s)


def log_grown_sessions(s: GrownStore) -> DataFrame:
    return log_sessions(s)


def log_grown_messages(s: GrownStore) -> DataFrame:
    """Messages as they are kept by file, before prompts are matched."""
    kept = [s.table(f"file_messages_{name}").select(session_of(F.col("source_path")).alias("session"), "line_no")
            for name in ("rendered_a", "rendered_b")]
    return kept[0].unionByName(kept[1]).groupBy("session").agg(
        F.count("*").alias("messages"), F.sum("line_no").alias("line_sum"))


GROWN_QUERIES = [log_grown_runs, log_grown_compactions, log_grown_sessions, log_grown_messages]
LOG_QUERIES = [log_files, log_ingest_runs, log_ingest_errors, log_messages_a, log_inferred_times, log_results_a,
               log_compactions, log_sessions, log_compact_counts, log_messages_b, log_results_b, log_diagnostics_b,
               log_lineage_b]
