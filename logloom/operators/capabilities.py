"""What each log format can tell, as a small dimension table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Capability flags of the two formats.
CAPABILITIES = {
    "format_a": {
        "display_name": "Format A", "tool_call_events": True, "subagent_events": False,
        "parent_child_session_links": False, "cache_read_tokens": True,
        "cache_creation_tokens": True, "reasoning_tokens": False,
        "categorization_available": True, "missing_timestamps": "skip_timing_metrics",
    },
    "format_b": {
        "display_name": "Format B", "tool_call_events": True, "subagent_events": True,
        "parent_child_session_links": True, "cache_read_tokens": True,
        "cache_creation_tokens": True, "reasoning_tokens": False,
        "categorization_available": True, "missing_timestamps": "infer_best_effort",
    },
}
SCHEMA = """ecosystem string, display_name string, tool_call_events boolean,
  subagent_events boolean, parent_child_session_links boolean, cache_read_tokens boolean,
  cache_creation_tokens boolean, reasoning_tokens boolean, categorization_available boolean,
  missing_timestamps string"""

# Wording of a drift warning, by flag, and the observation that contradicts it.
DRIFT = [
    ("tool_call_events", "total_tool_calls",
     "tool_call_events=false but parsed stats include tool calls; check parser/manifest drift"),
    ("subagent_events", "subagent_count",
     "subagent_events=false but parsed session includes subagent sessions; check manifest drift"),
    ("cache_read_tokens", "cache_read_tokens",
     "cache_read_tokens=false but parsed stats include cache_read_tokens; check manifest drift"),
    ("cache_creation_tokens", "cache_creation_tokens",
     "cache_creation_tokens=false but parsed stats include cache_creation_tokens; "
     "check manifest drift"),
    ("categorization_available", "tool_error_count",
     "tool_error taxonomy disabled in manifest but parsed error records exist; "
     "check manifest drift"),
]

# Notice id, severity, label, reason and the test on the flags.
NOTICES = [
    ("reasoning_tokens", "info", "Reasoning tokens",
     "Not exposed by this ecosystem; related metrics should render as N/A.",
     "NOT reasoning_tokens"),
    ("lineage_links", "info", "Parent/child lineage",
     "Physical parent-child session links are not available.", "NOT parent_child_session_links"),
    ("timestamp_inference", "warning", "Time-based metrics",
     "Missing timestamps are inferred best-effort; latency/time metrics are approximate.",
     "missing_timestamps = 'infer_best_effort'"),
    ("tool_error_taxonomy", "warning", "Tool error taxonomy",
     "Tool errors cannot be fully categorized in this ecosystem.",
     "NOT categorization_available"),
]


def capability_table(spark: SparkSession, table: dict | None = None) -> DataFrame:
    rows = [(name, *flags.values()) for name, flags in (table or CAPABILITIES).items()]
    return spark.createDataFrame(rows, SCHEMA)


def capability_drift(stats: DataFrame, capabilities: DataFrame) -> DataFrame:
    """Warnings where a session shows what its format is declared not to have."""
    declared = capabilities.select("ecosystem", *[F.col(f).alias(f"_can_{f}") for f, _, _ in DRIFT])
    # one row per log format
    both = stats.join(F.broadcast(declared), "ecosystem")
    found = F.array_compact(F.array(*[
        F.when(~F.col(f"_can_{flag}") & (F.col(seen) > 0), F.lit(text))
        for flag, seen, text in DRIFT]))
    return both.select("session_id", "ecosystem", F.explode(found).alias("warning"))


def capability_notices(capabilities: DataFrame) -> DataFrame:
    rules = F.array_compact(F.array(*[
        F.when(F.expr(test), F.struct(F.lit(i).alias("id"), F.lit(sev).alias("severity"),
                                      F.lit(label).alias("label"), F.lit(why).alias("reason")))
        for i, sev, label, why, test in NOTICES]))
    return capabilities.select("ecosystem", F.explode(rules).alias("n")).select("ecosystem", "n.*")


def with_capabilities(df: DataFrame, capabilities: DataFrame) -> DataFrame:
    """Display label per row; an unlisted format keeps its own name."""
    names = capabilities.select("ecosystem", "display_name")
    return df.join(F.broadcast(names), "ecosystem", "left").withColumn(
        "display_name", F.coalesce("display_name", F.nullif(F.trim("ecosystem"), F.lit("")),
                                   F.lit("Unknown")))
