"""Flat exports of session metrics and analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.dates import SECOND

S = "session_id"

# Exported metrics, their names and the column (or expression) behind them.
METRICS = [
    ("Total Messages", "message_count"),
    ("User Messages", "user_message_count"),
    ("Assistant Messages", "assistant_message_count"),
    ("Total Tokens", "total_tokens"),
    ("Input Tokens", "total_input_tokens"),
    ("Output Tokens", "total_output_tokens"),
    ("Cache Read Tokens", "cache_read_tokens"),
    ("Cache Creation Tokens", "cache_creation_tokens"),
    ("Total Tool Calls", "total_tool_calls"),
    ("Subagent Count", "subagent_count"),
    ("Session Duration (seconds)", "duration_seconds"),
    ("Model Time (seconds)", f"round(model_us / {SECOND}, 2)"),
    ("Tool Time (seconds)", f"round(tool_us / {SECOND}, 2)"),
    ("User Time (seconds)", f"round(user_us / {SECOND}, 2)"),
    ("Model Time %", "round(model_time_percent, 1)"),
    ("Tool Time %", "round(tool_time_percent, 1)"),
    ("User Time %", "round(user_time_percent, 1)"),
    ("Inactive Time (seconds)", f"round(inactive_us / {SECOND}, 2)"),
    ("Inactive Time %", "round(inactive_time_percent, 1)"),
]


def fixed2(c: Column) -> Column:
    return F.format_string("%.2f", c.cast("double"))


def metric_rows(stats: DataFrame) -> DataFrame:
    """(session_id, metric, value): one row per session and metric."""
    cells = ", ".join(f"'{name}', coalesce(cast({expr} as double), 0D)" for name, expr in METRICS)
    return stats.selectExpr(S, f"stack({len(METRICS)}, {cells}) as (metric, value)")


def tool_rows(tools: DataFrame) -> DataFrame:
    seen = F.col("success_count") + F.col("error_count")
    rate = F.col("success_count") / F.when(seen == 0, F.lit(1)).otherwise(seen) * 100
    return tools.select(S, "tool_name", "tool_group", F.col("calls").alias("total_calls"), "total_tokens",
                        "success_count", "error_count", fixed2(rate).alias("success_rate"),
                        F.round("avg_latency_seconds", 3).alias("avg_latency_seconds"))


def analytics_tables(operations: DataFrame, patterns: DataFrame, parameters: DataFrame,
                     efficiency: DataFrame, anomalies: DataFrame, advice: DataFrame,
                     heatmap: DataFrame) -> dict[str, DataFrame]:
    """The six analytics exports by file name; parameter names of a tool are joined by `; `."""
    named = parameters.groupBy(S, "tool_name").agg(
        F.array_join(F.array_sort(F.collect_set("parameter")), "; ").alias("parameters"))
    kind = F.col("type")
    return {
        "expensive_operations": operations.select(
            S, F.col("cost_rank").alias("rank"), "type", "name", "tokens", "timestamp",
            F.when(kind == "tool_call", F.col("name")).otherwise(F.lit("")).alias("tool_name"),
            F.when(kind == "subagent", F.lit("subagent")).otherwise(F.lit("")).alias("agent_type")),
        "tool_patterns": patterns.join(named, [S, "tool_name"], "left").select(
            S, "tool_name", F.col("calls").alias("total_calls"),
            fixed2(F.col("avg_tokens")).alias("avg_tokens_per_call"),
            fixed2(F.col("success_rate") * 100).alias("success_rate"),
            F.coalesce("parameters", F.lit("")).alias("parameters")),
        "subagent_efficiency": efficiency.select(
            S, "agent_type", F.col("invocations").alias("total_invocations"),
            *[fixed2(F.col(c)).alias(c) for c in ("avg_messages", "avg_tokens", "avg_duration_seconds",
                                                  "tokens_per_minute")], "efficiency_score"),
        "bottlenecks": anomalies.select(
            S, "type", "severity", "description", F.col("component").alias("affected_component"),
            F.coalesce("tokens_wasted", F.lit(0.0)).alias("tokens_wasted"), "recommendation"),
        "recommendations": advice.select(
            S, "category", "priority", "title",
            F.coalesce("token_savings", F.lit(0.0)).alias("potential_token_savings")),
        "token_heatmap": heatmap.select(
            S, "timestamp", F.col("tokens").alias("total_tokens"), "input_tokens", "output_tokens",
            "cache_read_tokens", "cache_creation_tokens", "message_type"),
    }


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", "true").option("quote", '"').option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)
