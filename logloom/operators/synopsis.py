"""Compact description of every session, and work lists for what is still to be done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.text import content_hash, truncate_words
from logloom.operators.session_stats import error_categories, top_tools_by_session
from logloom.operators.sessions import main_stream

S = "session_id"


def message_text(summary: Column, blocks: Column, limit: int = 200) -> Column:
    """Text, tool names and plain results of one message, in order, cut at a word."""
    def piece(b: Column) -> Column:
        return (F.when(b["block_type"].isin("text", "string"), b["text"])
                .when((b["block_type"] == "tool_use") & b["tool_name"].isNotNull(),
                      F.concat(F.lit("tool:"), b["tool_name"]))
                .when(b["block_type"] == "tool_result", b["result_string"]))

    parts = F.concat(F.array(F.nullif(summary, F.lit(""))),
                     F.coalesce(F.transform(blocks, piece), F.array().cast("array<string>")))
    return truncate_words(F.array_join(parts, " "), limit)


def goals_and_outcomes(messages: DataFrame) -> DataFrame:
    """First user text and last assistant text of the main stream."""
    m = main_stream(messages)
    body = F.struct("summary", "blocks")
    user = F.when(F.col("record_type") == "user", F.col("line_no"))
    model = F.when(F.col("record_type") == "assistant", F.col("line_no"))
    ends = m.groupBy(S).agg(F.min_by(body, user).alias("u"), F.max_by(body, model).alias("a"))
    return ends.select(
        S,
        F.when(F.col("u").isNotNull(), message_text(F.col("u.summary"), F.col("u.blocks")))
        .alias("user_goal"),
        F.when(F.col("a").isNotNull(), message_text(F.col("a.summary"), F.col("a.blocks")))
        .alias("final_outcome"))


def _top_names(df: DataFrame, name: str, rank: str) -> DataFrame:
    """At most five names per session, as an array in rank order."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(rank), F.col(name))))
    return df.groupBy(S).agg(F.transform(pairs, lambda p: p[name]).alias(name))


# The fields of a synopsis.
FIELDS = ["session_id", "ecosystem", "project_path", "git_branch", "created_at", "updated_at",
          "total_messages", "total_tokens", "total_tool_calls", "duration_seconds", "bottleneck",
          "automation_ratio", "tool_error_count", "compact_count", "subagent_count", "top_tools",
          "tool_error_categories", "user_goal", "final_outcome"]


def synopsis(sessions: DataFrame, stats: DataFrame, messages: DataFrame, tools: DataFrame,
             errors: DataFrame) -> DataFrame:
    """One row per session with its key numbers, top tools and errors, goal, outcome and hash."""
    tools5 = _top_names(top_tools_by_session(tools, 5).withColumnRenamed("tool_name", "top_tools"),
                        "top_tools", "tool_rank")
    order = Window.partitionBy(S).orderBy(F.col("errors").desc(), "category")
    cats = error_categories(errors).withColumn("r", F.row_number().over(order)).filter("r <= 5")
    cats5 = _top_names(cats.withColumnRenamed("category", "tool_error_categories"),
                       "tool_error_categories", "r")
    extra = stats.select(S, "tool_error_count", "compact_count", "subagent_count")
    none = F.array().cast("array<string>")
    out = (sessions.join(extra, S, "left").join(tools5, S, "left").join(cats5, S, "left")
           .join(goals_and_outcomes(messages), S, "left")
           .withColumns({c: F.coalesce(c, none) for c in ("top_tools", "tool_error_categories")})
           .select(*FIELDS))
    payload = F.to_json(F.struct(*sorted(FIELDS)), {"ignoreNullFields": "false"})
    return out.withColumn("synopsis_hash", content_hash(payload))


def work_list(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `wanted` with no completed, non-empty entry in `done` under the same keys.

    Summaries use session_id, synopsis_hash, prompt_version and model_id; embeddings use
    session_id, summary_hash, model_id and provider_name.
    """
    finished = done.filter((F.col("generation_status") == "completed") & F.col("has_output"))
    return wanted.join(finished.select(*keys), keys, "left_anti")
