"""Reads ordinary event tables as a trajectory: messages and content blocks.

An event row is one log line. Its id is the line number, so file order is id order.
Every session covers one user and one week.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.dates import iso_text, ntz_micros
from logloom.schemas import BLOCK

WEEK_MICROS = 7 * 86_400 * 1_000_000


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _command(k, user):
    """A shell line whose shape and length follow the event."""
    return F.concat(
        F.lit("cd /srv/u"), user.cast("string"), F.lit(" && MODE="), k.cast("string"),
        F.lit(" /usr/bin/run_"), (k % 4).cast("string"), F.lit(" --n "), k.cast("string"),
        F.when(k % 3 == 0, F.lit(" | tail -n 5")).otherwise(F.lit("")),
        F.when(k % 5 == 0, F.lit("; echo done")).otherwise(F.lit("")),
    )


def _error_text(k):
    texts = ["Permission denied", "bash: rgx: command not found", "operation timed out",
             "Process exited with code 2", "unexpected widget explosion",
             "HTTP 429 Too Many Requests", "AssertionError: expected 2"]
    return F.concat(F.element_at(F.array(*[F.lit(t) for t in texts]), (k % 7 + 1).cast("int")),
                    F.lit(" at "), k.cast("string"))


def event_messages(events: DataFrame) -> DataFrame:
    """Messages (with nested blocks) from rows of event_id, ts, user_id, event_type, value, props."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    e = events.select(
        "event_id", "user_id", "event_type", "props",
        ntz_micros(F.col("ts")).alias("ts_us"), k.alias("k"),
        F.round("value").cast("bigint").alias("amount"),
    )
    kind = F.col("event_type")
    k, user, week = F.col("k"), F.col("user_id"), F.floor(F.col("ts_us") / F.lit(WEEK_MICROS))
    is_call, is_result = kind == "click", kind.isin("purchase", "error")
    is_reply = kind.isin("view", "click")
    tool = F.when(k % 7 == 0, F.lit("Bash")).when(
        k % 7 == 1, F.concat(F.lit("mcp__srv_"), (k % 3).cast("string"), F.lit("__run"))).otherwise(
        F.concat(F.lit("tool_"), (k % 7).cast("string")))
    command = F.when(is_call & (tool == "Bash"), _command(k, user))
    result = F.when(kind == "error", _error_text(k)).when(kind == "purchase", F.col("props"))
    block = F.struct(
        F.when(is_call, F.lit("tool_use")).when(is_result, F.lit("tool_result"))
        .when(kind == "view", F.lit("text")).otherwise(F.lit("string")).alias("block_type"),
        F.when(~is_call & ~is_result, F.col("props")).alias("text"),
        F.when(is_call, tool).alias("tool_name"),
        F.when(is_call | is_result, (k % 5).cast("string")).alias("tool_id"),
        command.alias("command"),
        F.when(is_call, F.array(F.lit("command"))).alias("param_keys"),
        F.when(is_call, F.to_json(F.struct(command.alias("command")))).alias("input_json"),
        F.when(is_result, kind == "error").alias("is_error"),
        result.alias("result_text"), result.alias("result_string"),
        F.length(result).cast("bigint").alias("output_chars"),
    ).cast(BLOCK)
    amount = F.col("amount")
    side = is_reply & (k % 11 == 0)
    return e.select(
        F.concat(F.lit("source_"), (user % 2).cast("string")).alias("ecosystem"),
        F.concat(F.lit("/logs/u"), user.cast("string"), F.lit("/events.jsonl")).alias("source_path"),
        F.concat(F.lit("u"), user.cast("string"), F.lit("-"), week.cast("string")).alias("session_id"),
        F.col("event_id").alias("line_no"),
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("uuid"),
        iso_text(F.col("ts_us")).alias("timestamp"), "ts_us", F.lit(False).alias("inferred_ts"),
        F.when(is_reply, F.lit("assistant")).otherwise(F.lit("user")).alias("record_type"),
        F.when(is_reply, F.lit("assistant")).otherwise(F.lit("user")).alias("role"),
        F.when(side, F.lit("root")).alias("parent_uuid"),
        F.lit(None).cast("string").alias("user_type"),
        F.concat(F.lit("/srv/team/p"), (user % 10).cast("string")).alias("cwd"),
        F.lit("1.0").alias("version"),
        F.when(user % 4 > 0, F.concat(F.lit("branch_"), (user % 4).cast("string"))).alias("git_branch"),
        side.alias("is_sidechain"),
        F.when(side, F.concat(F.lit("a"), (k % 2).cast("string"))).alias("agent_id"),
        F.lit(None).cast("boolean").alias("is_meta"),
        F.when(is_reply, F.concat(F.lit("model_"), (user % 3).cast("string"))).alias("model"),
        is_reply.alias("has_usage"),
        F.when(is_reply, amount).alias("input_tokens"),
        F.when(is_reply, k).alias("output_tokens"),
        F.when(is_reply & (k % 4 == 0), k).alias("cache_creation_tokens"),
        F.when(is_reply & (k % 3 == 0), amount).alias("cache_read_tokens"),
        F.lit(None).cast("string").alias("service_tier"),
        (kind == "signup").alias("content_string"),
        is_result.alias("has_tool_result"),
        F.lit(None).cast("string").alias("summary"),
        F.lit(None).cast("string").alias("details_json"),
        F.array(block).alias("blocks"),
    )


def event_lineage(messages: DataFrame) -> DataFrame:
    """Root of a session: the same user's session of the even week."""
    ids = messages.select("session_id").distinct()
    user = F.substring_index("session_id", "-", 1)
    week = F.substring_index("session_id", "-", -1).cast("bigint")
    root = F.concat(user, F.lit("-"), (week - week % 2).cast("string"))
    return ids.select("session_id", F.lit(None).cast("string").alias("parent_session_id"),
                      root.alias("root_session_id"))


def event_log_lines(events: DataFrame) -> DataFrame:
    """Events rendered as log lines: (source_path, line_no, value)."""
    m = event_messages(events)
    b = F.element_at("blocks", 1)
    block = F.when(b["block_type"] == "tool_use", F.to_json(F.struct(
        F.lit("tool_use").alias("type"), b["tool_id"].alias("id"), b["tool_name"].alias("name"),
        F.struct(b["command"].alias("command")).alias("input")))).when(
        b["block_type"] == "tool_result", F.to_json(F.struct(
            F.lit("tool_result").alias("type"), b["tool_id"].alias("tool_use_id"),
            b["result_text"].alias("content"), b["is_error"].alias("is_error")))).otherwise(
        F.to_json(F.struct(F.lit("text").alias("type"), b["text"].alias("text"))))
    usage = F.to_json(F.struct("input_tokens", "output_tokens",
                               F.col("cache_creation_tokens").alias("cache_creation_input_tokens"),
                               F.col("cache_read_tokens").alias("cache_read_input_tokens")))
    head = F.to_json(F.struct(
        F.col("record_type").alias("type"), F.col("session_id").alias("sessionId"), "uuid",
        "timestamp", "cwd", "version", F.col("git_branch").alias("gitBranch"),
        F.col("is_sidechain").alias("isSidechain"), F.col("agent_id").alias("agentId")))
    message = F.concat(
        F.lit('{"role":"'), F.col("role"), F.lit('"'),
        F.when(F.col("has_usage"), F.concat(F.lit(',"usage":'), usage)).otherwise(F.lit("")),
        F.lit(',"content":['), block, F.lit("]}"))
    line = F.concat(F.regexp_replace(head, r"\}\z", ""), F.lit(',"message":'), message, F.lit("}"))
    return m.select("source_path", "line_no", line.alias("value"))
