"""Tool calls and their results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions.text import non_blank, shell_base_commands
from logloom.operators.segments import with_carried

ORDER = ["line_no", "block_no"]


def tool_blocks(blocks: DataFrame) -> DataFrame:
    """The tool_use and tool_result rows only, ids blank instead of null."""
    return blocks.filter(F.col("block_type").isin("tool_use", "tool_result")).withColumn(
        "tool_id", F.coalesce("tool_id", F.lit("")))


def pair_tools(blocks: DataFrame, size: int | None = None) -> DataFrame:
    """Every tool_result with the latest earlier tool_use of the same id, if any.

    Adds `call_name`, `call_us`, `call_commands` (commands of the latest shell call with
    any), `matched`, the resolved `name`, and `latency_us` (null if unmatched or negative).
    """
    tools = tool_blocks(blocks)
    is_use = F.col("block_type") == "tool_use"
    commands = F.when(is_use & (F.col("tool_name") == "Bash"),
                      shell_base_commands(F.col("command")))
    carried = with_carried(
        tools, ["session_id", "tool_id"],
        {
            "_call": F.when(is_use, F.struct(F.col("tool_name").alias("name"),
                                             F.col("ts_us").alias("at"))),
            "call_commands": F.when(F.size(commands) > 0, commands),
        },
        order=ORDER, size=size,
    )
    results = carried.filter(F.col("block_type") == "tool_result")
    latency = F.col("ts_us") - F.col("_call.at")
    return results.select(
        *tools.columns,
        "call_commands",
        F.col("_call.name").alias("call_name"),
        F.col("_call.at").alias("call_us"),
        F.col("_call").isNotNull().alias("matched"),
        F.when(F.col("_call").isNotNull(), F.col("_call.name"))
        .otherwise(F.coalesce(non_blank(F.col("tool_name")), F.lit("unknown"))).alias("name"),
        F.when(latency >= 0, latency).alias("latency_us"),
    )


def orphan_counts(pairs: DataFrame) -> DataFrame:
    """Results without a call: once per (session, tool, id); each id-less one counts."""
    orphans = pairs.filter(~F.col("matched"))
    with_id = orphans.filter(F.col("tool_id") != "").select("session_id", "name", "tool_id").distinct()
    without = orphans.filter(F.col("tool_id") == "")
    return (
        with_id.select("session_id", "name")
        .unionByName(without.select("session_id", "name"))
        .groupBy("session_id", "name").agg(F.count("*").alias("orphans"))
    )


def hidden_result_messages(messages: DataFrame, blocks: DataFrame) -> DataFrame:
    """uuids of messages holding only results, at least one of whose calls came earlier.

    Works on the main stream; the call must be complete (id, name and an object input).
    """
    main = blocks.filter(~F.coalesce("is_sidechain", F.lit(False)))
    tools = main.filter(F.col("block_type").isin("tool_use", "tool_result")
                        & F.col("tool_id").isNotNull())
    is_call = ((F.col("block_type") == "tool_use") & F.col("tool_name").isNotNull()
               & F.col("input_json").startswith("{"))
    first_call = tools.filter(is_call).groupBy("session_id", "tool_id").agg(
        F.min(F.struct(*ORDER)).alias("call_at"))
    results = tools.filter(F.col("block_type") == "tool_result").select(
        "session_id", "tool_id", "uuid", "line_no", F.struct(*ORDER).alias("at"))
    linked = results.join(first_call, ["session_id", "tool_id"]).filter(
        F.col("call_at") < F.col("at")).select("session_id", "line_no").distinct()
    only = messages.filter(
        (F.size("blocks") > 0)
        & F.forall("blocks", lambda b: b["block_type"].eqNullSafe("tool_result")))
    return only.select("session_id", "line_no", "uuid").join(
        linked, ["session_id", "line_no"], "left_semi")


def visible_messages(messages: DataFrame, blocks: DataFrame) -> DataFrame:
    """Main-stream messages without those whose results are shown at their call."""
    main = messages.filter(~F.coalesce("is_sidechain", F.lit(False)))
    hidden = hidden_result_messages(messages, blocks).select("session_id", "uuid").distinct()
    return main.join(hidden, ["session_id", "uuid"], "left_anti")
