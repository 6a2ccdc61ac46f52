"""Statistics per session: one wide row plus long-form child tables.

Nothing per session is gathered into one row unless its size is fixed: tools, errors,
commands and distributions stay in child tables keyed by session_id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.dates import SECOND, iso_text, micros_date
from logloom.functions.errors import category_of_rule, error_rule
from logloom.functions.text import (
    char_classes,
    error_snippet,
    error_summary,
    shell_base_commands,
    tool_group,
)
from logloom.operators.attribution import INACTIVITY, MODEL_TIMEOUT, with_gaps
from logloom.operators.pairing import pair_tools

S = "session_id"
CLASSES = ["cjk", "latin", "digit", "space", "other"]


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom as a double, null on a zero or null bottom."""
    return top.cast("double") / F.when(bottom != 0, bottom.cast("double"))


def times(value: Column, factor: int) -> Column:
    """value * factor as a double; the product may be beyond BIGINT, as with gaps from 1970 to today."""
    return (value.cast("decimal(20,0)") * F.lit(factor)).cast("double")


def zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).cast("bigint")


def message_totals(gaps: DataFrame) -> DataFrame:
    """Counts, token sums, first / last time and time by kind in one aggregation."""
    kind = F.col("record_type")
    has_result = F.coalesce("has_tool_result", F.lit(False))

    def tokens(name: str) -> Column:
        return F.sum(zero(name))

    def spent(name: str) -> Column:
        return F.sum(F.when(F.col("gap_kind") == name, F.col("gap_us")).otherwise(0))

    return gaps.groupBy(S).agg(
        F.count("*").alias("message_count"),
        F.count_if(kind == "user").alias("user_message_count"),
        F.count_if(kind == "assistant").alias("assistant_message_count"),
        F.count_if(~kind.isin("user", "assistant")).alias("other_message_count"),
        F.count_if((kind == "user") & ~has_result).alias("user_interaction_count"),
        tokens("input_tokens").alias("total_input_tokens"),
        tokens("output_tokens").alias("total_output_tokens"),
        tokens("cache_read_tokens").alias("cache_read_tokens"),
        tokens("cache_creation_tokens").alias("cache_creation_tokens"),
        F.min("ts_us").alias("first_us"),
        F.max("ts_us").alias("last_us"),
        *[spent(k).alias(f"{k}_us") for k in ("model", "tool", "user", "inactive")],
        F.count_if("is_timeout").alias("model_timeout_count"),
    )


def char_totals(blocks: DataFrame) -> DataFrame:
    """Characters by producer and by class."""
    is_result = F.col("block_type") == "tool_result"
    spoken = F.col("block_type").isin("text", "thinking", "string")
    text = F.when(is_result, F.col("result_text")).when(spoken, F.col("text"))
    producer = (
        F.when(is_result, F.lit("tool"))
        .when(F.col("record_type") == "assistant", F.lit("model"))
        .when(F.col("record_type") == "user", F.lit("user"))
    )
    counted = blocks.select(S, producer.alias("producer"), text.alias("t")).filter(
        F.length("t") > 0).select(S, "producer", char_classes(F.col("t")).alias("c"))
    by = {p: F.sum(F.when(F.col("producer") == p, F.col("c.total")).otherwise(0))
          for p in ("user", "model", "tool")}
    return counted.groupBy(S).agg(
        *[c.alias(f"{p}_chars") for p, c in by.items()],
        *[F.sum(f"c.{n}").alias(f"{n}_chars") for n in CLASSES],
    ).withColumn("total_chars", F.col("user_chars") + F.col("model_chars") + F.col("tool_chars"))


def tool_stats(blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per (session, tool): calls, tokens, outcomes and matched latency."""
    uses = blocks.filter(F.col("block_type") == "tool_use").groupBy(
        S, F.coalesce("tool_name", F.lit("unknown")).alias("tool_name")).agg(
        F.count("*").alias("calls"),
        F.sum("usage_tokens").alias("total_tokens"))
    # one pass over the results: an orphan id counts once, id-less orphans count each
    per_id = pairs.groupBy(S, F.col("name").alias("tool_name"), "tool_id").agg(
        F.count_if(~F.col("matched")).alias("unmatched"),
        F.count_if(F.col("is_error").eqNullSafe(False)).alias("success_count"),
        F.count_if(F.col("is_error").eqNullSafe(True)).alias("error_count"),
        F.sum("latency_us").alias("latency_us"),
        F.count("latency_us").alias("latency_count"))
    orphans = F.when(F.col("tool_id") == "", F.col("unmatched")).otherwise(
        F.least("unmatched", F.lit(1)))
    outcomes = per_id.withColumn("calls", orphans).drop("tool_id", "unmatched")
    measures = ["calls", "total_tokens", "success_count", "error_count", "latency_us",
                "latency_count"]
    both = uses.unionByName(outcomes, allowMissingColumns=True)
    return both.groupBy(S, "tool_name").agg(
        *[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in measures]
    ).withColumn("tool_group", tool_group(F.col("tool_name"))).withColumn(
        "avg_latency_seconds",
        F.coalesce(ratio(F.col("latency_us"), F.col("latency_count") * SECOND), F.lit(0.0)),
    )


def tool_group_stats(tools: DataFrame) -> DataFrame:
    """Per (session, group): re-aggregated tools; the mean latency is per call."""
    return tools.groupBy(S, "tool_group").agg(
        *[F.sum(m).alias(m) for m in
          ("calls", "total_tokens", "success_count", "error_count", "latency_us")],
        F.count("*").alias("tool_count"),
    ).withColumn("avg_latency_seconds",
                 F.coalesce(ratio(F.col("latency_us"), F.col("calls") * SECOND), F.lit(0.0)))


def tool_success(tools: DataFrame) -> DataFrame:
    """Success rate per (session, tool), 1.0 when no result was seen, and tokens per call."""
    seen = F.col("success_count") + F.col("error_count")
    return tools.select(
        S, "tool_name", "calls", "total_tokens", "error_count",
        F.coalesce(ratio(F.col("success_count"), seen), F.lit(1.0)).alias("success_rate"),
        F.coalesce(ratio(F.col("total_tokens"), F.col("calls")), F.lit(0.0)).alias("avg_tokens"),
    )


def top_tools_by_session(tools: DataFrame, n: int = 5, by: str = "calls") -> DataFrame:
    """The n largest tools of each session by calls (or error_count, errors only)."""
    rows = tools.filter(F.col("error_count") > 0) if by == "error_count" else tools
    order = Window.partitionBy(S).orderBy(F.col(by).desc(), "tool_name")
    return rows.withColumn("tool_rank", F.row_number().over(order)).filter(F.col("tool_rank") <= n)


def error_records(pairs: DataFrame) -> DataFrame:
    """One row per failed tool result."""
    detail = F.coalesce("result_text", F.lit(""))
    rows = pairs.filter(F.col("is_error")).withColumn("rule", error_rule(detail))
    return rows.select(
        S, "line_no", "block_no", "ts_us", F.col("name").alias("tool_name"),
        F.when(F.col("tool_id") != "", F.col("tool_id")).alias("tool_call_id"),
        category_of_rule(F.col("rule")).alias("category"),
        F.col("rule").alias("matched_rule"),
        error_summary(detail).alias("summary"),
        error_snippet(detail).alias("detail_snippet"),
        detail.alias("detail"),
    )


def error_categories(errors: DataFrame) -> DataFrame:
    return errors.groupBy(S, "category").agg(F.count("*").alias("errors"))


def shell_calls(blocks: DataFrame) -> DataFrame:
    """Shell tool calls with their base commands."""
    calls = blocks.filter((F.col("block_type") == "tool_use") & (F.col("tool_name") == "Bash"))
    return calls.withColumn(
        "commands", F.coalesce(shell_base_commands(F.col("command")), F.array().cast("array<string>")))


def shell_distribution(blocks: DataFrame) -> DataFrame:
    """Calls by number of commands in the call, with the display band 1 / 2 / 3 / 4+."""
    n = F.size("commands")
    return shell_calls(blocks).groupBy(S, n.alias("commands_per_call")).agg(
        F.count("*").alias("calls")
    ).withColumn("band", F.when(F.col("commands_per_call") >= 4, F.lit("4+")).otherwise(
        F.col("commands_per_call").cast("string")))


def shell_commands(blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per (session, command): count, and an equal share of latency and output characters."""
    counts = shell_calls(blocks).select(S, F.explode("commands").alias("command_name")).groupBy(
        S, "command_name").agg(F.count("*").alias("calls"))
    done = pairs.filter((F.col("name") == "Bash") & (F.size("call_commands") > 0))
    n = F.size("call_commands")
    shares = done.select(
        S, F.explode("call_commands").alias("command_name"),
        (F.col("latency_us") / n).alias("latency_us"),
        F.floor(F.coalesce("output_chars", F.lit(0)) / n).alias("output_chars"),
    ).groupBy(S, "command_name").agg(
        F.sum("latency_us").alias("latency_us"), F.sum("output_chars").alias("output_chars"))
    both = counts.unionByName(shares, allowMissingColumns=True).groupBy(S, "command_name").agg(
        *[F.sum(m).alias(m) for m in ("calls", "latency_us", "output_chars")])
    seconds = F.coalesce(F.col("latency_us") / SECOND, F.lit(0.0))
    chars = F.coalesce("output_chars", F.lit(0)).cast("bigint")
    return both.select(
        S, "command_name", zero("calls").alias("calls"),
        seconds.alias("latency_seconds"),
        F.coalesce(ratio(seconds, F.col("calls")), F.lit(0.0)).alias("avg_latency_seconds"),
        chars.alias("output_chars"),
        F.coalesce(ratio(chars, F.col("calls")), F.lit(0.0)).alias("avg_output_chars"),
    )


def subagents(messages: DataFrame) -> DataFrame:
    """Per (session, agent): message span, tokens and the parent message."""
    side = messages.filter(F.col("is_sidechain") & (F.length("agent_id") > 0))
    first = F.struct("ts_us", "line_no")
    return side.groupBy(S, "agent_id").agg(
        F.count("*").alias("messages"),
        F.min("ts_us").alias("start_us"),
        F.when(F.count("*") > 1, F.max("ts_us")).alias("end_us"),
        F.sum(zero("input_tokens") + zero("output_tokens")).alias("tokens"),
        F.coalesce(F.min_by(F.coalesce("parent_uuid", F.lit("")), first), F.lit(""))
        .alias("parent_uuid"),
    ).withColumn("agent_type", F.lit("other"))


def sidechain_links(messages: DataFrame) -> DataFrame:
    """Side-chain groups joined to the message that started them."""
    side = messages.filter(F.col("is_sidechain") & (F.length("agent_id") > 0))
    parent = F.when(F.length("parent_uuid") > 0, F.col("parent_uuid")).otherwise(F.lit("root"))
    groups = side.groupBy(S, parent.alias("parent_uuid"), "agent_id").agg(
        F.count("*").alias("messages"), F.min("line_no").alias("first_line"))
    parents = messages.select(S, F.col("uuid").alias("parent_uuid"),
                              F.col("line_no").alias("parent_line"))
    return groups.join(parents, [S, "parent_uuid"], "left")


def session_metadata(messages: DataFrame) -> DataFrame:
    """First-line project, branch, version and user type; first and last line times."""
    facts = F.struct("cwd", "git_branch", "version", "user_type", "ts_us", "ecosystem",
                     "source_path")
    rows = messages.groupBy(S).agg(
        F.min_by(facts, "line_no").alias("f"),
        F.max_by("ts_us", "line_no").alias("updated_us"),
        F.count("*").alias("total_messages"),
        F.sum(zero("input_tokens") + zero("output_tokens")).alias("total_tokens"),
    )
    folder = F.regexp_replace("f.source_path", r"/[^/]*\z", "")
    cwd = F.when(F.length("f.cwd") > 0, F.col("f.cwd"))
    version = F.when(F.length("f.version") > 0, F.col("f.version"))
    return rows.select(
        S, F.col("f.ecosystem").alias("ecosystem"), F.col("f.source_path").alias("source_path"),
        F.coalesce(cwd, folder).alias("project_path"),
        F.col("f.git_branch").alias("git_branch"),
        F.coalesce(version, F.lit("unknown")).alias("version"),
        F.col("f.user_type").alias("user_type"),
        F.col("f.ts_us").alias("created_us"), "updated_us",
        iso_text(F.col("f.ts_us")).alias("created_at"),
        iso_text(F.col("updated_us")).alias("updated_at"),
        micros_date(F.col("f.ts_us")).alias("created_date"),
        "total_messages", "total_tokens",
    )


def models_used(messages: DataFrame) -> DataFrame:
    """Distinct models per session, long form."""
    return messages.filter(F.length("model") > 0).select(S, "model").distinct()


def session_display(sessions: DataFrame) -> DataFrame:
    """Status and span shown for a session."""
    return sessions.select(
        S,
        F.when(F.col("updated_us").isNotNull(), F.lit("completed")).otherwise(F.lit("active"))
        .alias("status"),
        (F.col("updated_us") - F.col("created_us")).alias("span_us"),
    )


def bottleneck(stats_percent: dict[str, Column], span: Column) -> Column:
    """Largest of the three one-decimal percents; ties go to Model, then Tool."""
    m, t, u = (F.round(stats_percent[k], 1) for k in ("model", "tool", "user"))
    label = (F.when((m >= t) & (m >= u), F.lit("Model"))
             .when(t >= u, F.lit("Tool")).otherwise(F.lit("User")))
    return F.when(span > 0, label)


def automation_ratio(tool_calls: Column, interactions: Column, span: Column) -> Column:
    return F.when((span > 0) & (interactions > 0), F.round(tool_calls / interactions, 2))


def _derived(s: DataFrame, inactivity: float, model_timeout: float) -> DataFrame:
    """Ratios, percents and rates from the summed columns. Nothing is rounded."""
    active = F.col("model_us") + F.col("tool_us") + F.col("user_us")
    span = active + F.col("inactive_us")
    every = (F.col("total_input_tokens") + F.col("total_output_tokens")
             + F.col("cache_read_tokens") + F.col("cache_creation_tokens"))
    pct = {k: F.when(span > 0, F.coalesce(ratio(times(F.col(f"{k}_us"), 100), active), F.lit(0.0)))
           for k in ("model", "tool", "user")}
    cache = F.col("cache_read_tokens") + F.col("cache_creation_tokens")
    rates = {
        "avg": F.col("total_tokens"), "read": F.col("total_input_tokens"),
        "output": F.col("total_output_tokens"), "cache": cache,
        "cache_read": F.col("cache_read_tokens"),
        "cache_creation": F.col("cache_creation_tokens"),
    }
    return s.select(
        "*",
        (F.col("last_us") - F.col("first_us")).alias("duration_us"),
        ((F.col("last_us") - F.col("first_us")) / SECOND).alias("duration_seconds"),
        active.alias("active_us"), span.alias("span_us"),
        *[c.alias(f"{k}_time_percent") for k, c in pct.items()],
        ratio(times(F.col("inactive_us"), 100), span).alias("inactive_time_percent"),
        ratio(active, span).alias("active_time_ratio"),
        F.when(span > 0, F.coalesce(
            ratio(times(F.col("user_interaction_count"), 3600 * SECOND), active), F.lit(0.0))
        ).alias("interactions_per_hour"),
        F.lit(float(inactivity)).alias("inactivity_threshold_seconds"),
        F.lit(float(model_timeout)).alias("model_timeout_threshold_seconds"),
        *[ratio(times(F.col(c), 100), every).alias(f"{n}_percent") for n, c in (
            ("input", "total_input_tokens"), ("output", "total_output_tokens"),
            ("cache_read", "cache_read_tokens"), ("cache_creation", "cache_creation_tokens"))],
        ratio(F.col("total_output_tokens") + F.col("tool_tokens"), F.col("total_input_tokens"))
        .alias("user_yield_ratio_tokens"),
        ratio(F.col("model_chars") + F.col("tool_chars"), F.col("user_chars"))
        .alias("user_yield_ratio_chars"),
        *[ratio(times(c, SECOND), F.col("model_us")).alias(f"{n}_tokens_per_second")
          for n, c in rates.items()],
        F.coalesce(ratio(F.col("total_tokens"), F.col("message_count")), F.lit(0.0))
        .alias("avg_tokens_per_message"),
        ratio(F.col("shell_sub_commands"), F.col("shell_calls")).alias("avg_commands_per_call"),
        bottleneck(pct, span).alias("bottleneck"),
        automation_ratio(F.col("total_tool_calls"), F.col("user_interaction_count"), span)
        .alias("automation_ratio"),
    )


def session_statistics(
    messages: DataFrame,
    blocks: DataFrame,
    *,
    compacts: DataFrame | None = None,
    file_sizes: DataFrame | None = None,
    inactivity: float = INACTIVITY,
    model_timeout: float = MODEL_TIMEOUT,
    pairs: DataFrame | None = None,
    tools: DataFrame | None = None,
) -> DataFrame:
    """The wide statistics row of every session."""
    pairs = pairs if pairs is not None else pair_tools(blocks)
    tools = tools if tools is not None else tool_stats(blocks, pairs)
    parts = [
        message_totals(with_gaps(messages, inactivity, model_timeout)),
        char_totals(blocks),
        tools.groupBy(S).agg(
            F.sum("calls").alias("total_tool_calls"), F.sum("total_tokens").alias("tool_tokens"),
            F.sum("success_count").alias("tool_success_count"),
            F.sum("error_count").alias("tool_error_count"),
            F.sum("latency_us").alias("tool_latency_us")),
        shell_calls(blocks).groupBy(S).agg(
            F.count("*").alias("shell_calls"),
            F.sum(F.size("commands")).alias("shell_sub_commands")),
        subagents(messages).groupBy(S).agg(F.count("*").alias("subagent_count")),
    ]
    if compacts is not None:
        parts.append(compacts.groupBy(S).agg(F.count("*").alias("compact_count")))
    if file_sizes is not None:
        parts.append(file_sizes.groupBy(S).agg(F.max("file_size").alias("trajectory_file_size_bytes")))
    joined = reduce(lambda a, b: a.join(b, S, "left"), parts)
    for name in ("compact_count", "trajectory_file_size_bytes"):
        if name not in joined.columns:
            joined = joined.withColumn(name, F.lit(0).cast("bigint"))
    counts = [c for p in parts[1:] for c in p.columns if c != S]
    counts = list(dict.fromkeys([*counts, "compact_count", "trajectory_file_size_bytes"]))
    filled = joined.select(*parts[0].columns, *[zero(c).alias(c) for c in counts])
    filled = filled.withColumn(
        "total_tokens", F.col("total_input_tokens") + F.col("total_output_tokens"))
    return _derived(filled, inactivity, model_timeout)


def session_rows(metadata: DataFrame, stats: DataFrame,
                 lineage: DataFrame | None = None) -> DataFrame:
    """The sessions table: metadata, lineage ids and the headline numbers."""
    head = stats.select(S, "duration_seconds", "total_tool_calls", "bottleneck",
                        "automation_ratio")
    rows = metadata.join(head, S, "left")
    if lineage is not None:
        rows = rows.join(lineage.select(S, "parent_session_id", "root_session_id"), S, "left")
    else:
        rows = rows.withColumns({"parent_session_id": F.lit(None).cast("string"),
                                 "root_session_id": F.lit(None).cast("string")})
    return rows.withColumns({
        "physical_session_id": F.col(S),
        "logical_session_id": F.coalesce("root_session_id", "parent_session_id", F.col(S)),
    })
