"""Per-session analytics, computed for all sessions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.dates import SECOND
from logloom.operators.session_stats import ratio, top_tools_by_session, tool_success, zero

S = "session_id"


def all_tokens() -> Column:
    return (zero("input_tokens") + zero("output_tokens") + zero("cache_creation_tokens")
            + zero("cache_read_tokens"))


def token_heatmap(messages: DataFrame) -> DataFrame:
    """Tokens with cache, per message that reports usage."""
    return messages.filter("has_usage").select(
        S, "line_no", "timestamp", "uuid", F.col("role").alias("message_type"),
        all_tokens().alias("tokens"), zero("input_tokens").alias("input_tokens"),
        zero("output_tokens").alias("output_tokens"),
        zero("cache_read_tokens").alias("cache_read_tokens"),
        zero("cache_creation_tokens").alias("cache_creation_tokens"))


def heatmap_summary(heatmap: DataFrame) -> DataFrame:
    """Per session: total, first peak and the covered range, in file order."""
    stamped = F.when(F.length("timestamp") > 0, F.col("line_no"))
    by_peak = F.struct(F.col("tokens"), -F.col("line_no"))
    out = heatmap.groupBy(S).agg(
        F.count("*").alias("points"), F.sum("tokens").alias("total_tokens"),
        F.max("tokens").alias("peak_tokens"), F.max_by("timestamp", by_peak).alias("_peak"),
        F.min_by("timestamp", stamped).alias("range_start"),
        F.max_by("timestamp", stamped).alias("range_end"))
    return out.withColumn(
        "peak_at", F.when(F.col("peak_tokens") > 0, F.col("_peak")).otherwise(F.lit(""))).drop("_peak")


def expensive_operations(messages: DataFrame, blocks: DataFrame, limit: int = 10) -> DataFrame:
    """Costliest tool calls, subagent messages and large messages of each session."""
    agent = F.length(F.coalesce("agent_id", F.lit(""))) > 0
    calls = blocks.filter(F.col("has_usage") & (F.col("block_type") == "tool_use")).select(
        S, "line_no", "block_no", "uuid", "timestamp", F.lit("tool_call").alias("type"),
        F.coalesce("tool_name", F.lit("unknown")).alias("name"), F.col("all_tokens").alias("tokens"))
    last = F.lit(2**31 - 1).alias("block_no")
    used = messages.filter("has_usage").withColumn("tokens", all_tokens())
    whole = used.filter(agent | (F.col("tokens") > 1000)).select(
        S, "line_no", last, "uuid", "timestamp",
        F.when(agent, F.lit("subagent")).otherwise(F.lit("message")).alias("type"),
        F.when(agent, F.concat(F.lit("Subagent "), F.col("agent_id")))
        .otherwise(F.concat(F.col("role"), F.lit(" message"))).alias("name"), "tokens")
    # a rank filter is applied before the shuffle too, so a huge session sends few rows
    order = Window.partitionBy(S).orderBy(F.col("tokens").desc(), "line_no", "block_no")
    ranked = calls.unionByName(whole).withColumn("cost_rank", F.row_number().over(order))
    return ranked.filter(F.col("cost_rank") <= limit).drop("block_no")


def tool_patterns(tools: DataFrame) -> DataFrame:
    """Tokens per call, success rate and mean latency per (session, tool)."""
    rates = tool_success(tools)
    latency = tools.select(S, "tool_name", F.nullif("avg_latency_seconds", F.lit(0.0))
                           .alias("avg_latency_seconds"))
    return rates.join(latency, [S, "tool_name"])


def tool_parameters(blocks: DataFrame) -> DataFrame:
    """How often each parameter is set, per (session, tool); a tool's own calls only."""
    calls = blocks.filter(F.col("block_type") == "tool_use")
    keys = calls.select(S, F.coalesce("tool_name", F.lit("unknown")).alias("tool_name"),
                        F.explode("param_keys").alias("parameter"))
    return keys.groupBy(S, "tool_name", "parameter").agg(F.count("*").alias("uses"))


# The English sentences of advice, anomalies and recommendations from here on are
# part of the results and must read exactly so.

def subagent_efficiency(agents: DataFrame) -> DataFrame:
    """Means, tokens per minute and a score per (session, agent type), with real durations."""
    seconds = F.coalesce(F.col("end_us") - F.col("start_us"), F.lit(0)) / SECOND
    by = agents.groupBy(S, "agent_type").agg(
        F.count("*").alias("invocations"), F.avg("messages").alias("avg_messages"),
        F.avg("tokens").alias("avg_tokens"), F.avg(seconds).alias("avg_duration_seconds"))
    rate = F.when(F.col("avg_duration_seconds") > 0,
                  F.col("avg_tokens") / F.col("avg_duration_seconds") * 60).otherwise(F.lit(0.0))
    score = F.least(F.lit(100), F.floor(F.col("tokens_per_minute") / 1000 * 100 + 0.5))
    kind = F.col("agent_type")
    advice = F.array_compact(F.array(
        F.when(F.col("efficiency_score") < 30,
               F.concat(F.lit("Consider optimizing "), kind, F.lit(" agent usage"))),
        F.when(F.col("avg_tokens") > 10_000,
               F.concat(kind, F.lit(" uses high token count - review task complexity"))),
        F.when(F.col("avg_duration_seconds") > 60,
               F.concat(kind, F.lit(" takes long to complete - consider breaking down tasks")))))
    return (by.withColumn("tokens_per_minute", rate)
            .withColumn("efficiency_score", score.cast("bigint"))
            .withColumn("recommendations", advice))


def _js_round(c: Column) -> Column:
    return F.floor(c + 0.5).cast("bigint")


def anomalies(heatmap: DataFrame, patterns: DataFrame) -> DataFrame:
    """Token spikes, unreliable tools and costly tools, with severity and impact."""
    means = heatmap.groupBy(S).agg(F.avg("tokens").alias("mean"))
    spikes = heatmap.select(S, "tokens").join(means, S).filter(
        F.col("tokens") > F.col("mean") * 3).groupBy(S).agg(
        F.count("*").alias("n"), F.sum(F.col("tokens") - F.col("mean")).alias("wasted"))
    text = F.col("n").cast("string")
    spike_rows = spikes.select(
        S, F.lit("token_spike").alias("type"),
        F.when(F.col("n") > 5, F.lit("high")).otherwise(F.lit("medium")).alias("severity"),
        F.concat(F.lit("Detected "), text, F.lit(" token usage spikes (>3x average)")).alias("description"),
        F.lit("Session messages").alias("component"), F.col("wasted").alias("tokens_wasted"),
        F.lit(None).cast("bigint").alias("error_count"),
        F.lit("Review messages with high token usage and optimize prompts").alias("recommendation"))
    failing = 1 - F.col("success_rate")
    name = F.col("tool_name")
    error_rows = patterns.filter((F.col("success_rate") < 0.7) & (F.col("calls") > 3)).select(
        S, F.lit("high_error_rate").alias("type"),
        F.when(F.col("success_rate") < 0.5, F.lit("high")).otherwise(F.lit("medium")).alias("severity"),
        F.concat(F.lit('Tool "'), name, F.lit('" has '), _js_round(failing * 100).cast("string"),
                 F.lit("% error rate")).alias("description"),
        name.alias("component"), F.lit(None).cast("double").alias("tokens_wasted"),
        _js_round(F.col("calls") * failing).alias("error_count"),
        F.concat(F.lit("Review and fix error conditions for "), name).alias("recommendation"))
    costly_rows = patterns.filter((F.col("avg_tokens") > 5000) & (F.col("calls") > 5)).select(
        S, F.lit("inefficient_tool").alias("type"),
        F.when(F.col("avg_tokens") > 10_000, F.lit("high")).otherwise(F.lit("medium")).alias("severity"),
        F.concat(F.lit('Tool "'), name, F.lit('" uses '), _js_round(F.col("avg_tokens")).cast("string"),
                 F.lit(" tokens per call on average")).alias("description"),
        name.alias("component"),
        _js_round(F.col("avg_tokens") * F.col("calls") * 0.3).cast("double").alias("tokens_wasted"),
        F.lit(None).cast("bigint").alias("error_count"),
        F.concat(F.lit("Optimize "), name, F.lit(" usage or consider alternative approaches"))
        .alias("recommendation"))
    return spike_rows.unionByName(error_rows).unionByName(costly_rows)


def recommendations(stats: DataFrame, found: DataFrame, tools: DataFrame,
                    efficiency: DataFrame) -> DataFrame:
    """Usage advice per session, one row each."""
    top = top_tools_by_session(tools, 5).groupBy(S).agg(F.sum("total_tokens").alias("tool_sum"))
    weak = efficiency.filter(F.col("efficiency_score") < 40).groupBy(S).agg(F.count("*").alias("weak"))
    facts = stats.join(top, S, "left").join(weak, S, "left")
    cache = F.coalesce(ratio(F.col("cache_read_tokens"), F.col("total_input_tokens")), F.lit(0.0))

    def advice(test: Column, category: str, priority: str, title: str, saved: Column | None = None):
        return F.when(test, F.struct(
            F.lit(category).alias("category"), F.lit(priority).alias("priority"),
            F.lit(title).alias("title"),
            (saved if saved is not None else F.lit(None)).cast("double").alias("token_savings")))

    rules = F.array_compact(F.array(
        advice((cache < 0.1) & (F.col("total_input_tokens") > 10_000), "cost", "high",
               "Low cache utilization detected", _js_round(F.col("total_input_tokens") * 0.5)),
        advice(F.coalesce("tool_sum", F.lit(0)) > F.col("total_tokens") * 0.5, "efficiency",
               "medium", "Tool calls dominate token usage"),
        advice(F.coalesce("weak", F.lit(0)) > 0, "performance", "medium",
               "Inefficient subagent usage detected"),
        advice(F.col("total_tokens") > 100_000, "cost", "medium", "High token usage session")))
    by_rule = facts.select(S, F.explode(rules).alias("r")).select(S, "r.*")
    severe = found.filter(F.col("severity") == "high").select(
        S, F.lit("performance").alias("category"), F.lit("high").alias("priority"),
        F.col("description").alias("title"),
        F.nullif("tokens_wasted", F.lit(0.0)).alias("token_savings"))
    return by_rule.unionByName(severe)


def compare_sessions(pairs: DataFrame, stats: DataFrame) -> DataFrame:
    """Differences and insights for every (a, b) of a pair table."""
    facts = ("total_tokens", "message_count", "total_tool_calls", "duration_seconds")
    a = stats.select(F.col(S).alias("a"), *[F.col(c).alias(f"a_{c}") for c in facts])
    b = stats.select(F.col(S).alias("b"), *[F.col(c).alias(f"b_{c}") for c in facts])
    both = pairs.join(a, "a").join(b, "b")

    def diff(c: str) -> Column:
        return F.coalesce(f"a_{c}", F.lit(0)) - F.coalesce(f"b_{c}", F.lit(0))

    def density(p: str) -> Column:
        return F.coalesce(ratio(F.col(f"{p}_message_count"), F.col(f"{p}_total_tokens")), F.lit(0.0))

    tokens = diff("total_tokens")
    out = both.select(
        "a", "b", tokens.alias("tokens_diff"),
        F.coalesce(ratio(tokens * 100, F.when(F.col("b_total_tokens") > 0, F.col("b_total_tokens"))),
                   F.lit(0.0)).alias("tokens_diff_percent"),
        diff("message_count").alias("message_diff"), diff("total_tool_calls").alias("tool_calls_diff"),
        diff("duration_seconds").alias("duration_diff"),
        (density("a") - density("b")).alias("efficiency_diff"))
    word = lambda c: F.when(F.col(c) > 0, F.lit(" more ")).otherwise(F.lit(" fewer "))
    pct, msgs, eff = F.col("tokens_diff_percent"), F.col("message_diff"), F.col("efficiency_diff")
    return out.withColumn("insights", F.array_compact(F.array(
        F.when(F.abs(pct) > 20, F.concat(
            F.lit("Session 1 uses "), F.abs(_js_round(pct)).cast("string"), F.lit("%"),
            word("tokens_diff"), F.lit("tokens"))),
        F.when(F.abs(msgs) > 5, F.concat(
            F.lit("Session 1 has "), F.abs(msgs).cast("string"), word("message_diff"), F.lit("messages"))),
        F.when(eff > 0.0001, F.lit("Session 1 is more efficient (fewer tokens per message)"))
        .when(eff < -0.0001, F.lit("Session 2 is more efficient (fewer tokens per message)")))))


def metric_diff(a: Column, b: Column) -> Column:
    """Struct of b - a, its percent of a, and whether that passes 20 %."""
    pct = F.coalesce(ratio((b - a) * 100, a), F.lit(0.0))
    return F.struct((b - a).alias("value"), pct.alias("percent"), (F.abs(pct) > 20).alias("is_large"))
