"""Cross-session overview, distributions and time series.

Inputs are analytics rows: logical sessions joined to their statistics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.dates import SECOND, night_micros, period_key
from logloom.functions.text import ecosystem_label, project_name, strip
from logloom.operators.ranks import summarize
from logloom.operators.session_stats import ratio

S = "session_id"
ROLES = ("model", "tool", "user")


def total(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0)).cast("bigint").alias(name)


def percent_of(part: Column, whole: Column) -> Column:
    return F.coalesce(ratio(part * 100, whole), F.lit(0.0))


def share(name: str) -> Column:
    """Percent of a column's sum over a frame of a few fixed keys (roles, bands, sources)."""
    return percent_of(F.col(name), F.sum(name).over(Window.partitionBy()))


def whole(rows: DataFrame, measure: Column) -> Column:
    """One aggregate over all rows as a scalar, for shares over keys without a bound."""
    return rows.agg(measure).scalar()


def overview_totals(rows: DataFrame) -> DataFrame:
    """Counts, tokens by kind, characters, bytes, times and the active ratio."""
    sums = [
        "total_messages", "total_tokens", "total_tool_calls", "total_input_tokens",
        "total_output_tokens", "tool_tokens", "cache_read_tokens", "cache_creation_tokens",
        "trajectory_file_size_bytes", "total_chars", "user_chars", "model_chars", "tool_chars",
        "cjk_chars", "latin_chars", "other_chars", "model_us", "tool_us", "user_us",
        "inactive_us", "model_timeout_count",
    ]
    return rows.agg(
        F.count("*").alias("sessions"), *[total(c) for c in sums],
        F.coalesce(F.avg("automation_ratio"), F.lit(0.0)).alias("avg_automation_ratio"),
        F.coalesce(F.avg("duration_seconds"), F.lit(0.0)).alias("avg_duration_seconds"),
    ).withColumn("active_time_ratio", F.coalesce(ratio(
        F.col("model_us") + F.col("tool_us") + F.col("user_us"),
        F.col("model_us") + F.col("tool_us") + F.col("user_us") + F.col("inactive_us")),
        F.lit(0.0)))


def with_recomputed(rows: DataFrame) -> DataFrame:
    """Fill missing ratios and rates from the stored sums."""
    cache = F.coalesce("cache_read_tokens", F.lit(0)) + F.coalesce("cache_creation_tokens", F.lit(0))
    sums = {"avg": F.col("stat_total_tokens") if "stat_total_tokens" in rows.columns
            else F.col("total_tokens"),
            "read": F.col("total_input_tokens"), "output": F.col("total_output_tokens"),
            "cache": cache, "cache_read": F.col("cache_read_tokens"),
            "cache_creation": F.col("cache_creation_tokens")}
    fixed = {
        "user_yield_ratio_tokens": F.coalesce("user_yield_ratio_tokens", F.when(
            F.col("total_input_tokens") > 0,
            ratio(F.col("total_output_tokens") + F.col("tool_tokens"), F.col("total_input_tokens")))),
        "user_yield_ratio_chars": F.coalesce("user_yield_ratio_chars", F.when(
            F.col("user_chars") > 0,
            ratio(F.col("model_chars") + F.col("tool_chars"), F.col("user_chars")))),
    }
    for name, top in sums.items():
        col = f"{name}_tokens_per_second"
        fixed[col] = F.coalesce(col, F.when(F.col("model_us") > 0, ratio(
            F.coalesce(top, F.lit(0)) * SECOND, F.col("model_us"))))
    return rows.withColumns(fixed)


# The measures summarised in the overview.
MEASURES = ["user_yield_ratio_tokens", "user_yield_ratio_chars", "avg_tokens_per_second",
            "read_tokens_per_second", "output_tokens_per_second", "cache_tokens_per_second",
            "cache_read_tokens_per_second", "cache_creation_tokens_per_second"]


def yield_and_throughput(rows: DataFrame) -> DataFrame:
    """Mean, median and nearest-rank p90 of every ratio and rate, one row per measure."""
    long = with_recomputed(rows).unpivot([], MEASURES, "measure", "value")
    return summarize(long)


def bottleneck_label(unknown: bool) -> Column:
    """Title-case label; with `unknown`, labels other than the three roles become Unknown."""
    label = F.initcap(strip(F.coalesce(F.nullif("bottleneck", F.lit("")), F.lit("Unknown"))))
    if not unknown:
        return label
    return F.when(label.isin("Model", "Tool", "User"), label).otherwise(F.lit("Unknown"))


def bottleneck_distribution(rows: DataFrame) -> DataFrame:
    counted = rows.groupBy(bottleneck_label(True).alias("key")).agg(
        F.count("*").alias("sessions"))
    return counted.withColumn("percent", share("sessions")).orderBy(
        F.col("sessions").desc(), "key")


def top_projects(rows: DataFrame, limit: int = 10) -> DataFrame:
    """Largest projects by sessions, then tokens, with shares and mean leverage."""
    fixed = with_recomputed(rows)
    by = fixed.groupBy(F.coalesce("project_path", F.lit("")).alias("project_path")).agg(
        F.count("*").alias("sessions"), total("total_tokens"), total("total_messages"),
        F.avg("user_yield_ratio_tokens").alias("leverage_tokens_mean"),
        F.avg("user_yield_ratio_chars").alias("leverage_chars_mean"))
    return by.select(
        "project_path", project_name(F.col("project_path")).alias("project_name"), "sessions",
        "total_tokens", "total_messages", "leverage_tokens_mean", "leverage_chars_mean",
    ).orderBy(F.col("sessions").desc(), F.col("total_tokens").desc(), "project_path").limit(
        limit).withColumns({
            "percent_sessions": percent_of(F.col("sessions"), whole(rows, F.count("*"))),
            "percent_tokens": percent_of(F.col("total_tokens"),
                                         whole(rows, F.sum("total_tokens")))})


def _tool_use(rows: DataFrame, tools: DataFrame) -> DataFrame:
    """Per tool: calls, sessions, errors and latency; tools is unique per (session, tool)."""
    name = strip(F.coalesce("tool_name", F.lit("")))
    kept = tools.join(rows.select(S), S, "left_semi").groupBy(S, name.alias("tool_name")).agg(
        *[F.sum(c).alias(c) for c in ("calls", "error_count", "latency_us")])
    return kept.filter(F.length("tool_name") > 0).groupBy("tool_name").agg(
        total("calls"), F.count("*").alias("sessions"), total("error_count"), total("latency_us"))


def top_tools(rows: DataFrame, tools: DataFrame, limit: int = 15) -> DataFrame:
    used = _tool_use(rows, tools)
    return used.select(
        "tool_name", "calls", "sessions", "error_count",
        F.coalesce(ratio(F.col("latency_us"), F.col("calls") * SECOND), F.lit(0.0))
        .alias("avg_latency_seconds"),
    ).orderBy(F.col("calls").desc(), "tool_name").limit(limit).withColumn(
        "percent_calls", percent_of(F.col("calls"), whole(used, F.sum("calls"))))


def call_weighted_latency(tools: DataFrame) -> DataFrame:
    """Mean of the per-tool mean latencies, weighted by calls, per session."""
    weighted = F.sum(F.col("avg_latency_seconds") * F.col("calls"))
    return tools.groupBy(S).agg(
        F.coalesce(ratio(weighted, F.sum("calls")), F.lit(0.0)).alias("avg_latency_seconds"))


def source_breakdown(rows: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    active = F.col("model_us") + F.col("tool_us") + F.col("user_us")
    by = rows.groupBy("ecosystem").agg(
        F.count("*").alias("sessions"), total("total_tokens"), total("total_tool_calls"),
        F.coalesce(F.sum(active), F.lit(0)).alias("active_us"))
    return by.select(
        "ecosystem", ecosystem_label(F.col("ecosystem"), labels).alias("label"), "sessions",
        "total_tokens", "total_tool_calls", "active_us",
        share("sessions").alias("percent_sessions"), share("total_tokens").alias("percent_tokens"),
    ).orderBy(F.col("total_tokens").desc(), F.col("sessions").desc(), "ecosystem")


def role_source_matrix(rows: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    """Time, tokens, calls and errors per (ecosystem, role); the first row is the bottleneck."""
    sums = rows.groupBy("ecosystem").agg(*[total(c) for c in (
        "model_us", "tool_us", "user_us", "total_input_tokens", "total_output_tokens",
        "cache_read_tokens", "cache_creation_tokens", "tool_tokens", "total_tool_calls",
        "tool_error_count", "model_timeout_count")])
    cells = sums.selectExpr("ecosystem", """stack(3,
        'model', model_us, total_output_tokens + cache_read_tokens + cache_creation_tokens,
                 cast(0 as bigint), model_timeout_count,
        'tool', tool_us, tool_tokens, total_tool_calls, tool_error_count,
        'user', user_us, total_input_tokens, cast(0 as bigint), cast(0 as bigint))
        as (role, time_us, token_count, tool_calls, error_count)""")
    label = ecosystem_label(F.col("ecosystem"), labels)
    return cells.select(
        "ecosystem", "role", F.concat_ws(":", label, F.initcap("role")).alias("label"),
        "time_us", share("time_us").alias("time_percent"),
        "token_count", share("token_count").alias("token_percent"),
        "tool_calls", share("tool_calls").alias("tool_call_percent"),
        "error_count", share("error_count").alias("error_percent"),
    ).orderBy(*[F.col(c).desc() for c in ("time_us", "token_count", "tool_calls")],
              "ecosystem", "role")


def session_span() -> Column:
    """Session length in micros: its duration, else the sum of its attributed times."""
    parts = [F.coalesce(f"{k}_us", F.lit(0)) for k in ("model", "tool", "user", "inactive")]
    component = parts[0] + parts[1] + parts[2] + parts[3]
    own = F.coalesce("duration_us", F.lit(0))
    return F.when(own > 0, own).otherwise(component)


def day_night_times(rows: DataFrame, tz: str = "UTC") -> DataFrame:
    """Summed times split into day and night, each session pro rata of its span."""
    span = session_span()
    night = F.when((span > 0) & F.col("created_us").isNotNull(),
                   night_micros(F.col("created_us"), span, tz) / span).otherwise(F.lit(0.0))
    split = rows.withColumn("_night", night)
    kinds = (*ROLES, "inactive")

    def spent(kind: str, part: Column) -> Column:
        return F.coalesce(F.sum(F.coalesce(f"{kind}_us", F.lit(0)) * part), F.lit(0.0)) / SECOND

    return split.agg(
        *[spent(k, 1 - F.col("_night")).alias(f"day_{k}_seconds") for k in kinds],
        *[spent(k, F.col("_night")).alias(f"night_{k}_seconds") for k in kinds])


def day_night_shares(times: DataFrame, include_inactive: bool = True) -> DataFrame:
    """Day and night totals and their share, with or without inactive time."""
    def whole(p: str) -> str:
        names = [f"{p}_{k}_seconds" for k in ROLES] + (
            [f"{p}_inactive_seconds"] if include_inactive else [])
        return " + ".join(names)

    rows = times.selectExpr(
        f"stack(2, 'Day', {whole('day')}, 'Night', {whole('night')}) as (period, total_seconds)")
    everything = F.sum("total_seconds").over(Window.partitionBy())
    return rows.withColumn(
        "share", F.coalesce(ratio(F.col("total_seconds"), everything), F.lit(0.0)))


def code_line_estimate(totals: DataFrame, fraction: float = 0.3,
                       tokens_per_line: float = 10.0) -> DataFrame:
    """Lines of code the produced tokens stand for."""
    part = fraction if fraction > 0 else 0.0
    per_line = tokens_per_line if tokens_per_line > 0 else 10.0
    budget = F.col("total_output_tokens") + F.col("tool_tokens")
    return totals.select(
        budget.alias("output_budget_tokens"), (budget * part).alias("effective_coding_tokens"),
        (budget * part / per_line).alias("estimated_code_lines"))


DIMENSIONS = ("bottleneck", "project", "branch", "automation_band", "tool", "session_token_share")


def distribution(rows: DataFrame, dimension: str, tools: DataFrame | None = None) -> DataFrame:
    """(key, label, sessions, value, percent) for one dimension, largest value first."""
    if dimension == "tool":
        out = _tool_use(rows, tools).select(
            F.col("tool_name").alias("key"), F.col("tool_name").alias("label"),
            "sessions", F.col("calls").alias("value"))
    elif dimension == "session_token_share":
        out = rows.select(
            F.col(S).alias("key"), F.substring(S, 1, 8).alias("label"),
            F.lit(1).cast("bigint").alias("sessions"),
            F.coalesce("total_tokens", F.lit(0)).alias("value"))
        top = out.orderBy(F.col("value").desc(), "key").limit(20)
        return top.withColumn("percent", percent_of(F.col("value"), whole(out, F.sum("value"))))
    else:
        empty = {"project": "(unknown)", "branch": "(none)"}
        if dimension == "bottleneck":
            key = bottleneck_label(False)
        elif dimension in empty:
            name = {"project": "project_path", "branch": "git_branch"}[dimension]
            key = F.coalesce(F.nullif(name, F.lit("")), F.lit(empty[dimension]))
        elif dimension == "automation_band":
            r = F.coalesce("automation_ratio", F.lit(0.0))
            key = (F.when(r < 1, F.lit("0-1")).when(r < 3, F.lit("1-3"))
                   .when(r < 5, F.lit("3-5")).otherwise(F.lit("5+")))
        else:
            raise ValueError(f"unsupported dimension: {dimension}")
        label = project_name(F.col("key")) if dimension == "project" else F.col("key")
        out = rows.groupBy(key.alias("key")).agg(F.count("*").alias("sessions"))
        out = out.select(
            F.lower("key").alias("key") if dimension == "bottleneck" else "key",
            label.alias("label"), "sessions", F.col("sessions").alias("value"))
    everything = whole(out, F.sum("value")) if dimension == "tool" else whole(rows, F.count("*"))
    out = out.orderBy(F.col("value").desc(), "key")
    out = out.limit(20) if dimension == "tool" else out
    return out.withColumn("percent", percent_of(F.col("value"), everything))


def timeseries(rows: DataFrame, interval: str = "day") -> DataFrame:
    """Sessions, tokens, calls and means per day or ISO week of creation."""
    dated = rows.filter(F.col("created_date").isNotNull())
    return dated.groupBy(period_key(F.col("created_date"), interval).alias("period")).agg(
        F.count("*").alias("sessions"), total("total_tokens").alias("tokens"),
        total("total_tool_calls").alias("tool_calls"),
        F.coalesce(F.avg("automation_ratio"), F.lit(0.0)).alias("avg_automation_ratio"),
        F.coalesce(F.avg("duration_seconds"), F.lit(0.0)).alias("avg_duration_seconds"),
    ).orderBy("period")
