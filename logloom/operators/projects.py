"""Project comparison and the project x period swimlane."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions.dates import period_key
from logloom.functions.text import project_name
from logloom.operators.overview import total

P = "project_path"


def _path():
    return F.coalesce(P, F.lit("")).alias(P)


def _all_projects(rows: DataFrame) -> DataFrame:
    by = rows.groupBy(_path()).agg(
        F.count("*").alias("sessions"), total("total_tokens"),
        F.coalesce(F.avg("active_time_ratio"), F.lit(0.0)).alias("active_ratio"),
        F.avg("user_yield_ratio_tokens").alias("leverage_tokens_mean"),
        F.avg("user_yield_ratio_chars").alias("leverage_chars_mean"))
    return by.select(P, project_name(F.col(P)).alias("project_name"), "sessions", "total_tokens",
                     "active_ratio", "leverage_tokens_mean", "leverage_chars_mean")


def project_comparison(rows: DataFrame, limit: int = 10) -> DataFrame:
    """Projects by tokens, then sessions; a limit of 0 keeps all."""
    ordered = _all_projects(rows).orderBy(
        F.col("total_tokens").desc(), F.col("sessions").desc(), P)
    return ordered.limit(limit) if limit > 0 else ordered


def project_count(rows: DataFrame) -> DataFrame:
    return rows.select(_path()).distinct().agg(F.count("*").alias("total_projects"))


def project_swimlane(rows: DataFrame, interval: str = "day", project_limit: int = 12) -> DataFrame:
    """Sparse cells of the top projects."""
    top = project_comparison(rows, project_limit).select(P)
    dated = rows.withColumn(P, _path()).filter(F.col("created_date").isNotNull())
    return dated.join(top, P, "left_semi").groupBy(
        P, period_key(F.col("created_date"), interval).alias("period")
    ).agg(
        F.count("*").alias("sessions"), total("total_tokens").alias("tokens"),
        F.coalesce(F.avg("active_time_ratio"), F.lit(0.0)).alias("active_ratio"),
        F.avg("user_yield_ratio_tokens").alias("leverage_tokens_mean"),
    ).withColumn("project_name", project_name(F.col(P)))


def swimlane_frame(rows: DataFrame, interval: str = "day", project_limit: int = 12) -> DataFrame:
    """Periods in use, and how many projects the limit leaves out of the swimlane."""
    left_out = project_count(rows).select(
        F.greatest(F.col("total_projects") - project_limit, F.lit(0)).alias("truncated_projects")
        if project_limit > 0 else F.lit(0).cast("bigint").alias("truncated_projects"))
    periods = project_swimlane(rows, interval, project_limit).select("period").distinct()
    return periods.withColumn("truncated_projects", left_out.scalar()).orderBy("period")
