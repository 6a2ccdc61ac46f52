"""Message timelines: roles, density, anomalies, annotations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.dates import SECOND, iso_text
from logloom.functions.text import strip
from logloom.operators.segments import with_neighbours
from logloom.operators.sessions import main_stream

S = "session_id"
BUCKETS = 72
STALL_SECONDS = 600


def timeline_role() -> Column:
    """user / tool / model, from the role and the blocks of a message."""
    calls = F.coalesce(F.exists("blocks", lambda b: b["block_type"] == "tool_use"), F.lit(False))
    return (F.when(F.col("role") == "user", F.lit("user")).when(calls, F.lit("tool"))
            .otherwise(F.lit("model")))


def is_technical() -> Column:
    """Meta messages, session markers and bare token counts."""
    one = F.size("blocks") == 1
    only = F.try_element_at("blocks", F.lit(1))
    text = F.lower(strip(F.when(
        one & only["block_type"].isin("string", "text"), only["text"])))
    return (F.coalesce("is_meta", F.lit(False))
            | F.coalesce(text.startswith("session_meta"), F.lit(False))
            | F.coalesce((text == "token_count") & F.col("has_usage"), F.lit(False)))


def timeline_density(messages: DataFrame, buckets: int = BUCKETS, size: int | None = None) -> DataFrame:
    """Weight per (session, bucket, role): seconds to the next message, kept in [1, 1200]."""
    main = main_stream(messages).select(S, "line_no", "ts_us", timeline_role().alias("role"))
    rows = with_neighbours(main, [S], following={"next_us": "ts_us"}, position="i", total="n",
                           size=size)
    wait = F.coalesce(F.col("next_us") - F.col("ts_us"), F.lit(1000)) / SECOND
    weight = F.least(F.greatest(wait, F.lit(1.0)), F.lit(2.0 * STALL_SECONDS))
    place = F.floor(F.col("i") / F.greatest(F.col("n") - 1, F.lit(1)) * (buckets - 1))
    return rows.groupBy(S, place.alias("bucket"), "role").agg(
        F.count("*").alias("messages"), F.sum(weight).alias("weight_seconds"))


def timeline_anomalies(messages: DataFrame, size: int | None = None) -> DataFrame:
    """Model stalls and failed tool results on the main stream."""
    failed = F.coalesce(F.exists("blocks", lambda b: (b["block_type"] == "tool_result")
                                 & F.coalesce(b["is_error"], F.lit(False))), F.lit(False))
    main = main_stream(messages).select(S, "line_no", "uuid", "timestamp", "ts_us", "role",
                                        failed.alias("failed"))
    rows = with_neighbours(main, [S], previous={"prev_us": "ts_us"}, position="message_index",
                           size=size)
    gap = (F.col("ts_us") - F.col("prev_us")) / SECOND
    stall = (gap >= STALL_SECONDS) & (F.col("role") == "assistant")
    label = F.concat(F.lit("Model stall "), F.floor(gap + 0.5).cast("string"), F.lit("s"))
    found = F.array_compact(F.array(
        F.when(stall, F.struct(F.lit("model_stall").alias("type"), label.alias("label"))),
        F.when(F.col("failed"), F.struct(F.lit("tool_error").alias("type"),
                                         F.lit("Tool error").alias("label")))))
    return rows.select(S, "line_no", "uuid", "timestamp", "message_index",
                       F.explode(found).alias("a")).select("*", "a.*").drop("a")


# Subagent types and the tool-name parts that reveal them, in order.
AGENT_HINTS = [("Explore", ["explore", "glob", "grep"]), ("Bash", ["bash", "command"]),
               ("Plan", ["plan"]), ("test-runner", ["test"])]


def subagent_types(blocks: DataFrame) -> DataFrame:
    """Type per (session, agent) from its first telling tool call, else other."""
    side = blocks.filter(F.col("is_sidechain") & (F.length("agent_id") > 0))
    name = F.lower(F.when(F.col("block_type") == "tool_use", F.col("tool_name")))
    told = F.coalesce(*[F.when(name.rlike("|".join(parts)), F.lit(kind))
                        for kind, parts in AGENT_HINTS])
    at = F.when(told.isNotNull(), F.struct("line_no", "block_no"))
    return side.groupBy(S, "agent_id").agg(
        F.coalesce(F.min_by(told, at), F.lit("other")).alias("agent_type"))


def annotations(errors: DataFrame, gaps: DataFrame, compacts: DataFrame | None = None) -> DataFrame:
    """One stream of key moments of all sessions: errors, timeouts, idle gaps, compactions."""
    def rows(df: DataFrame, kind: str, severity: str, source: str, label, detail, reference):
        return df.select(
            S, "line_no", "ts_us", iso_text(F.col("ts_us")).alias("timestamp"),
            F.lit(kind).alias("annotation_type"), F.lit(severity).alias("severity"),
            F.lit(source).alias("source"), label.alias("label"), detail.alias("detail"),
            reference.cast("string").alias("reference_id"))

    seconds = F.concat(F.floor(F.col("gap_us") / SECOND).cast("string"), F.lit("s"))
    parts = [
        rows(errors, "tool_error", "error", "tool", F.col("summary"), F.col("detail_snippet"),
             F.col("tool_call_id")),
        rows(gaps.filter("is_timeout"), "model_timeout", "warning", "model",
             F.concat(F.lit("Model timeout "), seconds), F.lit(None).cast("string"), F.col("uuid")),
        rows(gaps.filter(F.col("gap_kind") == "inactive"), "inactivity_gap", "warning", "user",
             F.concat(F.lit("Inactive "), seconds), F.lit(None).cast("string"), F.col("uuid")),
    ]
    if compacts is not None:
        parts.append(rows(
            compacts, "compact", "info", "system",
            F.concat(F.lit("Context compacted ("), F.col("trigger"), F.lit(")")),
            F.concat(F.col("pre_tokens").cast("string"), F.lit(" tokens before")), F.lit(None)))
    return reduce(DataFrame.unionByName, parts)


def select_annotations(notes: DataFrame, types: list[str] | None = None,
                       severity: str | None = None, source: str | None = None,
                       start_us: int | None = None, end_us: int | None = None) -> DataFrame:
    """Optional filters of the annotation stream, in time order."""
    test = F.lit(True)
    if types:
        test = test & F.col("annotation_type").isin(types)
    for name, want in (("severity", severity), ("source", source)):
        test = test & (F.col(name) == want) if want else test
    test = test & (F.col("ts_us") >= start_us) if start_us is not None else test
    test = test & (F.col("ts_us") <= end_us) if end_us is not None else test
    return notes.filter(test).orderBy("ts_us", S, "line_no")
