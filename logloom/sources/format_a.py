"""Format A: one record per line, with an embedded message."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.dates import iso_micros
from logloom.functions.errors import flag_of_word
from logloom.schemas import BLOCK
from logloom.sources import variants as js

# The record types and roles a line may keep, and the todo states.
RECORD_TYPES = ["user", "assistant", "file-history-snapshot", "summary"]
ROLES = ["user", "assistant", "system"]
TODO_STATES = ["pending", "in_progress", "completed"]
COMPACTION = "compact_boundary"


@dataclass
class Normalized:
    """Messages, compaction events and rejected files of a set of lines."""

    messages: DataFrame
    compacts: DataFrame
    errors: DataFrame
    lineage: DataFrame | None = None
    diagnostics: DataFrame | None = None
    facts: DataFrame | None = None


def coerce_role(raw: Column, line_type: Column) -> Column:
    role = F.lower(F.trim(raw))
    return (F.when(role.isin(ROLES), role).when(line_type == "user", F.lit("user"))
            .otherwise(F.lit("assistant")))


def coerce_record_type(line_type: Column, role: Column) -> Column:
    return (F.when(line_type.isin(RECORD_TYPES), line_type)
            .when(role == "user", F.lit("user")).otherwise(F.lit("assistant")))


def error_flag(b: Column) -> Column:
    """Tri-state flag of a tool result; a missing field means no error."""
    kind = js.kind_of(b, "$.is_error")
    return (F.when(kind.isNull(), F.lit(False))
            .when(kind == "BOOLEAN", js.get(b, "$.is_error", "boolean"))
            .when(kind == "STRING", flag_of_word(js.get(b, "$.is_error", "string")))
            .when(kind == "VOID", F.lit(None).cast("boolean"))
            .otherwise(js.get(b, "$.is_error", "double") != 0))


def _id(b: Column, path: str) -> Column:
    return F.coalesce(js.get(b, path, "string"), F.lit(""))


def block_of(b: Column) -> Column:
    """A content block as the common struct."""
    null = F.lit(None)

    def build(told: Column) -> Column:
        names = [f.split(":")[0].strip() for f in BLOCK.replace("\n", " ")[7:-1].split(", ")]

        def block(**parts: Column) -> Column:
            return F.struct(*[parts.get(n, null).alias(n) for n in names]).cast(BLOCK)

        name = F.coalesce(js.get(b, "$.name", "string"),
                          F.when(js.kind_of(b, "$.name") == "VOID", F.lit("None")), F.lit("unknown"))
        use = block(block_type=told, tool_name=name, tool_id=_id(b, "$.id"),
                    command=js.string(b, "$.input.command"),
                    param_keys=F.map_keys(js.fields(b, "$.input")),
                    input_json=F.to_json(js.get(b, "$.input")))
        result = js.let(js.bounded_output(b, "$.content"), lambda out: block(
            block_type=told, tool_name=js.string(b, "$.tool_name"), tool_id=_id(b, "$.tool_use_id"),
            is_error=error_flag(b), result_text=out["text"], result_string=out["plain"],
            output_chars=out["chars"]))
        text = js.text_of(b)
        untyped = F.when(told.isNull() & text.isNotNull(), F.lit("text")).otherwise(told)
        return (F.when(told == "tool_use", use).when(told == "tool_result", result)
                .when(told == "thinking", block(block_type=told, text=js.string(b, "$.thinking")))
                .otherwise(block(block_type=untyped,
                                 text=F.when(F.coalesce(untyped, F.lit("")) == "text", text))))

    return js.let(js.string(b, "$.type"), build)


def string_block(text: Column) -> Column:
    null = F.lit(None)
    return F.struct(
        F.lit("string").alias("block_type"), text.alias("text"),
        *[null.alias(n) for n in ("tool_name", "tool_id", "command", "param_keys", "input_json",
                                  "is_error", "result_text", "result_string", "output_chars")],
    ).cast(BLOCK)


NO_BLOCKS = f"array<{BLOCK}>"


def content_blocks(v: Column, path: str) -> Column:
    """Blocks of a content field that is a string or a list; other list items are dropped."""
    list_ = js.items(v, path)
    objects = F.filter(list_, lambda b: js.fields(b, "$").isNotNull())
    text = F.when(list_.isNull(), js.string(v, path))
    return (F.when(list_.isNotNull(), F.transform(objects, block_of))
            .when(F.length(text) > 0, F.array(string_block(text)))
            .otherwise(F.array().cast(NO_BLOCKS)))


def _details(v: Column) -> Column:
    """Rarely used fields, type-checked, as one JSON text."""
    def todo(t: Column) -> Column:
        return F.struct(js.string(t, "$.content").alias("content"),
                        js.string(t, "$.status").alias("status"),
                        js.string(t, "$.activeForm").alias("activeForm"))

    todos = F.filter(F.transform(js.items(v, "$.todos"), todo), lambda t: (
        t["content"].isNotNull() & t["status"].isin(TODO_STATES) & t["activeForm"].isNotNull()))
    return F.to_json(F.struct(
        js.string(v, "$.permissionMode").alias("permission_mode"),
        js.string(v, "$.messageId").alias("message_id"),
        js.string(v, "$.leafUuid").alias("leaf_uuid"),
        js.boolean(v, "$.isSnapshotUpdate").alias("is_snapshot_update"),
        js.integer(v, "$.thinkingMetadata.maxThinkingTokens").alias("max_thinking_tokens"),
        js.string(v, "$.message.id").alias("model_message_id"),
        js.string(v, "$.message.stop_reason").alias("stop_reason"),
        js.string(v, "$.message.stop_sequence").alias("stop_sequence"),
        F.when(F.size(todos) > 0, todos).alias("todos"),
        js.fields(v, "$.snapshot").alias("snapshot")))


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?\z", 1)


def rejected_files(rows: DataFrame) -> DataFrame:
    """Files with a line that is no JSON, or a kept line whose timestamp cannot be read."""
    reason = F.when(F.col("kind") == "bad", F.lit("invalid JSON")).when(
        F.col("kept") & F.col("ts_us").isNull(), F.lit("invalid timestamp"))
    return rows.select("source_path", "line_no", reason.alias("reason")).filter(
        "reason IS NOT NULL").groupBy("source_path").agg(
        F.min("line_no").alias("line_no"), F.min_by("reason", "line_no").alias("reason"))


def normalize_a(lines: DataFrame, ecosystem: str = "format_a") -> Normalized:
    """Messages and compaction events from lines (source_path, line_no, value or v + kind)."""
    decoded = lines if "v" in lines.columns else js.decode(lines)
    v = F.col("v")
    timestamp, missing = js.timestamp_or_line(v, F.col("line_no"))
    ids = (js.string(v, "$.sessionId").alias("line_session_id"), js.string(v, "$.uuid").alias("uuid"))
    base = decoded.filter(F.col("kind") != "blank").select(
        "source_path", "line_no", "kind", "v", *ids, timestamp.alias("timestamp"),
        missing.alias("inferred_ts"), js.string(v, "$.type").alias("_type"),
        (js.string(v, "$.subtype") == COMPACTION).alias("_compact"))
    base = base.withColumns({
        "ts_us": iso_micros(F.col("timestamp")),
        "kept": (F.col("kind") == "object") & F.col("line_session_id").isNotNull()
        & F.col("uuid").isNotNull()})
    errors = rejected_files(base)
    good = base.filter(F.col("kind") == "object").join(
        errors.select("source_path"), "source_path", "left_anti")

    has_message = F.greatest(*[js.get(v, f"$.message.{f}").isNotNull() for f in (
        "content", "role", "usage", "model")])
    role = coerce_role(js.string(v, "$.message.role"), F.col("_type"))
    usage = js.fields(v, "$.message.usage").isNotNull()

    def count(name: str, default: int | None) -> Column:
        n = js.whole_number(v, f"$.message.usage.{name}")
        return F.when(usage, F.coalesce(n, F.lit(default)) if default is not None else n)

    blocks = content_blocks(v, "$.message.content")
    messages = good.filter("kept").select(
        F.lit(ecosystem).alias("ecosystem"), "source_path",
        file_stem(F.col("source_path")).alias("session_id"), "line_session_id", "line_no", "uuid",
        "timestamp", "ts_us", "inferred_ts",
        coerce_record_type(F.col("_type"), role).alias("record_type"),
        F.when(has_message, role).alias("role"),
        js.string(v, "$.parentUuid").alias("parent_uuid"), js.string(v, "$.userType").alias("user_type"),
        js.string(v, "$.cwd").alias("cwd"), js.string(v, "$.version").alias("version"),
        js.string(v, "$.gitBranch").alias("git_branch"),
        js.boolean(v, "$.isSidechain").alias("is_sidechain"), js.string(v, "$.agentId").alias("agent_id"),
        js.boolean(v, "$.isMeta").alias("is_meta"), js.string(v, "$.message.model").alias("model"),
        usage.alias("has_usage"), count("input_tokens", 0).alias("input_tokens"),
        count("output_tokens", 0).alias("output_tokens"),
        count("cache_creation_input_tokens", None).alias("cache_creation_tokens"),
        count("cache_read_input_tokens", None).alias("cache_read_tokens"),
        F.when(usage, js.string(v, "$.message.usage.service_tier")).alias("service_tier"),
        js.string(v, "$.summary").alias("summary"), _details(v).alias("details_json"),
        blocks.alias("blocks"),
    )
    messages = messages.withColumns({
        "content_string": F.coalesce(
            F.exists("blocks", lambda b: b["block_type"] == "string"), F.lit(False))
        | (F.size("blocks") == 0),
        "has_tool_result": F.coalesce(
            F.exists("blocks", lambda b: b["block_type"] == "tool_result"), F.lit(False)),
    })
    compacts = good.filter("_compact").select(
        F.lit(ecosystem).alias("ecosystem"), "source_path",
        file_stem(F.col("source_path")).alias("session_id"), "line_no", "timestamp", "ts_us",
        F.coalesce(js.get(v, "$.compactMetadata.trigger", "string"), F.lit("unknown")).alias("trigger"),
        F.coalesce(js.get(v, "$.compactMetadata.preTokens", "bigint"), F.lit(0)).alias("pre_tokens"))
    return Normalized(messages, compacts, errors)


def scan_compacts(lines: DataFrame) -> DataFrame:
    """Compaction events only: lines without the marker are never parsed."""
    return normalize_a(lines.filter(F.col("value").contains(COMPACTION))).compacts
