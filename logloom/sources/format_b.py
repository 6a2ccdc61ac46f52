"""Format B: an envelope of timestamp, type and payload per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.dates import SECOND, iso_micros
from logloom.functions.errors import (
    json_is_error,
    structured_is_error,
    status_is_error,
    status_is_pending,
    text_is_error,
)
from logloom.functions.text import non_blank, prompt_key, spaced_json, strip, uuid_tail
from logloom.plans.staging import stage
from logloom.schemas import BLOCK
from logloom.sources import variants as js
from logloom.sources.format_a import NO_BLOCKS, Normalized, file_stem, rejected_files, string_block
from logloom.sources.prompts import PIECE, match_prompts

# Envelope types that are kept.
TOP_TYPES = ["session_meta", "response_item", "event_msg", "turn_context", "compacted"]
DEFAULT_SOURCE = "codex"

# What becomes of each kind of event.
SUPPORTED, STORED, IGNORED = "supported", "stored_not_used_yet", "ignored_expected"
COVERAGE = {
    "session_meta": SUPPORTED,
    "turn_context": STORED,
    "compacted": STORED,
    "event_msg:user_message": SUPPORTED,
    "event_msg:token_count": SUPPORTED,
    "event_msg:agent_message": SUPPORTED,
    "event_msg:agent_reasoning": STORED,
    "event_msg:task_started": STORED,
    "event_msg:task_complete": STORED,
    "event_msg:turn_aborted": STORED,
    "event_msg:context_compacted": STORED,
    "event_msg:item_completed": STORED,
    "event_msg:turn_context": STORED,
    "response_item:message": SUPPORTED,
    "response_item:function_call": SUPPORTED,
    "response_item:custom_tool_call": SUPPORTED,
    "response_item:function_call_output": SUPPORTED,
    "response_item:custom_tool_call_output": SUPPORTED,
    "response_item:web_search_call": SUPPORTED,
    "response_item:reasoning": STORED,
    "<unknown_top_level>": IGNORED,
}

# Places and spellings of lineage ids, in order of preference.
LINEAGE_PLACES = ["$", "$.lineage", "$.source", "$.source.lineage", "$.source.thread_spawn",
                  "$.source.subagent", "$.source.subagent.thread_spawn"]
PARENT_KEYS = ["parent_session_id", "parent_thread_id", "parent_id", "parentSessionId",
               "parentThreadId"]
ROOT_KEYS = ["root_session_id", "root_thread_id", "root_id", "rootSessionId", "rootThreadId"]

# Fields of a web search that are kept, and where its id and status may be.
SEARCH_FIELDS = ["query", "status", "state", "outcome", "result_status", "message", "summary"]
SEARCH_IDS = ["$.call_id", "$.id", "$.tool_call_id", "$.request_id"]
SEARCH_STATUS = ["$.status", "$.state", "$.outcome", "$.result_status"]
SEARCH_TOOL = "web_search_call"
RESULT_IDS = ["$.call_id", "$.id", "$.tool_call_id"]
SUMMARY_FIELDS = ["$.message", "$.summary", "$.reason", "$.status"]


def _block(**parts: Column) -> Column:
    names = ("block_type", "text", "tool_name", "tool_id", "command", "param_keys", "input_json",
             "is_error", "result_text", "result_string", "output_chars")
    return F.struct(*[parts.get(n, F.lit(None)).alias(n) for n in names]).cast(BLOCK)


def summarize_payload(p: Column) -> Column:
    """First non-blank text of the usual fields, else the payload type."""
    def candidate(path: str) -> Column:
        texts = F.transform(js.items(p, path), lambda x: non_blank(js.string(x, "$.text")))
        listed = F.try_element_at(F.array_compact(texts), F.lit(1))
        return F.coalesce(non_blank(js.string(p, path)), listed)

    return F.coalesce(*[candidate(f) for f in SUMMARY_FIELDS], js.get(p, "$.type", "string"),
                      F.lit("event"))


def text_content(p: Column, path: str) -> Column:
    """Blocks of text-only content: one text is a plain string, several stay blocks."""
    plain = js.string(p, path)
    texts = F.array_compact(F.transform(js.items(p, path), lambda b: js.string(b, "$.text")))
    single = F.coalesce(plain, F.when(F.size(texts) == 1, texts[0]))
    many = F.transform(texts, lambda t: _block(block_type=F.lit("text"), text=t))
    return (F.when(F.length(single) > 0, F.array(string_block(single)))
            .when(single.isNull() & (F.size(texts) > 1), many)
            .otherwise(F.array().cast(NO_BLOCKS)))


def _embedded_json(text: Column) -> Column:
    """Variant of a string that holds an object or a list, else null."""
    t = strip(text)
    return F.when(t.rlike(r"^[{\[]"), F.try_parse_json(t))


def call_block(p: Column, call_id: Column) -> Column:
    """tool_use from a call; arguments that are no object are wrapped."""
    custom = js.string(p, "$.type") == "custom_tool_call"
    raw = F.when(custom, js.get(p, "$.input")).otherwise(js.get(p, "$.arguments"))
    text = js.string(raw, "$")
    parsed = _embedded_json(text)
    value = F.when(text.isNull(), raw).otherwise(parsed)
    members = js.fields(value, "$")
    wrapped = F.when(text.isNotNull() & parsed.isNull(), F.to_json(F.struct(text.alias("raw")))).otherwise(
        F.concat(F.lit('{"value":'), F.coalesce(F.to_json(value), F.lit("null")), F.lit("}")))
    lone = F.when(text.isNotNull() & parsed.isNull(), F.array(F.lit("raw"))).otherwise(
        F.array(F.lit("value")))
    return _block(
        block_type=F.lit("tool_use"), tool_id=call_id,
        tool_name=F.coalesce(js.string(p, "$.name"), F.lit("unknown_tool")),
        command=F.when(members.isNotNull(), js.string(value, "$.command")),
        param_keys=F.when(members.isNotNull(), F.map_keys(members)).otherwise(lone),
        input_json=F.when(members.isNotNull(), F.to_json(value)).otherwise(wrapped))


def lineage_ids(p: Column) -> tuple[Column, Column]:
    """(parent, root) from the first place that names one."""
    def first(keys: list[str]) -> Column:
        return js.first_text(p, [f"{place}.{k}" for place in LINEAGE_PLACES for k in keys])

    return first(PARENT_KEYS), first(ROOT_KEYS)


def coverage_key(v: Column) -> Column:
    top = F.coalesce(F.nullif(js.get(v, "$.type", "string"), F.lit("")), F.lit("<missing_top_level>"))
    sub = non_blank(js.string(v, "$.payload.type"))
    return F.when(sub.isNotNull(), F.concat(top, F.lit(":"), sub)).otherwise(top)


def _events(lines: DataFrame) -> DataFrame:
    """One row per non-blank line with its envelope fields."""
    decoded = lines if "v" in lines.columns else js.decode(lines)
    v = F.col("v")
    timestamp, missing = js.timestamp_or_line(v, F.col("line_no"))
    rows = decoded.filter(F.col("kind") != "blank").select(
        "source_path", "line_no", "kind", "v", js.string(v, "$.type").alias("top"),
        js.get(v, "$.payload").alias("p"), js.string(v, "$.payload.type").alias("sub"),
        timestamp.alias("timestamp"), missing.alias("inferred_ts"))
    own = uuid_tail(file_stem(F.col("source_path")))
    meta = F.when(F.col("top") == "session_meta", js.string(F.col("p"), "$.id"))
    return rows.withColumns({
        "ts_us": iso_micros(F.col("timestamp")), "path_id": own, "sid": F.coalesce(meta, own),
        "known": F.coalesce((F.col("kind") == "object") & F.col("top").isin(TOP_TYPES), F.lit(False)),
    })


def _mapping() -> Column:
    """Which message an event becomes, null for none."""
    top, sub, p = F.col("top"), F.col("sub"), F.col("p")
    event, item = top == "event_msg", top == "response_item"
    last, total = js.fields(p, "$.info.last_token_usage"), js.fields(p, "$.info.total_token_usage")
    usable = (F.size(F.coalesce(last, F.create_map().cast("map<string,variant>"))) > 0) | total.isNotNull()
    return (
        F.when(top == "session_meta", F.lit("meta"))
        .when(event & (sub == "user_message"), F.lit("user"))
        .when(event & (sub == "token_count") & usable, F.lit("tok"))
        .when(event & (sub == "agent_message"), F.lit("agent"))
        .when(item & (sub == "message"), F.lit("msg"))
        .when(item & sub.isin("function_call", "custom_tool_call"), F.lit("call"))
        .when(item & sub.isin("function_call_output", "custom_tool_call_output"), F.lit("result"))
        .when(item & (sub == "web_search_call"), F.lit("search"))
    )


def _results(rows: DataFrame) -> DataFrame:
    """Add verdict and bounded output of results and searches.

    Codes, flags and status words of structured output are read by built-in expressions; only
    output that these leave open is walked in Python, all else passes a null.
    """
    p, sub, mapped = F.col("p"), F.col("sub"), F.col("mapped")
    text = F.when(mapped == "result", js.string(p, "$.output"))
    inner = F.when(mapped == "result", F.coalesce(
        _embedded_json(text), F.when(text.isNull(), js.get(p, "$.output"))))
    rows = rows.withColumns({"_text": text, "_inner": inner})
    holder = F.when(mapped == "result", F.col("_inner")).when(mapped == "search", p)
    rows = rows.withColumn("_flat", structured_is_error(holder))
    rows = rows.withColumn("_nested", F.coalesce("_flat", json_is_error(
        F.when(F.col("_flat").isNull(), F.to_json(holder)))))

    status = F.coalesce(*[non_blank(js.string(p, k)) for k in SEARCH_STATUS])
    search_error = F.when(status_is_pending(status), F.lit(None).cast("boolean")).otherwise(
        F.coalesce(F.col("_nested"), status_is_error(status), F.lit(False)))
    result_error = F.coalesce("_nested", text_is_error(F.col("_text")), F.lit(False))

    error = js.get(p, "$.error")
    has_error = F.coalesce(
        F.when(js.kind_of(p, "$.error") == "STRING", F.length(js.get(p, "$.error", "string")) > 0),
        F.size(js.fields(p, "$.error")) > 0, F.size(js.items(p, "$.error")) > 0, F.lit(False))
    found = F.to_json(F.struct(
        F.lit(SEARCH_TOOL).alias("type"),
        *[non_blank(js.string(p, f"$.{f}")).alias(f) for f in SEARCH_FIELDS],
        F.when(has_error, error).alias("error"),
        F.size(js.items(p, "$.results")).alias("result_count")))

    custom = (sub == "custom_tool_call_output") & js.fields(F.col("_inner"), "$").isNotNull()
    unwrapped = js.get(F.col("_inner"), "$.output")
    shown = F.when(custom & unwrapped.isNotNull() & ~F.is_variant_null(unwrapped), unwrapped).otherwise(
        F.coalesce("_inner", js.get(p, "$.output")))
    shown = F.when(mapped == "search", F.try_parse_json(found)).when(mapped == "result", shown)
    rows = rows.withColumn("_shown", shown).withColumn("_out", F.when(
        mapped.isin("result", "search"), js.bounded_output(F.col("_shown"))))
    return rows.withColumn(
        "_error", F.when(mapped == "search", search_error).when(mapped == "result", result_error))


def _to_messages(rows: DataFrame, ecosystem: str) -> DataFrame:
    p, sid, mapped = F.col("p"), F.col("sid"), F.col("mapped")
    line = F.col("line_no").cast("string")

    def tagged(tag: str) -> Column:
        return F.concat(sid, F.lit(f"-{tag}-"), line)

    call_id = F.when(mapped == "call", F.coalesce(js.string(p, "$.call_id"), tagged("call"))).when(
        mapped == "result", F.coalesce(js.first_text(p, RESULT_IDS), tagged("result"))).when(
        mapped == "search", F.coalesce(js.first_text(p, SEARCH_IDS), tagged("web-search")))
    rows = _results(rows.withColumn("_call", call_id))
    call_id = F.col("_call")
    said = js.string(p, "$.role")
    msg_role = F.when(said.isin("user", "assistant", "system"), said).otherwise(F.lit("assistant"))
    role = (F.when(mapped == "msg", msg_role)
            .when(mapped.isin("meta", "user", "result", "search"), F.lit("user"))
            .otherwise(F.lit("assistant")))
    source = F.coalesce(
        js.string(p, "$.source"),
        F.translate(spaced_json(F.to_json(js.get(p, "$.source"))), '"', "'"), F.lit(DEFAULT_SOURCE))
    text = (F.when(mapped == "meta", F.concat(F.lit("session_meta source="), source))
            .when(mapped == "user", F.coalesce(js.string(p, "$.message"), F.lit("")))
            .when(mapped == "tok", F.lit("token_count"))
            .when(mapped == "agent", summarize_payload(p)))
    result = _block(
        block_type=F.lit("tool_result"), tool_id=call_id, is_error=F.col("_error"),
        tool_name=F.when(mapped == "search", F.lit(SEARCH_TOOL)).otherwise(
            non_blank(js.string(p, "$.name"))),
        result_text=F.col("_out.text"), result_string=F.col("_out.plain"),
        output_chars=F.col("_out.chars"))
    blocks = (F.when(mapped == "msg", text_content(p, "$.content"))
              .when(mapped == "call", F.array(call_block(p, call_id)))
              .when(mapped.isin("result", "search"), F.array(result))
              .when(F.length(text) > 0, F.array(string_block(text)))
              .otherwise(F.array().cast(NO_BLOCKS)))
    uuid = (F.when(mapped == "call", call_id)
            .when(mapped == "result", F.concat(call_id, F.lit("-result")))
            .when(mapped == "search", F.concat(call_id, F.lit("-web-search")))
            .otherwise(F.concat(sid, F.lit("-"), mapped, F.lit("-"), line)))
    last = js.fields(p, "$.info.last_token_usage")
    spent = F.when(F.size(last) > 0, js.get(p, "$.info.last_token_usage")).otherwise(
        js.get(p, "$.info.total_token_usage"))
    tok = mapped == "tok"

    def count(name: str) -> Column:
        return F.when(tok, F.coalesce(js.get(spent, f"$.{name}", "bigint"), F.lit(0)))

    null = F.lit(None)
    return rows.select(
        F.lit(ecosystem).alias("ecosystem"), "source_path", "path_id",
        sid.alias("line_session_id"), "line_no", uuid.alias("uuid"), "timestamp", "ts_us",
        "inferred_ts", F.when(role == "user", F.lit("user")).otherwise(F.lit("assistant"))
        .alias("record_type"),
        role.alias("role"), null.cast("string").alias("parent_uuid"),
        F.when((mapped == "msg") & said.isNotNull() & ~said.isin("user", "assistant", "system"),
               F.concat(F.lit("source_role:"), said)).alias("user_type"),
        F.when(mapped == "meta", js.string(p, "$.cwd")).alias("cwd"),
        F.when(mapped == "meta", js.string(p, "$.cli_version")).alias("version"),
        null.cast("string").alias("git_branch"), F.lit(False).alias("is_sidechain"),
        null.cast("string").alias("agent_id"), null.cast("boolean").alias("is_meta"),
        null.cast("string").alias("model"), tok.alias("has_usage"),
        count("input_tokens").alias("input_tokens"), count("output_tokens").alias("output_tokens"),
        null.cast("bigint").alias("cache_creation_tokens"),
        F.when(tok, js.integer(spent, "$.cached_input_tokens")).alias("cache_read_tokens"),
        null.cast("string").alias("service_tier"), null.cast("string").alias("summary"),
        null.cast("string").alias("details_json"), blocks.alias("blocks"),
        (F.coalesce(F.exists(blocks, lambda b: b["block_type"] == "string"), F.lit(False))
         | (F.size(blocks) == 0)).alias("content_string"),
        mapped.isin("result", "search").alias("has_tool_result"),
        F.when(mapped == "user", F.lit("event")).when(mapped == "msg", F.lit("item")).alias("channel"),
    )


def dedupe_prompts(messages: DataFrame, window_seconds: float = 2.0, piece: int = PIECE) -> DataFrame:
    """Drop prompts that came over both channels within the window.

    The event-channel copy wins and takes the place of the other one. Only prompts of one file and
    text that came over both channels can meet; see `prompts` for the rule.
    """
    only = F.try_element_at("blocks", F.lit(1))
    text = F.when((F.size("blocks") == 1) & (only["block_type"] == "string"), only["text"])
    prompts = messages.filter(
        F.col("channel").isNotNull() & (F.col("record_type") == "user") & (F.col("role") == "user")
        & F.col("ts_us").isNotNull()
    ).select("source_path", "line_no", "ts_us", (F.col("channel") == "event").alias("event"), prompt_key(text).alias("k")).filter(
        F.length("k") > 0).withColumn("k", F.sha2("k", 256))
    keys = ["source_path", "k"]
    both = prompts.groupBy(*keys).agg(F.max("event").alias("e"), F.min("event").alias("i")).filter("e and not i").select(*keys)
    moves = match_prompts(prompts.join(both, keys), int(window_seconds * SECOND), piece).select(
        "source_path", "line_no", F.col("place").alias("_place"), F.lit(True).alias("_seen"))
    out = messages.join(moves, ["source_path", "line_no"], "left").filter(
        F.col("_seen").isNull() | F.col("_place").isNotNull())
    return out.withColumn("line_no", F.coalesce("_place", "line_no")).select(*messages.columns)


def file_facts(events: DataFrame) -> DataFrame:
    """Per file: session id and lineage from its session_meta lines."""
    p = F.col("p")
    parent, root = lineage_ids(p)
    meta = events.filter(F.col("known") & (F.col("top") == "session_meta")).select(
        "source_path", "line_no", non_blank(js.string(p, "$.id")).alias("id"),
        parent.alias("parent"), root.alias("root"))

    def first(c: str) -> Column:
        return F.min_by(c, F.when(F.col(c).isNotNull(), F.col("line_no")))

    return meta.groupBy("source_path").agg(
        first("id").alias("meta_id"), first("parent").alias("parent_session_id"),
        first("root").alias("root_session_id"))


def coverage_table(spark) -> DataFrame:
    return spark.createDataFrame(list(COVERAGE.items()), "coverage_key string, status string")


def diagnose(events: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(source_path, section, key, count): what happened to the events of each file."""
    v = F.col("v")
    objects = events.filter(F.col("kind") == "object").select(
        "source_path", "known", "mapped",
        F.coalesce(F.nullif(js.get(v, "$.type", "string"), F.lit("")), F.lit("<missing>")).alias("top"),
        coverage_key(v).alias("coverage_key"))
    status = F.broadcast(coverage_table(events.sparkSession))
    unused = objects.filter(F.col("known") & F.col("mapped").isNull()).join(
        status, "coverage_key", "left")
    by_policy = F.col("status").isin(STORED, IGNORED)

    def part(df: DataFrame, section: str, key: Column) -> DataFrame:
        return df.groupBy("source_path", key.alias("key")).agg(F.count("*").alias("count")).select(
            "source_path", F.lit(section).alias("section"), "key", "count")

    all_ = F.lit("all")
    return (part(objects, "raw", F.col("top"))
            .unionByName(part(objects.filter(~F.col("known")), "dropped", F.col("top")))
            .unionByName(part(unused.filter(F.coalesce(by_policy, F.lit(False))), "policy_dropped",
                              F.col("coverage_key")))
            .unionByName(part(unused.filter(~F.coalesce(by_policy, F.lit(False))), "unmapped",
                              F.col("coverage_key")))
            .unionByName(part(before, "messages_before_dedupe", all_))
            .unionByName(part(after, "messages_after_dedupe", all_)))


def drop_samples(lines: DataFrame, sample_limit: int = 12) -> DataFrame:
    """The first unused events of each file with the reason; unknown kinds come first."""
    rows = _events(lines).withColumn("mapped", _mapping()).filter(
        (F.col("kind") == "object") & (~F.col("known") | F.col("mapped").isNull()))
    rows = rows.select("source_path", "line_no", "known", coverage_key(F.col("v")).alias("coverage_key"),
                       js.get(F.col("v"), "$.type", "string").alias("top"))
    rows = rows.join(F.broadcast(coverage_table(lines.sparkSession)), "coverage_key", "left")
    reason = (F.when(~F.col("known"), F.lit("adapter_to_canonical_returned_none"))
              .when(F.col("status").isin(STORED, IGNORED), F.concat(F.lit("policy_"), F.col("status")))
              .otherwise(F.lit("canonical_to_message_returned_none")))
    order = Window.partitionBy("source_path").orderBy("known", "line_no")
    kind = F.when(F.col("known"), F.col("coverage_key")).otherwise(F.coalesce("top", F.lit("<missing>")))
    return rows.select("source_path", "line_no", kind.alias("event_type"), reason.alias("reason"),
                       "known").withColumn("n", F.row_number().over(order)).filter(
        F.col("n") <= sample_limit).drop("n", "known")


def _converted(lines: DataFrame, ecosystem: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Events of the files that are read, their messages, the rejected files and the facts of the others."""
    events = _events(lines).withColumn("mapped", F.when(F.col("known"), _mapping()))
    flagged = events.withColumn("kept", F.col("mapped").isNotNull())
    errors = rejected_files(flagged)
    good = flagged.join(errors.select("source_path"), "source_path", "left_anti")
    return good, _to_messages(good.filter("kept"), ecosystem), errors, file_facts(good)


def _no_compacts(messages: DataFrame) -> DataFrame:
    return messages.limit(0).select("ecosystem", "source_path", "session_id", "line_no", "timestamp", "ts_us",
                                    F.lit("").alias("trigger"), F.lit(0).cast("bigint").alias("pre_tokens"))


def convert_b(lines: DataFrame, ecosystem: str = "format_b") -> Normalized:
    """Line by line: messages before the prompt dedupe, and facts of the files."""
    _, before, errors, facts = _converted(lines, ecosystem)
    return Normalized(before, _no_compacts(before.withColumn("session_id", F.col("path_id"))), errors, facts=facts)


def finish_b(before: DataFrame, facts: DataFrame, window_seconds: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """Messages and lineage of whole files from their converted lines and facts."""
    after = dedupe_prompts(before, window_seconds)
    messages = after.join(facts.select("source_path", "meta_id"), "source_path", "left").withColumn(
        "session_id", F.coalesce("meta_id", "path_id")).drop("meta_id", "path_id", "channel")
    own = uuid_tail(file_stem(F.col("source_path")))
    return messages, facts.select(F.coalesce("meta_id", own).alias("session_id"), "parent_session_id",
                                  "root_session_id")


def normalize_b(lines: DataFrame, ecosystem: str = "format_b",
                window_seconds: float = 2.0) -> Normalized:
    """Messages, lineage and diagnostics from lines (source_path, line_no, value or v + kind)."""
    good, before, errors, facts = _converted(lines, ecosystem)
    # written once: the dedupe, the counts and the caller all read the converted messages
    before = stage(before, "converted")
    messages, lineage = finish_b(before, facts, window_seconds)
    return Normalized(messages, _no_compacts(messages), errors, lineage,
                      diagnose(good, before, messages))
