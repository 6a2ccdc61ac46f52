"""Sessions in format A against hand-computed values."""

import json

import pytest
from logs import a, at, lines_frame, result, text, usage, use

from logloom.operators import attribution as attr
from logloom.operators import session_stats as st
from logloom.operators.pairing import pair_tools
from logloom.plans.staging import stage
from logloom.sources.variants import decode
from logloom.schemas import explode_blocks
from logloom.sources.format_a import normalize_a, scan_compacts

TOOLS = [
    a("user", "10:00:00", "go", 1),
    a("assistant", "10:00:05", [text("reading"), use("Read", "t1", path="x")], 2,
      spent=usage(100, 50, 50, 25)),
    a("user", "10:00:07", [result("t1", "content")], 3),
    a("assistant", "10:00:09", [use("Read", "t2", path="y")], 4, spent=usage(80, 40)),
    a("user", "10:00:10", [result("t2", "fine", is_error=False)], 5),
    a("assistant", "10:00:12", [use("Edit", "t3", path="y")], 6, spent=usage(120, 60)),
    a("user", "10:00:15", [result("t3", "Permission denied", is_error=True)], 7),
]


def stats_of(spark, lines, **options):
    done = normalize_a(stage(decode(lines_frame(spark, {"/logs/proj/s1.jsonl": lines})), "t"))
    messages = stage(done.messages, "m")
    blocks = explode_blocks(messages)
    row = st.session_statistics(messages, blocks, compacts=done.compacts, **options).first()
    return row, messages, blocks


def test_tools(spark):
    row, messages, blocks = stats_of(spark, TOOLS)
    assert row.total_tokens == 450 and row.total_input_tokens == 300
    assert row.total_output_tokens == 150
    assert (row.cache_read_tokens, row.cache_creation_tokens) == (50, 25)
    assert row.user_yield_ratio_tokens == 2.0
    assert (row.user_message_count, row.assistant_message_count) == (4, 3)
    assert row.user_interaction_count == 1
    pairs = pair_tools(blocks)
    tools = {r.tool_name: r for r in st.tool_stats(blocks, pairs).collect()}
    assert (tools["Read"].calls, tools["Read"].total_tokens, tools["Read"].success_count) == (2, 270, 2)
    assert (tools["Edit"].calls, tools["Edit"].total_tokens, tools["Edit"].error_count) == (1, 180, 1)
    assert tools["Read"].latency_us == 3_000_000 and tools["Read"].avg_latency_seconds == 1.5
    error = st.error_records(pairs).first()
    assert (error.category, error.matched_rule) == ("permission", "permission_denied")
    assert {r.parameter for r in messages.sparkSession.createDataFrame(
        [(k,) for b in blocks.collect() if b.param_keys for k in b.param_keys], "parameter string"
    ).collect()} == {"path"}


def test_many_lines_without_a_time(spark):
    """Each gap from 1970 to the next time is 56 years; a hundred times sixty of them is beyond BIGINT."""
    lines = []
    for n in range(120):
        line = json.loads(a("assistant" if n % 4 else "user", "10:00:00", "x", n, spent=usage(10**12, 1)))
        if n % 2 == 0:
            del line["timestamp"]
        lines.append(json.dumps(line))
    row, *_ = stats_of(spark, lines)
    assert 92_233_720_368_547_758 < row.inactive_us == row.span_us
    assert (row.inactive_time_percent, row.active_time_ratio) == (100.0, 0.0)
    assert row.total_input_tokens == 120 * 10**12 and row.avg_tokens_per_second is None


def test_large_counts_make_exact_rates(spark):
    lines = [a("user", "10:00:00", "go", 1), a("assistant", "10:00:05", "x", 2, spent=usage(10**14, 5 * 10**13))]
    row, *_ = stats_of(spark, lines)
    assert (row.read_tokens_per_second, row.output_tokens_per_second) == (2e13, 1e13)
    assert row.avg_tokens_per_second == 3e13 and row.model_time_percent == 100.0


def test_metadata_falls_back_to_the_folder(spark):
    _, messages, _ = stats_of(spark, TOOLS)
    row = st.session_metadata(messages).first()
    assert (row.session_id, row.project_path, row.version) == ("s1", "/logs/proj", "unknown")
    assert row.created_at == "2026-01-05T10:00:00+00:00"


@pytest.mark.parametrize("options,model,tool,user,inactive,timeouts", [
    ({}, 1500, 0, 720, 3300, 1),
    ({"model_timeout": 300.0}, 1500, 0, 720, 3300, 2),
    ({"inactivity": 7200.0}, 1500, 0, 4020, 0, 1),
    ({"inactivity": 600.0}, 600, 0, 0, 4920, 0),
])
def test_gaps(spark, options, model, tool, user, inactive, timeouts):
    clocks = [("user", "10:00"), ("assistant", "10:08"), ("user", "10:20"), ("assistant", "10:35"),
              ("user", "11:30"), ("assistant", "11:32")]
    row, *_ = stats_of(spark, [a(k, f"{c}:00", "x", i) for i, (k, c) in enumerate(clocks)], **options)
    got = (row.model_us, row.tool_us, row.user_us, row.inactive_us)
    assert got == tuple(v * 1_000_000 for v in (model, tool, user, inactive))
    assert row.model_timeout_count == timeouts
    if options.get("inactivity") == 7200.0:
        assert row.active_time_ratio == 1.0


def test_compaction_counts_as_an_assistant_message(spark):
    mark = json.dumps({"type": "system", "subtype": "compact_boundary", "sessionId": "s1", "uuid": "c",
                       "timestamp": at("10:00:20"),
                       "compactMetadata": {"trigger": "token_limit", "preTokens": 4096}})
    row, *_ = stats_of(spark, [*TOOLS, mark])
    assert row.compact_count == 1 and row.assistant_message_count == 4
    got = scan_compacts(lines_frame(spark, {"/logs/s1.jsonl": [*TOOLS, mark]})).first()
    assert (got.trigger, got.pre_tokens, got.line_no) == ("token_limit", 4096, 8)


def test_characters(spark):
    lines = [a("user", "10:00:00", "你好abc", 1), a("assistant", "10:00:01", [text("测试xyz")], 2),
             a("user", "10:00:02", [result("none", "错误404")], 3)]
    row, *_ = stats_of(spark, lines)
    assert (row.user_chars, row.model_chars, row.tool_chars, row.total_chars) == (5, 5, 5, 15)
    assert (row.cjk_chars, row.latin_chars, row.digit_chars) == (6, 6, 3)
    lines = [a("user", "10:00:00", "A1 \t", 1), a("assistant", "10:00:01", [text("中B")], 2),
             a("user", "10:00:02", [result("none", "９\n?")], 3)]
    row, *_ = stats_of(spark, lines)
    assert (row.cjk_chars, row.latin_chars, row.digit_chars, row.space_chars, row.other_chars) == (1, 2, 2, 3, 1)


def test_orphan_result_counts_once(spark):
    lines = [a("user", "10:00:00", "x", 1),
             a("user", "10:00:01", [result("gone", "timed out", is_error=True)], 2),
             a("user", "10:00:02", [result("gone", "timed out", is_error="failed", tool_name=" Web ")], 3),
             a("user", "10:00:03", [{"type": "tool_result", "content": "a"}], 4),
             a("user", "10:00:04", [{"type": "tool_result", "content": "b"}], 5)]
    _, _, blocks = stats_of(spark, lines)
    tools = {r.tool_name: r for r in st.tool_stats(blocks, pair_tools(blocks)).collect()}
    assert (tools["unknown"].calls, tools["unknown"].error_count, tools["unknown"].success_count) == (3, 1, 2)
    assert (tools["Web"].calls, tools["Web"].error_count) == (1, 1)


def test_subagent(spark):
    side = {"isSidechain": True, "agentId": "ag", "parentUuid": "m1"}
    lines = [a("user", "10:00:00", "x", 1),
             a("assistant", "10:00:01", [text("p")], 2, spent=usage(50, 25), **side),
             a("assistant", "10:00:04", [text("q")], 3, spent=usage(70, 40), **side),
             a("assistant", "10:00:05", [text("r")], 4, spent=usage(5, 5))]
    _, messages, _ = stats_of(spark, lines)
    agent = st.subagents(messages).collect()
    assert len(agent) == 1
    assert (agent[0].messages, agent[0].tokens, agent[0].parent_uuid) == (2, 185, "m1")
    assert agent[0].end_us - agent[0].start_us == 3_000_000
    link = st.sidechain_links(messages).first()
    assert (link.parent_uuid, link.parent_line, link.messages) == ("m1", 1, 2)


def test_shell_shares(spark):
    lines = [a("assistant", "10:00:00", [use("Bash", "b1", command="cd /x && A=1 /usr/bin/make all | tail")], 1),
             a("user", "10:00:06", [result("b1", "0123456789")], 2),
             a("assistant", "10:00:07", [use("Bash", "b1", command="  ")], 3),
             a("user", "10:00:10", [result("b1", [text("abc"), text("d")])], 4)]
    row, _, blocks = stats_of(spark, lines)
    assert (row.shell_calls, row.shell_sub_commands, row.avg_commands_per_call) == (2, 3, 1.5)
    cmds = {r.command_name: r for r in st.shell_commands(blocks, pair_tools(blocks)).collect()}
    assert set(cmds) == {"cd", "make", "tail"}
    # the second call has no command, so its result is shared among the earlier ones
    assert cmds["make"].latency_seconds == pytest.approx(6 / 3 + 3 / 3)
    assert cmds["make"].output_chars == 10 // 3 + 4 // 3
    dist = {r.commands_per_call: (r.calls, r.band) for r in st.shell_distribution(blocks).collect()}
    assert dist == {3: (1, "3"), 0: (1, "0")}


def test_types_are_checked_line_by_line(spark):
    lines = [
        json.dumps({"type": "progress", "sessionId": "s1", "uuid": "p", "timestamp": at("10:00:00")}),
        json.dumps({"type": "user", "sessionId": 5, "uuid": "q"}),
        "[1, 2]", "", "   ",
        json.dumps({"type": "user", "sessionId": "s1", "uuid": "r", "cwd": 7, "isMeta": "yes",
                    "message": {"role": " USER ", "content": ["skip", {"text": "loose"}, {"type": "x"}],
                                "usage": {"input_tokens": " 12 ", "output_tokens": 3.7,
                                          "cache_read_input_tokens": True,
                                          "cache_creation_input_tokens": 1.5}}}),
        json.dumps({"type": "summary", "sessionId": "s1", "uuid": "s", "summary": "short",
                    "timestamp": at("10:00:02")}),
    ]
    done = normalize_a(lines_frame(spark, {"/l/s1.jsonl": lines}))
    rows = {r.uuid: r for r in done.messages.collect()}
    assert set(rows) == {"p", "r", "s"} and done.errors.count() == 0
    assert rows["p"].record_type == "assistant" and rows["p"].role is None
    r = rows["r"]
    assert (r.role, r.cwd, r.is_meta, r.timestamp) == ("user", None, None, "1970-01-01T00:00:06Z")
    assert r.inferred_ts and (r.input_tokens, r.output_tokens, r.cache_read_tokens) == (12, 0, 1)
    assert r.cache_creation_tokens is None
    assert [(b.block_type, b.text) for b in r.blocks] == [("text", "loose"), ("x", None)]
    assert rows["s"].record_type == "summary" and rows["s"].summary == "short"


def test_a_bad_line_rejects_its_file_only(spark):
    done = normalize_a(lines_frame(spark, {
        "/l/good.jsonl": TOOLS, "/l/bad.jsonl": [TOOLS[0], "{oops", TOOLS[1]],
        "/l/when.jsonl": [json.dumps({"type": "user", "sessionId": "s", "uuid": "u", "timestamp": "soon"})]}))
    assert {r.session_id for r in done.messages.collect()} == {"good"}
    assert {(r.source_path, r.line_no, r.reason) for r in done.errors.collect()} == {
        ("/l/bad.jsonl", 2, "invalid JSON"), ("/l/when.jsonl", 1, "invalid timestamp")}


def test_large_output_is_bounded(spark):
    big = "x" * 13_000
    many = [{"type": "text", "text": str(i)} for i in range(201)]
    lines = [a("user", "10:00:00", [result("a", big), result("b", many), result("c", {"k": [1, "v"]}),
                                    {"type": "tool_result", "tool_use_id": "d"}], 1)]
    _, _, blocks = stats_of(spark, lines)
    out = {r.tool_id: r for r in blocks.collect()}
    cut, note = out["a"].result_text.split("\n")
    assert cut == "x" * 12_000 and out["a"].output_chars == 12_000 and out["a"].result_string is None
    meta = json.loads(note)
    assert meta["original_chars"] == 13_000 and meta["raw_ref"].startswith("sha256:")
    whole = json.loads(out["b"].result_text)
    assert whole["type"] == "structured_summary" and whole["item_count"] == 201
    assert len(whole["preview"]) == 1000
    assert out["c"].result_text == json.dumps({"k": [1, "v"]})
    assert out["d"].result_text == json.dumps({"type": "value", "value": None})


def test_negative_gap_moves_the_cursor(spark):
    lines = [a("user", "10:00:10", "x", 1), a("assistant", "10:00:00", "y", 2),
             a("user", "10:00:04", "z", 3)]
    _, messages, _ = stats_of(spark, lines)
    gaps = [(r.gap_us, r.gap_kind) for r in attr.with_gaps(messages).orderBy("line_no").collect()]
    assert gaps == [(None, None), (None, None), (4_000_000, "user")]
