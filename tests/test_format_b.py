"""Sessions in format B."""

import json
import random

from logs import ROLLOUT, ROLLOUT_ID, ROLLOUT_PATH, b, lines_frame

from logloom.operators import session_stats as st
from logloom.operators.pairing import pair_tools
from logloom.plans.staging import stage
from logloom.sources.variants import decode
from logloom.schemas import explode_blocks
from logloom.sources.format_b import drop_samples, normalize_b


def normal(spark, files):
    return normalize_b(stage(decode(lines_frame(spark, files)), "b"))


def message(text, clock, role="user"):
    return b("response_item", {"type": "message", "role": role,
                               "content": [{"type": "input_text", "text": text}]}, clock)


def prompt(text, clock):
    return b("event_msg", {"type": "user_message", "message": text}, clock)


def test_short_session(spark):
    done = normal(spark, {ROLLOUT_PATH: ROLLOUT})
    messages = stage(done.messages, "m")
    rows = messages.orderBy("line_no").collect()
    assert len(rows) == 7
    assert [r.record_type for r in rows].count("user") == 3
    assert {r.session_id for r in rows} == {ROLLOUT_ID}
    spent = [r for r in rows if r.has_usage]
    assert [(r.input_tokens, r.output_tokens, r.cache_read_tokens) for r in spent] == [(310, 64, 128)]
    counts = {(r.section, r.key): r["count"] for r in done.diagnostics.collect()}
    assert counts[("messages_before_dedupe", "all")] == 8
    assert counts[("messages_after_dedupe", "all")] == 7
    assert counts[("policy_dropped", "event_msg:turn_context")] == 1
    assert counts[("policy_dropped", "response_item:reasoning")] == 1
    pair = pair_tools(explode_blocks(messages)).first()
    assert pair.matched and pair.name == "Grep" and pair.is_error is False
    meta = st.session_metadata(messages).first()
    assert (meta.project_path, meta.version) == ("/srv/shop", "2.4")
    assert rows[0].blocks[0].text == "session_meta source=exec"


def test_samples_and_unknown_kinds(spark):
    lines = [*ROLLOUT, b("mystery", {}), b("event_msg", {"type": "odd"})]
    frame = stage(decode(lines_frame(spark, {ROLLOUT_PATH: lines})), "b")
    got = [(r.line_no, r.event_type, r.reason) for r in drop_samples(frame, 3).orderBy("line_no").collect()]
    assert got == [
        (2, "event_msg:turn_context", "policy_stored_not_used_yet"),
        (5, "response_item:reasoning", "policy_stored_not_used_yet"),
        (11, "mystery", "adapter_to_canonical_returned_none")]
    counts = {(r.section, r.key): r["count"] for r in normalize_b(frame).diagnostics.collect()}
    assert counts[("dropped", "mystery")] == 1 and counts[("unmapped", "event_msg:odd")] == 1


def test_lineage(spark):
    def file(uid, **extra):
        return {f"/l/rollout-{uid}.jsonl": [b("session_meta", {"id": uid, **extra}), prompt("hi", "09:00:01")]}

    files = {**file("root"), **file("c1", parent_session_id="root"),
             **file("c2", source={"subagent": {"thread_spawn": {"parentThreadId": " c1 ",
                                                                 "root_id": "root"}}})}
    done = normal(spark, files)
    messages = stage(done.messages, "m")
    stats = st.session_statistics(messages, explode_blocks(messages))
    rows = {r.session_id: r for r in st.session_rows(
        st.session_metadata(messages), stats, done.lineage).collect()}
    assert rows["c2"].parent_session_id == "c1"
    assert {r.logical_session_id for r in rows.values()} == {"root"}


def test_repeats_on_one_channel_stay(spark):
    done = normal(spark, {"/l/rollout-x.jsonl": [
        prompt("again", "09:00:00"), prompt("again", "09:00:01"), message("other", "09:00:01")]})
    assert done.messages.count() == 3


def brute_force(items, width):
    kept = []
    for line, text, channel, ts in items:
        hit = next((i for i in range(len(kept) - 1, -1, -1)
                    if kept[i][1] == text and kept[i][2] != channel
                    and abs(kept[i][3] - ts) <= width), None)
        if hit is None:
            kept.append((line, text, channel, ts))
        elif channel == "event":
            kept[hit] = (line, text, channel, ts)
    return [k[0] for k in kept]


def test_prompt_dedupe_against_brute_force(spark):
    rng = random.Random(3)
    files, want = {}, {}
    for f in range(40):
        items, lines = [], []
        for line in range(1, rng.randint(2, 14)):
            text, channel = rng.choice("ab"), rng.choice(["event", "item"])
            ts = rng.randint(0, 80) / 10
            clock = f"09:00:{ts:06.3f}"
            items.append((line, text, channel, ts))
            lines.append((prompt if channel == "event" else message)(text, clock))
        path = f"/l/rollout-f{f}.jsonl"
        files[path], want[path] = lines, brute_force(items, 2.0)
    got = {}
    for r in normal(spark, files).messages.orderBy("line_no").collect():
        got.setdefault(r.source_path, []).append(int(r.uuid.rsplit("-", 1)[1]))
    assert got == want


def verdicts(spark, payloads):
    lines = [b("response_item", {"call_id": f"c{i}", "type": "function_call_output", **p})
             for i, p in enumerate(payloads)]
    rows = normal(spark, {"/l/rollout-x.jsonl": lines}).messages.orderBy("line_no").collect()
    return [r.blocks[0] for r in rows]


def test_error_inference(spark):
    out = verdicts(spark, [
        {"output": "Process exited with code 2"},
        {"output": "status: failed"},
        {"output": "command failed badly"},
        {"output": "finished with 0 errors"},
        {"output": json.dumps({"exit_code": 1})},
        {"output": json.dumps({"http_status": "404"})},
        {"output": json.dumps({"ok": True, "message": "Traceback"})},
        {"output": json.dumps({"metadata": {"exit_code": 3}, "output": "x"}), "type": "custom_tool_call_output"},
        {"output": json.dumps([{"a": {"error": "boom"}}])},
        {"output": {"is_error": False, "rows": [1]}},
        {"output": "plain words"},
        {"output": json.dumps({"status": "running", "error": None})},
    ])
    assert [r.is_error for r in out] == [
        True, True, True, False, True, True, False, True, True, False, False, False]
    assert out[7].result_text == "x"


def test_calls_and_searches(spark):
    lines = [
        b("response_item", {"type": "function_call", "name": "Bash", "arguments": "{\"command\":\"ls | wc\"}",
                            "call_id": "k1"}),
        b("response_item", {"type": "custom_tool_call", "name": "patch", "input": "*** Begin"}),
        b("response_item", {"type": "function_call", "arguments": "[1]"}),
        b("response_item", {"type": "web_search_call", "id": "w1", "status": "completed", "query": " q "}),
        b("response_item", {"type": "web_search_call", "id": "w2", "status": "failed", "error": "boom"}),
        b("response_item", {"type": "web_search_call", "status": "in_progress"}),
        b("response_item", {"type": "message", "role": "developer",
                            "content": [{"text": "a"}, {"text": "b"}]}),
        b("event_msg", {"type": "agent_message", "message": "  ", "summary": [{"text": " s "}]}),
        b("event_msg", {"type": "token_count", "info": {"last_token_usage": {},
                        "total_token_usage": {"input_tokens": 9, "output_tokens": None}}}),
        b("event_msg", {"type": "token_count", "info": None}),
    ]
    rows = normal(spark, {"/l/rollout-x.jsonl": lines}).messages.orderBy("line_no").collect()
    assert len(rows) == 9
    one = [r.blocks[0] if r.blocks else None for r in rows]
    assert (one[0].tool_name, one[0].command, one[0].param_keys) == ("Bash", "ls | wc", ["command"])
    assert (one[1].tool_id, json.loads(one[1].input_json)) == ("rollout-x-call-2", {"raw": "*** Begin"})
    assert (one[2].tool_name, json.loads(one[2].input_json)) == ("unknown_tool", {"value": [1]})
    assert json.loads(one[3].result_text) == {"type": "web_search_call", "query": "q", "status": "completed"}
    assert [x.is_error for x in one[3:6]] == [False, True, None]
    assert one[5].tool_id == "rollout-x-web-search-6" and one[5].tool_name == "web_search_call"
    assert rows[6].user_type == "source_role:developer" and [x.text for x in rows[6].blocks] == ["a", "b"]
    assert one[7].text == "s"
    assert (rows[8].input_tokens, rows[8].output_tokens) == (9, 0)
