"""Scans, incremental ingest, the table store and exports on real files."""

import json
import os

from logs import ROLLOUT, ROLLOUT_ID, a, result, usage, use
from pyspark.sql import functions as F

from logloom.operators import session_stats as st
from logloom.plans.ingest import delete_session, ingest, set_file_status
from logloom.sources import export
from logloom.sources.registry import format_names, log_format
from logloom.sources.scan import list_files, scan_logs
from logloom.sources.store import TableStore


def write(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")


def session(sid, n=2):
    return [a("user", f"10:00:{i:02d}", f"q{i}", i, sid=sid) for i in range(n)]


def test_line_numbers_over_many_splits(spark, tmp_path):
    lines = {f"s{f}": [a("user", "10:00:00", "x" * (i % 97), i) if i % 7 else "" for i in range(700 + f)]
             for f in range(3)}
    for name, content in lines.items():
        write(tmp_path / "logs" / f"{name} é%.jsonl", content)
    write(tmp_path / "logs" / "subagents" / "t.jsonl", session("t"))
    write(tmp_path / "logs" / "history.jsonl", session("h"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = scan_logs(spark, str(tmp_path / "logs"), log_format("format_a")).select(
            "source_path", "line_no", "kind", F.expr("try_variant_get(v, '$.uuid', 'string')").alias("u")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    by_file = {}
    for r in got:
        by_file.setdefault(os.path.basename(r.source_path), {})[r.line_no] = r.u
    assert set(by_file) == {f"{n} é%.jsonl" for n in lines}
    for name, content in lines.items():
        want = {i: (json.loads(x)["uuid"] if x else None) for i, x in enumerate(content, 1)}
        assert by_file[f"{name} é%.jsonl"] == want


def test_incremental_ingest(spark, tmp_path):
    root = tmp_path / "a"
    write(root / "p" / "s1.jsonl", [
        *session("s1"), a("assistant", "10:00:05", [use("Read", "t", path="x")], 7, sid="s1", spent=usage(10, 5)),
        a("user", "10:00:07", [result("t", "no such file", is_error=True)], 8, sid="s1")])
    write(root / "s2.jsonl", session("s2"))
    write(root / "bad.jsonl", ["{oops"])
    write(root / "empty.jsonl", ["[]"])
    b_root = tmp_path / "b"
    write(b_root / f"rollout-2026-{ROLLOUT_ID}.jsonl", ROLLOUT)
    roots = {"format_a": str(root), "format_b": str(b_root)}
    assert {"format_a", "format_b"} <= set(format_names())
    assert list_files(spark, str(root), log_format("format_a")).count() == 4
    store = TableStore(spark, str(tmp_path / "store"))

    first = ingest(spark, roots, store, parsed_at="t1")
    assert (first.parsed, first.skipped, first.errors) == (3, 0, 2)
    rows = {r.session_id: r for r in store.read("sessions").collect()}
    assert set(rows) == {"s1", "s2", ROLLOUT_ID}
    assert rows["s1"].total_tool_calls == 1 and rows["s1"].project_path == str(root / "p")
    stats = {r.session_id: r for r in store.read("session_statistics").collect()}
    assert stats["s1"].trajectory_file_size_bytes == os.path.getsize(root / "p" / "s1.jsonl")
    assert stats[ROLLOUT_ID].trajectory_file_size_bytes == 0
    assert store.read("tool_errors").first().category == "file_not_found"
    reasons = {os.path.basename(r.file_path): r.reason for r in store.read("ingest_errors").collect()}
    assert reasons == {"bad.jsonl": "invalid JSON", "empty.jsonl": "no valid messages"}

    write(root / "s2.jsonl", session("s2", 5))
    second = ingest(spark, roots, store, parsed_at="t2")
    assert (second.parsed, second.skipped, second.errors) == (1, 2, 2)
    rows = {r.session_id: r for r in store.read("sessions").collect()}
    assert rows["s2"].total_messages == 5 and rows["s1"].parsed_at == "t1" and len(rows) == 3
    assert store.read("tool_stats").filter("session_id = 's1'").count() == 1

    set_file_status(store, str(root / "s2.jsonl"), "pending")
    status = {os.path.basename(r.file_path): r.parse_status for r in store.read("tracked_files").collect()}
    assert status["s2.jsonl"] == "pending" and status["s1.jsonl"] == "parsed"
    delete_session(store, "s1")
    assert {r.session_id for r in store.read("sessions").collect()} == set(rows) - {"s1"}
    assert store.read("tool_errors").count() == 0

    metrics = export.metric_rows(store.read("session_statistics"))
    assert metrics.count() == 2 * len(export.METRICS)
    export.write_csv(export.tool_rows(store.read("tool_stats")), str(tmp_path / "csv"))
    back = spark.read.option("header", "true").csv(str(tmp_path / "csv")).collect()
    assert {(r.tool_name, r.success_rate) for r in back} == {("Grep", "100.00")}


def test_one_file_counts_whatever_the_order_of_runs(spark, tmp_path):
    """A session in two files belongs to the last path, even when only the other one is read again."""
    root, store = tmp_path / "a", TableStore(spark, str(tmp_path / "store"))
    write(root / "one" / "s.jsonl", session("s", 2))
    write(root / "two" / "s.jsonl", session("s", 3))
    ingest(spark, {"format_a": str(root)}, store)
    assert store.read("sessions").first().total_messages == 3
    write(root / "one" / "s.jsonl", session("s", 6))
    again = ingest(spark, {"format_a": str(root)}, store)
    assert (again.parsed, again.skipped, again.errors) == (1, 1, 0)
    assert store.read("sessions").first().total_messages == 3
    lost = store.read("ingest_errors").collect()
    assert [(r.file_path, r.reason) for r in lost] == [
        (str(root / "one" / "s.jsonl"), "another file holds this session")]
    assert ingest(spark, {"format_a": str(root)}, store).skipped == 2


def test_store_publishes_only_on_commit(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "st"))
    one = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    store.upsert("t", one, ["k"])
    assert store.read("t") is None
    store.commit()
    store.upsert("t", spark.createDataFrame([("b", 2), ("c", 2)], "k string, v int"), ["k"])
    assert store.read("t").count() == 2
    store.commit()
    assert {(r.k, r.v) for r in store.read("t").collect()} == {("a", 1), ("b", 2), ("c", 2)}
