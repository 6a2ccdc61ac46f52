"""Grown files are read on from a byte; the store writes touched buckets and lets one of two runs commit."""

import json
import os
import random

import pytest
from logs import a, b, result, usage, use
from pyspark.sql import functions as F

from logloom.plans.ingest import CHILD_TABLES, delete_session, ingest
from logloom.sources import store as stores
from logloom.sources import tail
from logloom.sources.store import ConcurrentCommit, TableStore

ID = "11111111-2222-3333-4444-555555555555"
TABLES = ("sessions", "session_statistics", *CHILD_TABLES)


class Bytes:
    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at:at + n]


@pytest.mark.parametrize("read", [3, 1 << 20])
def test_splits_give_every_line_once(monkeypatch, read):
    monkeypatch.setattr(tail, "READ", read)
    rnd = random.Random(read)
    for _ in range(200):
        data = b"".join(rnd.choice([b"\n", b"a", b"bc", b"\r\n"]) for _ in range(rnd.randrange(40)))
        base = rnd.choice([0, *[k + 1 for k, c in enumerate(data) if c == 10]])
        want, at = [], base
        for piece in data[base:].split(b"\n"):
            ends = at + len(piece) < len(data)
            if piece or ends:
                want.append((at, piece, ends))
            at += len(piece) + 1
        for step in (1, 2, 5, 100):
            got = [line for start in range(base, len(data), step) for line in
                   tail.lines_in(Bytes(data), start, min(start + step, len(data)), base, len(data))]
            assert got == want
        end = data.rfind(b"\n") + 1
        assert tail.last_line_end(Bytes(data), len(data)) == end


def append(path, *lines, end="\n"):
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, "a", encoding="utf-8") as out:
        out.write("\n".join(lines) + end)


def lines_of(sid, first, n):
    out = []
    for k in range(first, first + n):
        clock = f"10:{k // 60:02d}:{k % 60:02d}"
        if k % 3 == 0:
            out.append(a("user", clock, f"question {k}", k, sid=sid))
        elif k % 3 == 1:
            out.append(a("assistant", clock, [use("Bash", f"t{k}", command="ls")], k, sid=sid, spent=usage(k, 2)))
        else:
            out.append(a("user", clock, [result(f"t{k - 1}", "no such file", is_error=k % 2 == 0)], k, sid=sid))
    return out


def rows_of(store, name):
    df = store.read(name)
    return sorted((json.dumps(r.asDict(True), sort_keys=True, default=str) for r in df.select(sorted(df.columns)).collect()))


def test_grown_files_are_read_on_and_give_the_tables_of_a_full_run(spark, tmp_path):
    root_a, root_b, store = tmp_path / "a", tmp_path / "b", TableStore(spark, str(tmp_path / "store"), buckets=8)
    roots, roll = {"format_a": str(root_a), "format_b": str(root_b)}, root_b / f"rollout-2026-{ID}.jsonl"
    for k in range(4):
        append(root_a / f"s{k}.jsonl", *lines_of(f"s{k}", 0, 40))
    append(roll, b("session_meta", {"id": "own", "cwd": "/srv", "parent_session_id": "up"}, "09:00:00"),
           b("response_item", {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "hi there"}]}, "09:00:01"))
    first = ingest(spark, roots, store, parsed_at="t")
    assert (first.parsed, first.skipped, first.errors, first.resumed) == (5, 0, 0, 0)

    # what lies more than a mark before the end may no longer be readable: it is not read again
    with open(root_a / "s1.jsonl", "r+b") as out:
        whole = out.read()
        out.seek(0)
        out.write(b"x" * 100)
    more = lines_of("s1", 40, 7)
    append(root_a / "s1.jsonl", *more)
    prompt = b("event_msg", {"type": "user_message", "message": "hi there"}, "09:00:01.5")
    append(roll, prompt, b("response_item", {"type": "message", "role": "assistant", "content": [{"type": "output_text", "text": "yes"}]}, "09:00:03"))
    append(root_a / "s9.jsonl", *lines_of("s9", 0, 5))
    grown = (os.path.getsize(root_a / "s1.jsonl") - len(whole)) + os.path.getsize(root_a / "s9.jsonl") + len(
        roll.read_bytes().split(b"\n", 2)[2])
    second = ingest(spark, roots, store, parsed_at="t")
    assert (second.parsed, second.skipped, second.errors, second.resumed) == (3, 3, 0, 2)
    assert second.bytes_read == grown

    with open(root_a / "s1.jsonl", "r+b") as out:
        out.write(whole[:100])
    full = TableStore(spark, str(tmp_path / "full"))
    ingest(spark, roots, full, parsed_at="t")
    for name in TABLES:
        assert rows_of(store, name) == rows_of(full, name), name
    own = {r.session_id: r for r in store.read("sessions").collect()}
    assert own["own"].parent_session_id == "up" and own["own"].total_messages == 3  # the prompt came twice

    append(root_a / "s2.jsonl", "{broken")
    (root_a / "s3.jsonl").write_text("\n".join(lines_of("s3", 100, 60)) + "\n")
    third = ingest(spark, roots, store, parsed_at="t")  # s1 has another time, s3 is written anew
    assert (third.parsed, third.skipped, third.errors, third.resumed) == (2, 3, 1, 2)
    messages = {r.session_id: r.total_messages for r in store.read("sessions").collect()}
    assert (messages["s2"], messages["s3"]) == (40, 60)
    (root_a / "s2.jsonl").write_text("\n".join(lines_of("s2", 0, 44)) + "\n")
    fourth = ingest(spark, roots, store, parsed_at="t")
    assert (fourth.parsed, fourth.resumed) == (1, 0)  # a file that was in error is read whole
    assert fourth.bytes_read == os.path.getsize(root_a / "s2.jsonl")


def test_last_lines_without_an_end(spark, tmp_path):
    root, store = tmp_path / "a", TableStore(spark, str(tmp_path / "store"), buckets=4)
    roots, lines = {"format_a": str(root)}, lines_of("s", 0, 30)
    count = lambda: store.read("sessions").first().total_messages
    append(root / "s.jsonl", *lines[:10], lines[10][:20], end="")
    assert ingest(spark, roots, store).errors == 0 and count() == 10  # half a line waits
    append(root / "s.jsonl", lines[10][20:], *lines[11:15])
    assert ingest(spark, roots, store).resumed == 1 and count() == 15
    append(root / "s.jsonl", *lines[15:20], end="")
    assert ingest(spark, roots, store).resumed == 1 and count() == 20  # a whole line counts
    append(root / "s.jsonl", "", *lines[20:25])
    again = ingest(spark, roots, store)
    assert again.resumed == 0 and count() == 25
    assert [r.line_no for r in store.read("file_messages_format_a").orderBy("line_no").collect()] == list(range(1, 26))


def test_upserts_touch_only_their_buckets(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "st"), buckets=32)
    store.upsert("t", spark.range(2000).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("v")), ["k"])
    store.commit()
    before = {p for _, _, files in os.walk(tmp_path) for p in files}
    store.upsert("t", spark.createDataFrame([("5", 2, "new")], "k string, v int, more string"), ["k"])
    store.commit()
    added = [os.path.join(d, p) for d, _, files in os.walk(tmp_path) for p in files if p not in before and p.endswith(".parquet")]
    assert len({os.path.dirname(p) for p in added}) == 1  # one bucket of 32
    got = {r.k: (r.v, r.more) for r in store.read("t").collect()}
    assert len(got) == 2000 and got["5"] == (2, "new") and got["6"] == (1, None)
    assert [r.v for r in store.read_keys("t", spark.createDataFrame([("5",)], "k string")).collect()] == [2]
    store.delete("t", spark.createDataFrame([("5",), ("6",)], "k string"))
    store.commit()
    assert store.read("t").count() == 1998


def test_appends_are_merged_after_a_while(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "MOST_PARTS", 2)
    store = TableStore(spark, str(tmp_path / "st"), buckets=2)
    for k in range(5):
        store.append("t", spark.createDataFrame([("k", k), ("x", k)], "k string, v int"), "k")
        store.commit()
    assert sorted((r.k, r.v) for r in store.read("t").collect()) == sorted((n, k) for n in "kx" for k in range(5))
    assert max(len(p) for p in store._newest()[1]["t"]["paths"].values()) <= 3


def test_of_two_runs_from_one_version_one_commits(spark, tmp_path):
    one, two = (TableStore(spark, str(tmp_path / "st"), buckets=4) for _ in range(2))
    row = lambda k: spark.createDataFrame([(k, 1)], "k string, v int")
    one.begin()
    two.begin()
    one.upsert("t", row("a"), ["k"])
    two.upsert("t", row("b"), ["k"])
    one.commit()
    with pytest.raises(ConcurrentCommit):
        two.commit()
    assert [r.k for r in two.read("t").collect()] == ["a"]
    two.begin()
    two.upsert("t", row("b"), ["k"])
    two.commit()
    assert sorted(r.k for r in one.read("t").collect()) == ["a", "b"]
    delete_session(one, "none")  # tables that are not there yet


def test_data_source_reads_and_follows_files(spark, tmp_path):
    tail.register(spark)
    root, out, state = tmp_path / "feed", str(tmp_path / "out"), str(tmp_path / "state")
    append(root / "x" / "one.jsonl", "a", "", "b")
    append(root / "two.jsonl", "c", "half", end="")
    batch = spark.read.format("log_tail").option("path", str(root)).option("splitBytes", "2")
    assert sorted(bytes(r.value) for r in batch.load().collect()) == [b"", b"a", b"b", b"c"]
    offsets = json.dumps({str(root / "x" / "one.jsonl"): 3})
    assert sorted(bytes(r.value) for r in batch.option("offsets", offsets).load().collect()) == [b"b", b"c"]

    def run():
        feed = spark.readStream.format("log_tail").option("path", str(root)).load()
        (feed.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
         .trigger(availableNow=True).start().awaitTermination())
        return sorted(bytes(r.value) for r in spark.read.parquet(out).collect())

    assert run() == [b"", b"a", b"b", b"c"]
    append(root / "two.jsonl", " line", "d")
    append(root / "three.jsonl", "e")
    assert run() == [b"", b"a", b"b", b"c", b"d", b"e", b"half line"]
