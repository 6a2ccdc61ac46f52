"""Order-dependent, rank, interval and cluster operators against brute force."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.functions.dates import SECOND
from logloom.operators import clustering as clu
from logloom.operators.coverage import MINUTE, merge_intervals, union_measure
from logloom.operators.pairing import pair_tools
from logloom.operators.ranks import summarize
from logloom.operators.segments import with_carried, with_neighbours
from logloom.operators import similarity as sim
from logloom.operators.similarity import similarity_links
from logloom.operators.sessions import (
    BrowseFilters,
    automation_range,
    browse_sessions,
    list_sessions,
    logical_view,
)


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_neighbours_do_not_depend_on_the_segment_size(spark, size):
    rng = random.Random(5)
    rows = [(f"s{rng.randint(0, 3)}", line, rng.choice([None, line * 10])) for line in
            rng.sample(range(200), 60)]
    df = spark.createDataFrame(rows, "s string, line_no bigint, v bigint")
    got = {(r.s, r.line_no): (r.p, r.f, r.i, r.n) for r in with_neighbours(
        df, ["s"], previous={"p": "v"}, following={"f": "v"}, position="i", total="n", size=size).collect()}
    want = {}
    for s in {r[0] for r in rows}:
        mine = sorted(r for r in rows if r[0] == s)
        for i, r in enumerate(mine):
            want[(s, r[1])] = (mine[i - 1][2] if i else None,
                               mine[i + 1][2] if i + 1 < len(mine) else None, i, len(mine))
    assert got == want


@pytest.mark.parametrize("size", [1, 4, 1000])
def test_carried_values_cross_segments(spark, size):
    rng = random.Random(6)
    rows = [("s", line, rng.choice([None, None, line])) for line in rng.sample(range(100), 50)]
    df = spark.createDataFrame(rows, "s string, line_no bigint, v bigint")
    got = {r.line_no: r.c for r in with_carried(
        df, ["s"], {"c": F.col("v")}, order=["line_no"], size=size).collect()}
    last, want = None, {}
    for _, line, v in sorted(rows):
        want[line] = last
        last = v if v is not None else last
    assert got == want


@pytest.mark.parametrize("size", [2, 1000])
def test_pairs_take_the_latest_earlier_call(spark, size):
    rng = random.Random(7)
    rows = []
    for line in range(60):
        is_use = rng.random() < 0.5
        rows.append((f"s{line % 2}", line, 0, "tool_use" if is_use else "tool_result",
                     rng.choice(["", "a", "b", None]), f"t{line}" if is_use else None,
                     rng.randint(0, 100) * SECOND, None, None))
    df = spark.createDataFrame(rows, """session_id string, line_no bigint, block_no int, block_type string,
        tool_id string, tool_name string, ts_us bigint, command string, is_error boolean""")
    got = {r.line_no: (r.call_name, r.latency_us) for r in pair_tools(df, size).collect()}
    want = {}
    for r in rows:
        if r[3] == "tool_result":
            calls = [c for c in rows if c[3] == "tool_use" and c[0] == r[0] and c[1] < r[1]
                     and (c[4] or "") == (r[4] or "")]
            call = calls[-1] if calls else None
            late = r[6] - call[6] if call else None
            want[r[1]] = (call[5] if call else None, late if late is not None and late >= 0 else None)
    assert got == want


def test_exact_ranks(spark):
    rng = random.Random(8)
    data = {"one": [3.5], "two": [1.0, 2.0], "ties": [7.0] * 400 + [1.0, 9.0],
            "many": [rng.expovariate(1e-6) for _ in range(3001)], "even": [rng.gauss(0, 1) for _ in range(1000)]}
    rows = [(k, v) for k, vs in data.items() for v in [*vs, None]]
    got = {r.measure: r for r in summarize(
        spark.createDataFrame(rows, "measure string, value double").repartition(7)).collect()}
    for k, vs in data.items():
        assert got[k].n == len(vs) and got[k]["mean"] == pytest.approx(statistics.mean(vs))
        assert got[k].median == statistics.median(vs)
        assert got[k].p90 == sorted(vs)[max(0, math.ceil(0.9 * len(vs)) - 1)]


def test_interval_unions(spark):
    rng = random.Random(9)
    rows = []
    for _ in range(300):
        start = rng.randrange(0, 3 * 86_400) * SECOND + rng.choice([0, 1, 500_000])
        rows.append((rng.choice("ab"), start, start + rng.choice(
            [0, 1, 30 * SECOND, MINUTE, 2 * MINUTE, 600 * SECOND, 7200 * SECOND])))
    df = spark.createDataFrame(rows, "k string, start_us bigint, end_us bigint")
    merged = {}
    for k, s, e in sorted(r for r in rows if r[2] > r[1]):
        mine = merged.setdefault(k, [])
        if mine and s <= mine[-1][1]:
            mine[-1][1] = max(mine[-1][1], e)
        else:
            mine.append([s, e])
    kept = df.filter("end_us > start_us")
    got = {}
    for r in merge_intervals(kept, ["k"]).orderBy("start_us").collect():
        got.setdefault(r.k, []).append([r.start_us, r.end_us])
    assert got == merged

    def night(s, e):
        total = 0
        for day in range(4):
            lo, hi = (day * 86_400 + 3_600) * SECOND, (day * 86_400 + 9 * 3_600) * SECOND
            total += max(0, min(e, hi) - max(s, lo))
        return total

    measured = {r.k: (r.covered_us, r.night_us) for r in union_measure(df, ["k"]).collect()}
    assert measured == {k: (sum(e - s for s, e in v), sum(night(s, e) for s, e in v)) for k, v in merged.items()}


def unit(rows):
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


@pytest.mark.parametrize("block", [3, 500])
def test_leader_clusters(spark, block):
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(60, 4))
    df = spark.createDataFrame([(f"{i:03d}", r.tolist()) for i, r in enumerate(rows)],
                               "id string, vector array<double>").repartition(3)
    u, leaders, want = unit(rows), [], {}
    for i in range(len(rows)):
        sims = [(float(u[j] @ u[i]), -j) for j in leaders]
        if not sims or max(sims)[0] < 0.7:
            leaders.append(i)
            want[f"{i:03d}"] = f"{i:03d}"
        else:
            want[f"{i:03d}"] = f"{-max(sims)[1]:03d}"
    got = {r.id: r.leader for r in clu.leader_clusters(df, 0.7, block=block).collect()}
    assert got == want and len(leaders) > 3


def test_cluster_run(spark):
    rows = [("a", [1.0, 0.0]), ("b", [0.99, 0.01]), ("c", [0.0, 1.0])]
    df = spark.createDataFrame(rows, "id string, vector array<double>")
    found = clu.leader_clusters(df, 0.95)
    got = {r.id: r.leader for r in found.collect()}
    assert got["a"] == got["b"] != got["c"]
    run = clu.run_snapshot(found, run_id="r", generated_at="t", model_id="m", threshold=0.95,
                           cluster="leader").first()
    assert (run.session_count, run.cluster_count) == (3, 2)
    with pytest.raises(Exception, match="dimension"):
        clu.check_dimension(spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])],
                                                  "id string, vector array<double>")).collect()


SESSIONS = [  # id, logical, created, tokens, ratio
    ("r1", "r1", 1, 50, 0.5), ("c1", "r1", 3, 90, None), ("c2", "r1", 2, 10, 2.0),
    ("x1", "gone", 5, 70, 1.0), ("x2", "gone", 4, None, 3.0)]


def sessions(spark):
    return spark.createDataFrame(
        [(i, lo, "e", c, f"2026-01-0{c}T00:00:00+00:00", f"2026-01-0{c}T00:00:00+00:00", t, t, r, "/p/Alpha", None)
         for i, lo, c, t, r in SESSIONS],
        """session_id string, logical_session_id string, ecosystem string, created_us bigint, created_at string,
        updated_at string, total_tokens bigint, total_messages bigint, automation_ratio double,
        project_path string, bottleneck string""")


def test_logical_lists(spark):
    df = sessions(spark)
    assert {r.session_id for r in logical_view(df).collect()} == {"r1", "x1"}

    def ids(**q):
        return [r.session_id for r in list_sessions(df, **q).collect()]

    assert ids(sort_by="tokens") == ["c1", "x1", "r1", "c2", "x2"]
    assert ids(sort_by="tokens", sort_order="ASC", limit=2, offset=1) == ["c2", "r1"]
    # the root stands where the first member of its lineage stands
    assert ids(sort_by="tokens", view_mode="logical") == ["r1", "x1"]
    assert ids(sort_by="created", sort_order="ASC", view_mode="logical") == ["r1", "x2"]
    assert ids(min_automation=0.5, max_tokens=60, end_date="2026-01-02") == ["c2", "r1"]
    assert automation_range("medium", 5, 0) == (1, 3) and automation_range("high", None, 2) == (2, 3)
    found = browse_sessions(df, BrowseFilters(search="ALPHA", automation_band="medium", sort_by="tokens"))
    assert [r.session_id for r in found.collect()] == ["x1", "c2", "x2"]


def test_report_watermark(spark, tmp_path):
    from logloom.plans.report import read_watermark, run_report
    from logloom.sources.store import TableStore

    store = TableStore(spark, str(tmp_path))
    assert read_watermark(store) is None
    assert not run_report(store, manual=False, now_iso="t1", send=lambda: False) and read_watermark(store) is None
    assert run_report(store, manual=True, now_iso="t1", send=lambda: True) and read_watermark(store) is None
    assert run_report(store, manual=False, now_iso="t2", send=lambda: True) and read_watermark(store) == "t2"


@pytest.mark.parametrize("chunk", [7, 500])
def test_similarity_links(spark, chunk):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(6, 8))
    rows = np.stack([base[i % 6] + rng.normal(size=8) * 0.5 for i in range(120)])
    rows[7] = rows[9] = rows[3]
    rows[11] = 0
    df = spark.createDataFrame([(f"{i:03d}", r.tolist()) for i, r in enumerate(rows)] + [("900", None), ("901", [])],
                               "id string, vector array<double>")
    u = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)
    sims = u @ u.T
    np.fill_diagonal(sims, -2)
    want = {f"{i:03d}": ("003" if i in (7, 9) else f"{i:03d}", int((sims[i] >= 0.6).sum())) for i in range(120)}
    got = {r.id: (r.class_id, r.n_links) for r in similarity_links(df, 0.6, chunk).collect()}
    assert got == {**want, "900": ("900", 0), "901": ("901", 0)}
    assert similarity_links(df.limit(0), 0.6).count() == 0


def test_vectors_are_not_written_for_each_cell_they_visit(spark, monkeypatch):
    written = []

    def stage(df, name, real=sim.stage):
        out = real(df, name)
        one = {"vectors": F.size("ids"), "vector": F.lit(1)}
        written.extend(out.agg(F.sum(n)).first()[0] or 0 for c, n in one.items() if c in out.columns)
        return out

    monkeypatch.setattr(sim, "stage", stage)
    rows = np.random.default_rng(4).normal(size=(200, 8))
    df = spark.createDataFrame([(f"{i:03d}", r.tolist()) for i, r in enumerate(rows)], "id string, vector array<double>")
    sims = unit(rows) @ unit(rows).T
    assert {r.id: r.n_links for r in similarity_links(df, 0.1, 10).collect()} == {
        f"{i:03d}": int((sims[i] >= 0.1).sum()) - 1 for i in range(200)}
    assert sum(written) <= 2 * 200
    written.clear()
    assert clu.leader_clusters(df, 0.1, block=10).count() == 200
    assert sum(written) <= 4 * 200


def test_marks_of_two_classes_and_many_rounds(spark, monkeypatch):
    """Unlike vectors with one mark keep their classes; rounds of few rows elect the same leaders; signed zeros are equal."""
    rng = np.random.default_rng(5)
    rows = np.round(rng.normal(size=(60, 3)), 1).astype("float32")
    rows[5], rows[6], rows[50] = [0.0, 1.0, 0.0], [-0.0, 1.0, -0.0], rows[4]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)] + [(90, None), (91, [])],
                               "id bigint, vector array<float>")
    u = unit(rows.astype("float64"))
    sims = u @ u.T
    first = [next(j for j in range(60) if (rows[j] == rows[i]).all()) for i in range(60)]
    want = {i: (first[i], int((sims[i] >= 0.8).sum()) - 1) for i in range(60)}
    leaders = []
    for i in range(60):
        if all(sims[i, j] < 0.8 for j in leaders):
            leaders.append(i)
    led = {i: i if i in leaders else max(leaders, key=lambda j: (sims[i, j] if j < i else -2, -j)) for i in range(60)}
    monkeypatch.setattr(sim, "PART", 64)
    for mark in (sim._mark, lambda vector: F.lit(1).cast("bigint")):
        monkeypatch.setattr(sim, "_mark", mark)
        assert {r.id: (r.class_id, r.n_links) for r in similarity_links(df, 0.8, 7).collect()} == {
            **want, 90: (90, 0), 91: (91, 0)}
    monkeypatch.setattr(sim, "ELECTED", 9)
    found = sim.fixed_leaders(df, 0.8, 7).collect()
    assert {r.id: r.leader for r in found} == {**led, 90: 90, 91: 91} and len(found) == 62
