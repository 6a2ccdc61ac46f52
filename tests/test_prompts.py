"""Prompt matching in pieces against one pass over all lines."""

import random

import pytest

from logloom.sources.prompts import Matcher, match_prompts

SCHEMA = "source_path string, k string, line_no bigint, ts_us bigint, event boolean"


def moves_of(rows, width):
    """{(file, line): place} by the rule over a list of all kept copies."""
    out, kept = {}, {}
    for path, k, line, at, event in sorted(rows, key=lambda r: r[2]):
        own = kept.setdefault((path, k), [])
        hits = [c for c in own if c["event"] != event and abs(c["at"] - at) <= width]
        if not hits:
            own.append({"line": line, "at": at, "event": event, "place": line})
        elif event:
            hit = hits[-1]
            out[path, hit["line"]] = None
            out[path, line] = hit["place"]
            hit.update(line=line, at=at, event=True)
        else:
            out[path, line] = None
    return out


def rows_of(rnd, n, step, back):
    out, clock = [], 0
    for line in range(1, n + 1):
        clock += rnd.choice(step)
        out.append((rnd.choice(["f", "g"]), rnd.choice("xyy"), line, max(clock - rnd.choice(back), 0), rnd.random() < 0.5))
    return out


@pytest.mark.parametrize("step,back", [([0, 1, 2], [0]), ([1, 3, 30], [0]), ([0, 0, 1], [0, 0, 5, 40]), ([0], [0])])
@pytest.mark.parametrize("piece", [4, 1 << 15])
def test_pieces_equal_one_pass(spark, step, back, piece):
    rows = rows_of(random.Random(piece + len(step)), 260, step, back)
    got = match_prompts(spark.createDataFrame(rows, SCHEMA), 4, piece).collect()
    assert {(r.source_path, r.line_no): r.place for r in got} == moves_of(rows, 4)


def test_one_prompt_repeated_without_end(spark):
    """Many equal prompts of one file: pieces stay small, and so does the state that is handed on."""
    n = 120_000
    rows = spark.range(1, n + 1).selectExpr("'f' as source_path", "'k' as k", "id as line_no",
                                            "id * 100000 as ts_us", "id % 3 = 0 as event")
    got = match_prompts(rows, 2_000_000, piece=1 << 13)
    assert got.filter("place is null").count() == 2 * n // 3  # every item copy meets an event copy
    assert got.filter("place is not null").count() == 2  # items 1 and 2; from line 3 on items come after events
    matcher = Matcher(2_000_000, [], [])
    for line in range(1, 5000):
        matcher.add(line, line * 100_000, line % 3 == 0)
        matcher.forget(line * 100_000)
        assert len(matcher.events) + len(matcher.items) <= 25


def test_nothing_to_match(spark):
    assert match_prompts(spark.createDataFrame([], SCHEMA), 4).count() == 0
