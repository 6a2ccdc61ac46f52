"""Column functions against independent Python forms."""

import json
import random

import pytest
from pyspark.sql import functions as F

from logloom.functions import dates as dt
from logloom.functions import errors as er
from logloom.functions import text as tx


def values(spark, rows, build, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r.y for r in df.select("i", build(F.col("x")).alias("y")).orderBy("i").collect()]


def split_by_hand(command):
    """Walks the characters, keeping the open quote as the only state."""
    out, part, quote, i = [], "", "", 0
    while i < len(command):
        c = command[i]
        if c == "\\" and quote != "'" and i + 1 < len(command):
            part, i = part + command[i:i + 2], i + 2
            continue
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        else:
            step = 2 if command[i:i + 2] in ("&&", "||") else 1 if c in ";|" else 0
            if step:
                out, part, i = [*out, part], "", i + step
                continue
        part, i = part + c, i + 1
    return [p.strip() for p in [*out, part] if p.strip()]


def test_shell_split_fuzz(spark):
    rng = random.Random(1)
    rows = ["".join(rng.choice("ab &|;'\"`\\\n$") for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    rows.append("echo " + "a\\ 'q' " * 20000 + "&& ls")
    assert values(spark, rows, tx.shell_split) == [split_by_hand(r) for r in rows]


def test_base_commands(spark):
    rows = ["cd /x && make -j4 2>&1 | tail", "A=1 B_2=x ./run.sh; /usr/bin/python3 a.py", "1abc | _x; .hid",
            "--x=1 | FOO= ", "échec=1 ls", ""]
    assert values(spark, rows, tx.shell_base_commands) == [
        ["cd", "make", "tail"], ["run.sh", "python3"], ["_x", ".hid"], [], ["ls"], []]


def test_char_classes(spark):
    def by_hand(t):
        n = dict.fromkeys(("cjk", "latin", "digit", "space", "other"), 0)
        for c in t:
            o = ord(c)
            if any(lo <= o <= hi for lo, hi in ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x3040, 0x30FF),
                                                (0xAC00, 0xD7AF))):
                n["cjk"] += 1
            elif c.isascii():
                n["latin" if c.isalpha() else "digit" if c.isdigit() else
                  "space" if c in "\t\n\x0b\x0c\r " else "other"] += 1
            else:
                n["space" if c in " 　 \u0085" else "digit" if c in "９½Ⅷ²" else "other"] += 1
        return n

    alphabet = "aZ09 \t\n\x0b?_中あア한９½Ⅷ²é 　 \u0085😀\x01"
    rng = random.Random(2)
    rows = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(500)]
    rows += ["9" * 300_000, " \t" * 200_000]
    got = values(spark, rows, tx.char_classes)
    for t, r in zip(rows, got):
        want = by_hand(t)
        assert {k: r[k] for k in want} == want and r.total == len(t)


def test_names_and_truncation(spark):
    names = ["mcp__plugin_x_Tool__go", "mcp__notes__read", "mcp__a-b", "Bash"]
    assert values(spark, names, tx.tool_group) == ["Tool (MCP)", "notes (MCP)", "mcp__a-b", "Bash"]
    assert values(spark, ["/a/b/", "", "x", None], tx.project_name) == ["b", "(unknown)", "x", "(unknown)"]
    assert values(spark, ["one two  three", "one, two", "abcdefghij"], lambda c: tx.truncate_words(c, 8)) == [
        "one...", "one, two", "abcdefgh..."]
    assert values(spark, ["Read", "NotebookEdit", "GREP", "x"], tx.tool_category) == [
        "file-read", "file-write", "file-search", "other"]
    assert values(spark, ["rollout-1-ABCDEF01-aaaa-bbbb-cccc-0123456789ab", "plain"], tx.uuid_tail) == [
        "ABCDEF01-aaaa-bbbb-cccc-0123456789ab", "plain"]
    assert values(spark, ["  ", " a\nb "], tx.error_summary) == ["(empty error output)", "a b"]


@pytest.mark.parametrize("tz", ["UTC", "Asia/Kolkata"])
def test_night_micros(spark, tz):
    from datetime import datetime, timedelta, timezone
    from zoneinfo import ZoneInfo

    epoch = datetime(1970, 1, 1, tzinfo=timezone.utc)
    rng = random.Random(4)
    rows = [(rng.randrange(1_700_000_000, 1_700_400_000), rng.choice([0, 60, 120, 7200, 100_000, 400_000]))
            for _ in range(60)]

    def by_hand(start, span):
        night = 0
        for s in range(start, start + span, 60):
            night += 60 if 1 <= (epoch + timedelta(seconds=s)).astimezone(ZoneInfo(tz)).hour < 9 else 0
        return night * 1_000_000

    rows = [(s - s % 60, n - n % 60) for s, n in rows]
    df = spark.createDataFrame([(i, s * 1_000_000, n * 1_000_000) for i, (s, n) in enumerate(rows)],
                               "i int, s bigint, n bigint")
    got = [r.y for r in df.select("i", dt.night_micros(F.col("s"), F.col("n"), tz).alias("y"))
           .orderBy("i").collect()]
    assert got == [by_hand(*r) for r in rows]


def test_dates(spark):
    assert values(spark, ["2026-01-05T10:00:00.5Z", "2026-01-05T10:00:00", "2026-01-05", "2026-01-05T11:00:00+01:00",
                          "soon", ""], dt.iso_micros) == [
        1767607200500000, 1767607200000000, 1767571200000000, 1767607200000000, None, None]
    days = values(spark, ["2020-12-31", "2021-01-03", "2024-12-30"], lambda c: dt.period_key(c.cast("date"), "week"))
    assert days == ["2020-W53", "2020-W53", "2025-W01"]
    with pytest.raises(ValueError):
        dt.resolve_range("2026-01-02", "2026-01-01")
    assert values(spark, [0, 1_500_000], dt.iso_text, "bigint") == [
        "1970-01-01T00:00:00+00:00", "1970-01-01T00:00:01.500000+00:00"]


def test_error_rules(spark):
    cases = {
        "EACCES: cannot open": "permission_denied", "zsh: command not found: x": "command_not_found",
        "ENOENT: no such file": "file_not_found", "deadline exceeded": "timeout", "HTTP 429": "rate_limited",
        "connection reset by peer": "network", "403 Forbidden": "auth", "hunk FAILED": "patch_apply_failed",
        "JSONDecodeError: x": "parse_error", "Process exited with code -2": "execution_failure",
        "an exception here": "runtime_exception", "web_search came back: error": "web_search_failure",
        "AssertionError: 1 != 2": "test_failure", "test failed": None, "": None, "Process exited with code 0": None,
    }
    assert values(spark, list(cases), er.error_rule) == list(cases.values())
    words = ["Timed-Out", "in progress", "OK", "cancelled by x", "odd", " "]
    assert values(spark, words, er.status_is_error) == [True, False, False, True, None, None]
    texts = ["Process exited with code 0\nerror", "state = done; error", "fatal: bad", "no errors", "plain", "outcome: odd error"]
    assert values(spark, texts, er.text_is_error) == [False, False, True, False, None, True]
    assert [er.json_verdict(json.dumps(t)) for t in texts] == [False, False, True, False, None, True]


def test_event_times_do_not_follow_the_session_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got = values(spark, ["2024-07-01 12:00:00.25", "1969-12-31 23:59:59"],
                         lambda c: dt.ntz_micros(c.cast("timestamp_ntz")))
            assert got == [1719835200250000, -1000000]
            assert values(spark, ["2026-07-05T10:00:00Z"], dt.iso_micros) == [1783245600000000]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_structured_errors_by_columns_and_walk(spark):
    """Built-in expressions decide codes, flags and words; the walk decides the rest."""
    cases = [
        ('{"exit_code": 2, "ok": true}', True), ('{"exitCode": 0, "error": "fatal"}', False),
        ('{"status_code": " 404 "}', True), ('{"http_status": 200, "failed": true}', False),
        ('{"status_code": true, "failed": true}', False), ('{"failed": false}', False),
        ('{"failed": false, "x": {"exit_code": 1}}', True), ('{"error": "all well, 0 errors"}', False),
        ('{"error": "no errors"}', False), ('{"success": false}', True), ('{"state": "in-progress"}', False),
        ('{"outcome": "refused-timeout"}', True), ('{"message": {"exit_code": 1}, "status": "?"}', True),
        ('{"traceback": ["x"]}', True), ('{"detail": ["x"]}', None), ('[{"ok": true}, {"ok": false}]', True),
        ('[{"ok": true}, 3]', False), ('{"a": [[["fatal"]]]}', True), ('"fatal"', True), ('7', None), ('[]', None)]
    df = spark.createDataFrame(cases, "t string, want boolean")
    flat = er.structured_is_error(F.parse_json("t"))
    got = df.select("t", "want", flat.alias("flat"),
                    F.coalesce(flat, er.json_is_error(F.when(flat.isNull(), F.col("t")))).alias("got")).collect()
    assert [(r.t, r.got) for r in got] == cases
    assert sum(r.flat is not None for r in got) == 10
    assert er.json_verdict("{") is None and er.json_verdict(None) is None
