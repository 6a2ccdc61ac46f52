"""SQL for the log queries: what the rendered lines should become, from the tables themselves."""

from __future__ import annotations

_EV = r"""
    ev AS (
        SELECT event_id AS n, 'a' || ((event_id // 8 * 31 + user_id) % (SELECT greatest(40, count(*) // 2500) FROM events))
               AS session_id, event_type AS kind, props,
               event_type IN ('view', 'click') AS reply, CAST(round(value) AS BIGINT) AS amount, epoch_us(ts) AS ts_us
        FROM events),"""

_REST_A = r"""
    raw_a AS (
        SELECT *, 'blank' AS what, 0 AS ord FROM ev WHERE n % 37 = 0
        UNION ALL SELECT *, 'main', 1 FROM ev
        UNION ALL SELECT *, 'compact', 2 FROM ev WHERE n % 31 = 0),
    lines_a AS (
        SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n, ord) AS line_no FROM raw_a),
    good_a AS (
        SELECT *, CASE WHEN n % 17 = 0 THEN 'progress' WHEN reply THEN 'assistant' ELSE 'user' END AS line_type
        FROM lines_a WHERE session_id <> 'a39' AND what = 'main' AND n % 29 <> 0),
    roles_a AS (
        SELECT *, CASE WHEN n % 9 = 0 THEN 'user'
                       WHEN n % 9 IN (1, 2) THEN CASE WHEN line_type = 'user' THEN 'user' ELSE 'assistant' END
                       WHEN reply THEN 'assistant' ELSE 'user' END AS role
        FROM good_a),
    msg_a AS (
        SELECT *, CASE WHEN line_type <> 'progress' THEN line_type ELSE role END AS record_type,
               CASE WHEN reply THEN CASE n % 4 WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE amount END END AS tin,
               CASE WHEN reply THEN 3 END AS tout,
               CASE WHEN kind NOT IN ('purchase', 'error') THEN NULL
                    WHEN n % 6 IN (0, 1) THEN 'true' WHEN n % 6 IN (2, 5) THEN 'false' ELSE 'unknown' END AS flag
        FROM roles_a)"""
_A = _EV + _REST_A

_B = r"""
    turns AS (
        SELECT 'b' || number AS session_id, *
        FROM (SELECT conv_id % (SELECT greatest(50, count(*) // 2500) FROM conversations) AS number,
                     conv_id * 64 + turn AS place, turn, role, role = 'user' AS usr
              FROM conversations)),
    heads AS (SELECT DISTINCT session_id, number FROM turns),
    raw_b AS (
        SELECT session_id, -1 AS place, NULL AS turn, 'user' AS role, 'session_meta' AS what, 0 AS ord FROM heads
        UNION ALL SELECT session_id, place, turn, role, 'prompt', 1 FROM turns WHERE usr
        UNION ALL SELECT session_id, place, turn, role, 'said', 2 FROM turns WHERE NOT usr OR turn % 4 = 0
        UNION ALL SELECT session_id, place, turn, 'assistant', 'call', 3 FROM turns WHERE NOT usr
        UNION ALL SELECT session_id, place, turn, 'user', 'result', 4 FROM turns WHERE NOT usr
        UNION ALL SELECT session_id, place, turn, 'assistant', 'tok', 5 FROM turns WHERE turn % 3 = 1
        UNION ALL SELECT session_id, place, turn, NULL, 'turn_context', 6 FROM turns WHERE turn = 0
        UNION ALL SELECT session_id, place, turn, NULL, 'telemetry', 7 FROM turns WHERE turn = 5),
    lines_b AS (
        SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY place, ord) AS line_no FROM raw_b),
    before_b AS (SELECT * FROM lines_b WHERE what NOT IN ('turn_context', 'telemetry')),
    msg_b AS (SELECT * FROM before_b WHERE NOT (what = 'said' AND role = 'user')),
    link_b AS (
        SELECT session_id,
               CASE WHEN number % 5 > 0 AND number % 2 = 1 THEN 'b' || (number - number % 5) END AS parent_session_id,
               CASE WHEN number % 5 > 0 AND number % 2 = 0 THEN 'b' || (number - number % 5) END AS root_session_id
        FROM heads)"""

# the grown store: a39 breaks when it grows and keeps its first lines, a2 is written anew with its later ones
_GROWN_A = (_EV.replace("ev AS", "every_event AS") + r"""
    cut_a AS (SELECT max(n) * 2 // 3 AS c FROM every_event),
    ev AS (
        SELECT e.* FROM every_event e, cut_a
        WHERE NOT (session_id = 'a2' AND n <= c) AND NOT (session_id = 'a39' AND n > c)),"""
            + _REST_A.replace("WHERE session_id <> 'a39' AND what", "WHERE what"))
_CUT_B = r"""
    cut_b AS (SELECT max(place) * 2 // 3 AS c FROM turns)"""

_ALL = f"""
    files AS (SELECT DISTINCT 'rendered_a' AS ecosystem, session_id AS session FROM ev
              UNION ALL SELECT 'rendered_b', session_id FROM heads)"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts)


def statements() -> dict[str, str]:
    a, b, both = _with(_A), _with(_B), _with(_A, _B, _ALL)
    grown = _with(_GROWN_A, _B, _CUT_B)
    # an id whose results come before any call of it counts as one call
    sessions = """
            SELECT 'rendered_a' AS ecosystem, session_id, NULL AS parent_session_id, NULL AS root_session_id,
                   session_id AS logical_session_id, count(*) AS total_messages,
                   CAST(coalesce(sum(tin + tout), 0) AS BIGINT) AS total_tokens,
                   count(*) FILTER (kind = 'click') + count(DISTINCT n % 5) FILTER (orphan) AS total_tool_calls
            FROM (SELECT *, kind IN ('purchase', 'error') AND coalesce(n < min(CASE WHEN kind = 'click' THEN n END)
                         OVER (PARTITION BY session_id, n % 5), true) AS orphan FROM msg_a)
            GROUP BY session_id
            UNION ALL
            SELECT 'rendered_b', session_id, any_value(parent_session_id), any_value(root_session_id),
                   coalesce(any_value(root_session_id), any_value(parent_session_id), session_id), count(*),
                   CAST(coalesce(sum(CASE WHEN what = 'tok' THEN turn * 11 END), 0) AS BIGINT),
                   count(*) FILTER (what = 'call')
            FROM msg_b JOIN link_b USING (session_id) GROUP BY session_id"""
    return {
        "log_grown_runs": f"""{grown},
            states AS (
                SELECT session_id, bool_or(n <= c) AS one, bool_or(n > c) AS two FROM every_event, cut_a GROUP BY 1
                UNION ALL
                SELECT session_id, true, bool_or(place > c) FROM turns, cut_b GROUP BY 1)
            SELECT 0 AS run, count(*) FILTER (one) AS parsed, 0 AS skipped, 0 AS errors, 0 AS resumed FROM states
            UNION ALL
            SELECT 1, count(*) FILTER (two AND session_id <> 'a39'), count(*) FILTER (NOT two AND session_id <> 'a39'),
                   count(*) FILTER (session_id = 'a39'),
                   count(*) FILTER (one AND (two OR session_id = 'a39') AND session_id <> 'a2') FROM states""",
        "log_grown_compactions": f"""{grown}
            SELECT session_id, line_no, 'auto' AS trigger, n AS pre_tokens
            FROM lines_a WHERE what = 'compact' AND session_id <> 'a1'""",
        "log_grown_sessions": f"{grown} SELECT * FROM ({sessions}) WHERE session_id <> 'a1'",
        "log_grown_messages": f"""{grown}
            SELECT session_id AS session, count(*) AS messages, CAST(sum(line_no) AS BIGINT) AS line_sum
            FROM (SELECT session_id, line_no FROM msg_a UNION ALL SELECT session_id, line_no FROM before_b)
            GROUP BY 1""",
        "log_files": f"""{both}
            SELECT ecosystem, session, CASE WHEN session = 'a39' THEN 'error' ELSE 'parsed' END AS parse_status,
                   'run' AS last_parsed_at FROM files""",
        # a file in error is read again by the second run, all others are skipped
        "log_ingest_runs": f"""{both}
            SELECT 0 AS run, count(*) FILTER (session <> 'a39') AS parsed, 0 AS skipped,
                   count(*) FILTER (session = 'a39') AS errors FROM files
            UNION ALL
            SELECT 1, 0, count(*) FILTER (session <> 'a39'), count(*) FILTER (session = 'a39') FROM files""",
        "log_ingest_errors": f"""{a}
            SELECT session_id AS session, max(line_no) + 1 AS line_no, 'invalid JSON' AS reason
            FROM lines_a WHERE session_id = 'a39' GROUP BY 1""",
        "log_messages_a": f"""{a}
            SELECT session_id, record_type, role, count(*) AS messages, CAST(sum(line_no) AS BIGINT) AS line_sum,
                   count(*) FILTER (n % 23 = 0) AS inferred, count(*) FILTER (reply) AS with_usage,
                   CAST(sum(tin) AS BIGINT) AS input_tokens, CAST(sum(tout) AS BIGINT) AS output_tokens,
                   count(*) FILTER (kind IN ('view', 'signup')) AS plain
            FROM msg_a GROUP BY ALL""",
        "log_inferred_times": f"""{a}
            SELECT session_id, line_no, 'u' || n AS uuid, printf('1970-01-01T00:00:%02dZ', line_no % 60) AS timestamp,
                   (line_no % 60) * 1000000 AS ts_us
            FROM msg_a WHERE n % 23 = 0""",
        "log_results_a": f"""{a}
            SELECT session_id, CASE kind WHEN 'click' THEN 'tool_use' WHEN 'purchase' THEN 'tool_result'
                                         WHEN 'error' THEN 'tool_result' ELSE 'string' END AS block_type,
                   coalesce(flag, 'unknown') AS flag, count(*) AS blocks,
                   CAST(sum(CASE WHEN flag IS NOT NULL THEN length(props) END) AS BIGINT) AS result_chars
            FROM msg_a GROUP BY ALL""",
        "log_compactions": f"""{a}
            SELECT session_id, line_no, 'auto' AS trigger, n AS pre_tokens
            FROM lines_a WHERE what = 'compact' AND session_id <> 'a39'""",
        "log_compact_counts": f"""{both}
            SELECT session_id, CAST(sum(c) AS BIGINT) AS compact_count FROM (
                SELECT session_id, 0 AS c FROM msg_a UNION ALL SELECT session_id, 0 FROM heads
                UNION ALL SELECT session_id, 1 FROM lines_a WHERE what = 'compact' AND session_id <> 'a39')
            GROUP BY 1""",
        "log_sessions": both + sessions,
        "log_messages_b": f"""{b}
            SELECT session_id, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS record_type, role,
                   count(*) AS messages, CAST(sum(line_no) AS BIGINT) AS line_sum,
                   CAST(sum(CASE WHEN what = 'tok' THEN turn * 10 END) AS BIGINT) AS input_tokens,
                   CAST(sum(CASE WHEN what = 'tok' THEN turn END) AS BIGINT) AS output_tokens,
                   CAST(sum(CASE WHEN what = 'tok' THEN 1 END) AS BIGINT) AS cache_read_tokens
            FROM msg_b GROUP BY ALL""",
        "log_results_b": f"""{b}
            SELECT session_id, CASE place % 5 WHEN 0 THEN turn % 3 <> 0 WHEN 1 THEN true WHEN 2 THEN true
                                              ELSE false END AS is_error, count(*) AS results
            FROM msg_b WHERE what = 'result' GROUP BY ALL""",
        "log_diagnostics_b": f"""{b}
            SELECT session_id AS session, 'raw' AS section,
                   CASE what WHEN 'prompt' THEN 'event_msg' WHEN 'tok' THEN 'event_msg' WHEN 'said' THEN 'response_item'
                             WHEN 'call' THEN 'response_item' WHEN 'result' THEN 'response_item' ELSE what END AS key,
                   count(*) AS count FROM lines_b GROUP BY ALL
            UNION ALL SELECT session_id, 'dropped', what, count(*) FROM lines_b WHERE what = 'telemetry' GROUP BY ALL
            UNION ALL SELECT session_id, 'policy_dropped', what, count(*) FROM lines_b
                      WHERE what = 'turn_context' GROUP BY ALL
            UNION ALL SELECT session_id, 'messages_before_dedupe', 'all', count(*) FROM before_b GROUP BY ALL
            UNION ALL SELECT session_id, 'messages_after_dedupe', 'all', count(*) FROM msg_b GROUP BY ALL""",
        "log_lineage_b": f"{b} SELECT session_id, parent_session_id, root_session_id FROM link_b",
    }
