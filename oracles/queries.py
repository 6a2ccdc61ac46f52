"""One statement per registered query that SQL can express on the whole tables."""

from __future__ import annotations

from oracles import logs
from oracles.ctes import category_sql, keep, ratio, rule_sql, with_ctes

_DOUBLES = """model_time_percent tool_time_percent user_time_percent inactive_time_percent
active_time_ratio interactions_per_hour input_percent output_percent cache_read_percent
cache_creation_percent user_yield_ratio_tokens user_yield_ratio_chars avg_tokens_per_second
read_tokens_per_second output_tokens_per_second cache_tokens_per_second
cache_read_tokens_per_second cache_creation_tokens_per_second avg_tokens_per_message
avg_commands_per_call duration_seconds automation_ratio""".split()
_MEASURES = """user_yield_ratio_tokens user_yield_ratio_chars avg_tokens_per_second
read_tokens_per_second output_tokens_per_second cache_tokens_per_second
cache_read_tokens_per_second cache_creation_tokens_per_second""".split()
_SUMS = """total_messages total_tokens total_tool_calls total_input_tokens total_output_tokens
tool_tokens cache_read_tokens cache_creation_tokens trajectory_file_size_bytes total_chars
user_chars model_chars tool_chars cjk_chars latin_chars other_chars model_us tool_us user_us
inactive_us model_timeout_count""".split()
_EXPORTED = [
    ("Total Messages", "message_count"), ("User Messages", "user_message_count"),
    ("Assistant Messages", "assistant_message_count"), ("Total Tokens", "total_tokens"),
    ("Input Tokens", "total_input_tokens"), ("Output Tokens", "total_output_tokens"),
    ("Cache Read Tokens", "cache_read_tokens"), ("Cache Creation Tokens", "cache_creation_tokens"),
    ("Total Tool Calls", "total_tool_calls"), ("Subagent Count", "subagent_count"),
    ("Session Duration (seconds)", "duration_seconds"),
    ("Model Time (seconds)", "round(model_us / 1e6, 2)"), ("Tool Time (seconds)", "round(tool_us / 1e6, 2)"),
    ("User Time (seconds)", "round(user_us / 1e6, 2)"), ("Model Time %", "round(model_time_percent, 1)"),
    ("Tool Time %", "round(tool_time_percent, 1)"), ("User Time %", "round(user_time_percent, 1)"),
    ("Inactive Time (seconds)", "round(inactive_us / 1e6, 2)"),
    ("Inactive Time %", "round(inactive_time_percent, 1)")]
_FRESH_SUMS = """total_messages total_tokens total_tool_calls total_input_tokens
total_output_tokens tool_error_count trajectory_file_size_bytes total_chars cjk_chars latin_chars
model_us tool_us user_us inactive_us model_timeout_count""".split()


def r(x: str, name: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) AS {name}"


def s(x: str, name: str | None = None) -> str:
    return f"CAST(coalesce(sum({x}), 0) AS BIGINT) AS {name or x}"


def night_before(t: str) -> str:
    return (f"(({t}) // 86400000000 * 28800000000 + "
            f"least(greatest(({t}) % 86400000000 - 3600000000, 0), 28800000000))")


def night(start: str, span: str) -> str:
    return f"({night_before(f'{start} + {span}')} - {night_before(start)})"


#: Vectors in id order, each a leader unless an earlier leader is similar.
_LEADERS = """
      WITH RECURSIVE x AS (
        SELECT lpad(CAST(vec_id AS VARCHAR), 12, '0') AS id, embedding::DOUBLE[] AS e FROM embeddings),
      near AS (
        SELECT a.id AS earlier, b.id, list_cosine_similarity(a.e, b.e) AS similarity
        FROM x a JOIN x b ON a.id < b.id AND list_cosine_similarity(a.e, b.e) >= 0.3),
      places AS (
        SELECT id, row_number() OVER (ORDER BY id) AS place,
               coalesce((SELECT list(earlier) FROM near WHERE near.id = x.id), []) AS known FROM x),
      elected(place, leaders) AS (
        SELECT 0::BIGINT, []::VARCHAR[]
        UNION ALL
        SELECT p.place, CASE WHEN list_has_any(leaders, known) THEN leaders ELSE list_append(leaders, id) END
        FROM elected e JOIN places p ON p.place = e.place + 1),
      leaders AS (SELECT unnest(leaders) AS id FROM elected WHERE place = (SELECT max(place) FROM elected)),
      members AS (
        SELECT id, id AS leader, 1.0::DOUBLE AS similarity FROM leaders
        UNION ALL
        SELECT n.id, earlier, round(similarity, 4) FROM near n JOIN leaders l ON l.id = earlier
        WHERE n.id NOT IN (SELECT id FROM leaders)
        QUALIFY row_number() OVER (PARTITION BY n.id ORDER BY similarity DESC, earlier) = 1)"""

_SPAN = "CASE WHEN duration_us > 0 THEN duration_us ELSE span_us END"
_NIGHT = f"coalesce({night('created_us', _SPAN)} / nullif({_SPAN}, 0), 0)"


def _day_night(rows: str) -> str:
    cols = []
    for k in ("model", "tool", "user", "inactive"):
        cols.append(f"sum({k}_us * (1 - {_NIGHT})) / 1e6 AS day_{k}_seconds")
        cols.append(f"sum({k}_us * {_NIGHT}) / 1e6 AS night_{k}_seconds")
    return f"SELECT {', '.join(cols)} FROM {rows}"


_LOW, _HIGH = "1704240000000000", "1705795200000000"


def _coverage(select: str) -> str:
    """Islands per role by a running maximum, then day and night by closed form."""
    return f"""
    , roles AS (
      SELECT role, greatest(created_us, {_LOW}) AS a, least(created_us + {_SPAN}, {_HIGH}) AS b
      FROM (SELECT *, unnest(['model', 'tool', 'user']) AS role FROM windowed)
      WHERE CASE role WHEN 'model' THEN model_us WHEN 'tool' THEN tool_us ELSE user_us END > 0),
    marked AS (
      SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY role ORDER BY a, b
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh
      FROM roles WHERE b > a),
    numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY role ORDER BY a, b
                 ROWS UNBOUNDED PRECEDING) AS island FROM marked),
    islands AS (SELECT role, island, min(a) AS a, max(b) AS b FROM numbered GROUP BY ALL),
    sums AS (SELECT role, sum(b - a) AS covered, sum({night('a', '(b - a)')}) AS dark
             FROM islands GROUP BY role),
    cov AS (
      SELECT role, least(covered - dark, 18 * 57600000000) / 1e6 AS day_seconds,
        least(dark, 18 * 28800000000) / 1e6 AS night_seconds,
        18 * 57600.0 AS day_window_seconds, 18 * 28800.0 AS night_window_seconds
      FROM sums)
    {select} FROM cov"""


def coverage_sql(select: str) -> str:
    head = with_ctes("SELECT * FROM windowed")
    return head[: head.rindex("SELECT * FROM windowed")] + _coverage(select).lstrip()


def share(part: str, whole: str, name: str) -> str:
    return r(f"coalesce({part} * 100 / nullif({whole}, 0), 0)", name)


def _dist(key: str, rows: str = "rows", label: str | None = None) -> str:
    return f"""SELECT key, {label or 'key'} AS label, sessions, sessions AS value,
      {share('sessions', 'sum(sessions) OVER ()', 'percent')}
      FROM (SELECT {key} AS key, count(*) AS sessions FROM {rows} GROUP BY ALL)"""


_MEDIAN = ", ".join(
    f"('{m}', (SELECT count({m}) FROM rows), (SELECT avg({m}) FROM rows), "
    f"(SELECT median({m}) FROM rows), (SELECT quantile_disc({m}, 0.9) FROM rows))" for m in _MEASURES)

RAW = {
    "time_attribution": "SELECT * FROM totals",
    "gap_rows": "SELECT session_id, line_no, gap_us, gap_kind, is_timeout FROM g",
    "time_by_session": "SELECT session_id, model_us, tool_us, user_us, inactive_us, model_timeout_count FROM totals",
    "activity_windows": """
      SELECT session_id, min(ts_us) AS start_us, max(ts_us) AS end_us, count(*) AS messages
      FROM (SELECT *, sum(CASE WHEN gap_kind = 'inactive' THEN 1 ELSE 0 END)
              OVER (PARTITION BY session_id ORDER BY line_no) AS part FROM g)
      GROUP BY session_id, part""",
    "tool_pairs": """
      SELECT session_id, line_no, tool_id, matched, name, call_us, latency_us,
        array_to_string(commands, ',') AS commands FROM bash_pairs""",
    "orphan_results": """
      SELECT session_id, name, count(DISTINCT tool_id) AS orphans FROM pairs WHERE NOT matched GROUP BY ALL""",
    "tool_stats": f"SELECT * REPLACE ({r('avg_latency_seconds', 'avg_latency_seconds', 8)}) FROM tools",
    "tool_group_stats": f"""
      SELECT session_id, tool_group, {s('calls')}, {s('total_tokens')}, {s('success_count')},
        {s('error_count')}, {s('latency_us')}, count(*) AS tool_count,
        {r('coalesce(sum(latency_us) / (nullif(sum(calls), 0) * 1e6), 0)', 'avg_latency_seconds', 8)}
      FROM tools GROUP BY session_id, tool_group""",
    "tool_success": f"""
      SELECT session_id, tool_name, calls, total_tokens, error_count,
        {r('success_rate', 'success_rate')}, {r('avg_tokens', 'avg_tokens')} FROM patterns""",
    "tool_categories": f"""
      SELECT CASE WHEN tool_name = 'Bash' THEN 'execution' ELSE 'other' END AS category, {s('calls')}
      FROM tools GROUP BY 1""",
    "top_tools_by_session": """
      SELECT session_id, tool_rank, tool_name, calls FROM (
        SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY calls DESC, tool_name) AS tool_rank
        FROM tools) WHERE tool_rank <= 3""",
    "error_prone_tools": """
      SELECT session_id, tool_rank, tool_name, error_count FROM (
        SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY error_count DESC, tool_name) AS tool_rank
        FROM tools WHERE error_count > 0) WHERE tool_rank <= 2""",
    "error_records": """
      SELECT session_id, line_no, CAST(0 AS BIGINT) AS block_no, ts_us, tool_name, tool_call_id, category,
        matched_rule, result_text AS summary, result_text AS detail_snippet, result_text AS detail
      FROM errors""",
    "error_categories": "SELECT session_id, category, count(*) AS errors FROM errors GROUP BY ALL",
    "shell_distribution": """
      SELECT session_id, len(commands) AS commands_per_call, count(*) AS calls,
        CASE WHEN len(commands) >= 4 THEN '4+' ELSE CAST(len(commands) AS VARCHAR) END AS band
      FROM cmds WHERE commands IS NOT NULL GROUP BY ALL""",
    "shell_commands": f"""
      SELECT session_id, command_name, {s('calls')}, {r('sum(lat) / 1e6', 'latency_seconds', 8)},
        {r('coalesce(sum(lat) / 1e6 / nullif(sum(calls), 0), 0)', 'avg_latency_seconds', 8)}, {s('chars', 'output_chars')},
        {r('coalesce(sum(chars) / nullif(sum(calls), 0), 0)', 'avg_output_chars', 8)}
      FROM (
        SELECT session_id, unnest(commands) AS command_name, 1 AS calls, 0.0::DOUBLE AS lat, 0 AS chars
        FROM cmds WHERE commands IS NOT NULL
        UNION ALL
        SELECT session_id, unnest(commands), 0, coalesce(latency_us, 0) / len(commands),
          length(result_text) // len(commands)
        FROM bash_pairs WHERE name = 'Bash' AND commands IS NOT NULL)
      GROUP BY session_id, command_name""",
    "char_totals": "SELECT * FROM chars",
    "session_statistics": "SELECT * REPLACE (" + ", ".join(r(c, c) for c in _DOUBLES) + ") FROM stats",
    "session_metadata": """
      SELECT session_id, ecosystem, source_path, project_path, git_branch, '1.0' AS version,
        CAST(NULL AS VARCHAR) AS user_type, created_us, updated_us,
        a.timestamp AS created_at, b.timestamp AS updated_at,
        CAST(created_date AS VARCHAR) AS created_date, total_messages, total_tokens
      FROM sessions s
      JOIN (SELECT session_id, arg_min(timestamp, line_no) AS timestamp FROM iso GROUP BY 1) a USING (session_id)
      JOIN (SELECT session_id, arg_max(timestamp, line_no) AS timestamp FROM iso GROUP BY 1) b USING (session_id)""",
    "session_rows": f"""
      SELECT session_id, logical_session_id, CAST(NULL AS VARCHAR) AS parent_session_id,
        logical_session_id AS root_session_id, bottleneck, {r('automation_ratio', 'automation_ratio')},
        total_tool_calls, {r('duration_seconds', 'duration_seconds')} FROM sessions""",
    "session_display": "SELECT session_id, 'completed' AS status, updated_us - created_us AS span_us FROM sessions",
    "subagents": "SELECT *, 'other' AS agent_type FROM agents",
    "sidechain_links": """
      SELECT session_id, 'root' AS parent_uuid, agent_id, count(*) AS messages, min(line_no) AS first_line,
        CAST(NULL AS BIGINT) AS parent_line FROM m WHERE side GROUP BY ALL""",
    "models_used": "SELECT DISTINCT session_id, 'model_' || (user_id % 3) AS model FROM m WHERE reply",
    "main_and_side_messages": """
      SELECT record_type, count(*) AS messages, CASE WHEN side THEN 'side' ELSE 'main' END AS stream
      FROM m GROUP BY ALL""",
    "logical_view": "SELECT ecosystem, logical_session_id, session_id, total_tokens FROM rows",
    "list_sessions_physical": """
      SELECT session_id, total_tokens, total_messages FROM sessions
      WHERE created_date BETWEEN DATE '2024-01-03' AND DATE '2024-01-20' AND total_tokens >= 50
      ORDER BY total_tokens DESC, session_id DESC LIMIT 25 OFFSET 10""",
    "list_sessions_logical": f"""
      SELECT session_id, logical_session_id, {r('automation_ratio', 'automation_ratio')} FROM (
        SELECT *, min(place) OVER (PARTITION BY logical_session_id) AS first_place FROM (
          SELECT *, row_number() OVER (ORDER BY automation_ratio ASC NULLS FIRST, session_id) AS place
          FROM sessions WHERE total_messages <= 30 AND bottleneck = 'Model'))
      QUALIFY row_number() OVER (PARTITION BY logical_session_id
        ORDER BY (session_id = logical_session_id) DESC, place) = 1
      ORDER BY first_place LIMIT 40""",
    "count_sessions": """
      SELECT count(*) AS sessions, CAST(0 AS BIGINT) AS "case" FROM sessions
      UNION ALL SELECT count(DISTINCT logical_session_id), 1 FROM sessions
      UNION ALL SELECT count(*), 2 FROM sessions WHERE automation_ratio >= 1
      UNION ALL SELECT count(DISTINCT logical_session_id), 3 FROM sessions
        WHERE ecosystem = 'source_1' AND total_tokens <= 400""",
    "browse_sessions": f"""
      SELECT session_id, total_tokens, {r('automation_ratio', 'automation_ratio')} FROM sessions
      WHERE contains(lower(project_path), 'team/p3') AND total_tokens BETWEEN 100 AND 900
        AND automation_ratio BETWEEN 1 AND 3""",
    "statistics_of_large_sessions":
      "SELECT session_id, total_tokens, message_count FROM stats WHERE total_tokens > 500",
    "sessions_with_files": """
      SELECT t.*, session_id FROM sessions JOIN tracked t ON source_path = file_path""",
    "session_totals": f"SELECT count(*) AS sessions, {s('total_messages')}, {s('total_tokens')} FROM sessions",
    "distinct_projects": "SELECT DISTINCT project_path FROM sessions",
    "overview_totals": "SELECT count(*) AS sessions, " + ", ".join(s(c) for c in _SUMS) + f""",
        {r('coalesce(avg(automation_ratio), 0)', 'avg_automation_ratio')},
        {r('coalesce(avg(duration_seconds), 0)', 'avg_duration_seconds')},
        {r('sum(active_us) / sum(span_us)', 'active_time_ratio')} FROM rows""",
    "yield_and_throughput": f"""
      SELECT measure, n, {r('mean', 'mean')}, {r('median', 'median')}, {r('p90', 'p90')}
      FROM (VALUES {_MEDIAN}) v(measure, n, mean, median, p90)""",
    "bottleneck_distribution": f"""
      SELECT key, sessions, {share('sessions', 'sum(sessions) OVER ()', 'percent')}
      FROM (SELECT coalesce(bottleneck, 'Unknown') AS key, count(*) AS sessions FROM rows GROUP BY ALL)""",
    "top_projects": f"""
      SELECT project_path, any_value(project_name) AS project_name, count(*) AS sessions, {s('total_tokens')},
        {s('total_messages')}, {r('avg(user_yield_ratio_tokens)', 'leverage_tokens_mean')},
        {r('avg(user_yield_ratio_chars)', 'leverage_chars_mean')},
        {share('count(*)', '(SELECT count(*) FROM windowed)', 'percent_sessions')},
        {share('sum(total_tokens)', '(SELECT sum(total_tokens) FROM windowed)', 'percent_tokens')}
      FROM windowed GROUP BY project_path
      ORDER BY sessions DESC, total_tokens DESC, project_path LIMIT 10""",
    "top_tools": f"""
      SELECT tool_name, calls, sessions, error_count,
        {r('coalesce(latency_us / (nullif(calls, 0) * 1e6), 0)', 'avg_latency_seconds')},
        {share('calls', '(SELECT sum(calls) FROM tool_use)', 'percent_calls')}
      FROM tool_use ORDER BY calls DESC, tool_name LIMIT 15""",
    "call_weighted_latency": f"""
      SELECT session_id, {r('sum(avg_latency_seconds * calls) / sum(calls)', 'avg_latency_seconds')}
      FROM tools GROUP BY session_id""",
    "source_breakdown": f"""
      SELECT ecosystem, CASE ecosystem WHEN 'source_0' THEN 'First' ELSE 'Source 1' END AS label, sessions,
        total_tokens, total_tool_calls, active_us,
        {share('sessions', 'sum(sessions) OVER ()', 'percent_sessions')},
        {share('total_tokens', 'sum(total_tokens) OVER ()', 'percent_tokens')}
      FROM (SELECT ecosystem, count(*) AS sessions, {s('total_tokens')}, {s('total_tool_calls')}, {s('active_us')}
            FROM rows GROUP BY ecosystem)""",
    "role_source_matrix": f"""
      SELECT ecosystem, role, 'Source ' || right(ecosystem, 1) || ':' || upper(role[1]) || role[2:] AS label,
        time_us, {share('time_us', 'sum(time_us) OVER ()', 'time_percent')},
        token_count, {share('token_count', 'sum(token_count) OVER ()', 'token_percent')},
        tool_calls, {share('tool_calls', 'sum(tool_calls) OVER ()', 'tool_call_percent')},
        error_count, {share('error_count', 'sum(error_count) OVER ()', 'error_percent')}
      FROM (
        SELECT ecosystem, 'model' AS role, {s('model_us', 'time_us')},
          {s('total_output_tokens + cache_read_tokens + cache_creation_tokens', 'token_count')},
          CAST(0 AS BIGINT) AS tool_calls, {s('model_timeout_count', 'error_count')} FROM rows GROUP BY 1
        UNION ALL SELECT ecosystem, 'tool', {s('tool_us', 'a')}, {s('tool_tokens', 'b')},
          {s('total_tool_calls', 'c')}, {s('tool_error_count', 'd')} FROM rows GROUP BY 1
        UNION ALL SELECT ecosystem, 'user', {s('user_us', 'a')}, {s('total_input_tokens', 'b')}, 0, 0
          FROM rows GROUP BY 1)""",
    "day_night_times": "SELECT " + ", ".join(
        r(f"{p}_{k}_seconds", f"{p}_{k}_seconds", 2) for p in ("day", "night")
        for k in ("model", "tool", "user", "inactive")) + f" FROM ({_day_night('rows')})",
    "day_night_shares": f"""
      SELECT period, {r('t / sum(t) OVER ()', 'share')}, CAST(NULL AS DOUBLE) AS share_all FROM (
        SELECT 'Day' AS period, day_model_seconds + day_tool_seconds + day_user_seconds AS t
        FROM ({_day_night('rows')})
        UNION ALL SELECT 'Night', night_model_seconds + night_tool_seconds + night_user_seconds
        FROM ({_day_night('rows')}))
      UNION ALL
      SELECT period, NULL, round(t / sum(t) OVER (), 6) FROM (
        SELECT 'Day+' AS period,
          day_model_seconds + day_tool_seconds + day_user_seconds + day_inactive_seconds AS t
        FROM ({_day_night('rows')})
        UNION ALL SELECT 'Night+',
          night_model_seconds + night_tool_seconds + night_user_seconds + night_inactive_seconds
        FROM ({_day_night('rows')}))""",
    "activity_coverage": f"""
      SELECT ecosystem, {s('b - a', 'covered_us')}, {s(night('a', '(b - a)'), 'night_us')} FROM (
        SELECT ecosystem, island, min(ts_us) AS a, max(ts_us) + 1800000000 AS b FROM (
          SELECT *, sum(fresh) OVER (PARTITION BY ecosystem ORDER BY ts_us, line_no) AS island FROM (
            SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY ecosystem ORDER BY ts_us, line_no)
                       > 1800000000 THEN 1 ELSE 0 END AS fresh FROM m)) GROUP BY ALL)
      GROUP BY ecosystem""",
    "distribution_bottleneck": _dist("lower(coalesce(bottleneck, 'Unknown'))", label="upper(key[1]) || key[2:]"),
    "distribution_project": _dist("project_path", label="split_part(key, '/', -1)"),
    "distribution_branch": _dist("coalesce(git_branch, '(none)')"),
    "distribution_automation_band": _dist(
        "CASE WHEN coalesce(automation_ratio, 0) < 1 THEN '0-1' WHEN automation_ratio < 3 THEN '1-3' "
        "WHEN automation_ratio < 5 THEN '3-5' ELSE '5+' END"),
    "distribution_tool": f"""
      SELECT tool_name AS key, tool_name AS label, sessions, calls AS value,
        {share('calls', '(SELECT sum(calls) FROM tool_use)', 'percent')}
      FROM tool_use ORDER BY calls DESC, tool_name LIMIT 20""",
    "distribution_session_token_share": f"""
      SELECT session_id AS key, left(session_id, 8) AS label, CAST(1 AS BIGINT) AS sessions,
        total_tokens AS value, {share('total_tokens', '(SELECT sum(total_tokens) FROM rows)', 'percent')}
      FROM rows ORDER BY total_tokens DESC, session_id LIMIT 20""",
    "timeseries_day": f"""
      SELECT CAST(created_date AS VARCHAR) AS period, count(*) AS sessions, {s('total_tokens', 'tokens')},
        {s('total_tool_calls', 'tool_calls')}, {r('coalesce(avg(automation_ratio), 0)', 'avg_automation_ratio')},
        {r('coalesce(avg(duration_seconds), 0)', 'avg_duration_seconds')} FROM rows GROUP BY created_date""",
    "timeseries_week": f"""
      SELECT strftime(created_date, '%G-W%V') AS period, count(*) AS sessions, {s('total_tokens', 'tokens')},
        {s('total_tool_calls', 'tool_calls')}, {r('coalesce(avg(automation_ratio), 0)', 'avg_automation_ratio')},
        {r('coalesce(avg(duration_seconds), 0)', 'avg_duration_seconds')}
      FROM rows GROUP BY 1""",
    "project_comparison": f"""
      SELECT project_path, any_value(project_name) AS project_name, count(*) AS sessions, {s('total_tokens')},
        {r('coalesce(avg(active_time_ratio), 0)', 'active_ratio')},
        {r('avg(user_yield_ratio_tokens)', 'leverage_tokens_mean')},
        {r('avg(user_yield_ratio_chars)', 'leverage_chars_mean')}
      FROM rows GROUP BY project_path ORDER BY total_tokens DESC, sessions DESC, project_path LIMIT 6""",
    "project_swimlane": f"""
      SELECT project_path, CAST(created_date AS VARCHAR) AS period, count(*) AS sessions,
        {s('total_tokens', 'tokens')}, {r('coalesce(avg(active_time_ratio), 0)', 'active_ratio')},
        {r('avg(user_yield_ratio_tokens)', 'leverage_tokens_mean')}, any_value(project_name) AS project_name
      FROM rows WHERE project_path IN (
        SELECT project_path FROM (SELECT project_path, sum(total_tokens) AS t, count(*) AS n
          FROM rows GROUP BY 1 ORDER BY t DESC, n DESC, project_path LIMIT 4))
      GROUP BY project_path, created_date""",
    "swimlane_frame": """
      SELECT DISTINCT strftime(created_date, '%G-W%V') AS period,
        (SELECT count(DISTINCT project_path) FROM rows) - 4 AS truncated_projects
      FROM rows WHERE project_path IN (
        SELECT project_path FROM (SELECT project_path, sum(total_tokens) AS t, count(*) AS n
          FROM rows GROUP BY 1 ORDER BY t DESC, n DESC, project_path LIMIT 4))""",
    "code_line_estimate": f"""
      SELECT {s('total_output_tokens + tool_tokens', 'output_budget_tokens')},
        {r('sum(total_output_tokens + tool_tokens) * 0.3::DOUBLE', 'effective_coding_tokens')},
        {r('sum(total_output_tokens + tool_tokens) * 0.3::DOUBLE / 10', 'estimated_code_lines')} FROM rows""",
    "ingest_status": f"""
      SELECT count(*) AS total_files, count(*) FILTER (parse_status = 'parsed') AS parsed_files,
        count(*) FILTER (parse_status = 'error') AS error_files,
        count(*) FILTER (parse_status = 'pending') AS pending_files,
        {s('file_size', 'total_file_size_bytes')},
        max(last_parsed_at) FILTER (parse_status = 'parsed') AS last_parsed_at,
        (SELECT count(*) FROM sessions) AS physical_sessions,
        (SELECT count(*) FROM rows) AS logical_sessions FROM tracked""",
    "incremental_summary": "SELECT count(*) AS sessions, " + ", ".join(s(c) for c in _FRESH_SUMS) + f""",
        {r('coalesce(sum(active_us) / nullif(sum(span_us), 0), 0)', 'active_time_ratio')} FROM fresh""",
    "incremental_counts": """
      SELECT 'source' AS section, ecosystem AS key, count(*) AS count FROM fresh GROUP BY ALL
      UNION ALL SELECT 'bottleneck', lower(coalesce(bottleneck, 'unknown')), count(*) FROM fresh GROUP BY ALL
      UNION ALL SELECT 'error_category', category, count(*) FROM errors
        WHERE session_id IN (SELECT session_id FROM fresh) GROUP BY ALL""",
    "incremental_excerpts": """
      SELECT session_id, line_no, timestamp, tool_name, category, result_text AS preview FROM (
        SELECT e.*, i.timestamp, f.created_us FROM errors e JOIN fresh f USING (session_id)
        JOIN iso i USING (session_id, line_no))
      ORDER BY created_us, session_id, line_no LIMIT 8""",
    "incremental_top_errors": """
      SELECT category AS key, count(*) AS count FROM errors
      WHERE session_id IN (SELECT session_id FROM fresh)
      GROUP BY ALL ORDER BY count DESC, key LIMIT 3""",
    "token_heatmap": "SELECT * FROM heat",
    "heatmap_summary": f"""
      SELECT session_id, count(*) AS points, {s('tokens', 'total_tokens')}, max(tokens) AS peak_tokens,
        arg_min(timestamp, line_no) AS range_start, arg_max(timestamp, line_no) AS range_end,
        CASE WHEN max(tokens) > 0 THEN first(timestamp ORDER BY tokens DESC, line_no) ELSE '' END AS peak_at
      FROM heat GROUP BY session_id""",
    "expensive_operations": """
      SELECT session_id, line_no, uuid, timestamp, type, name, tokens, cost_rank FROM (
        SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY tokens DESC, line_no, o) AS cost_rank
        FROM (
          SELECT h.session_id, line_no, uuid, timestamp, 'tool_call' AS type, tool_name AS name, tokens, 0 AS o
          FROM heat h JOIN (SELECT session_id, line_no, tool_name FROM m WHERE is_call) USING (session_id, line_no)
          UNION ALL
          SELECT h.session_id, line_no, uuid, timestamp, 'subagent', 'Subagent ' || agent_id, tokens, 1
          FROM heat h JOIN (SELECT session_id, line_no, agent_id FROM m WHERE side) USING (session_id, line_no)
          UNION ALL
          SELECT h.session_id, line_no, uuid, timestamp, 'message', 'assistant message', tokens, 1
          FROM heat h JOIN (SELECT session_id, line_no FROM m WHERE NOT side) USING (session_id, line_no)
          WHERE tokens > 1000)) WHERE cost_rank <= 5""",
    "tool_patterns": f"""
      SELECT session_id, tool_name, calls, total_tokens, error_count, {r('success_rate', 'success_rate', 8)},
        {r('avg_tokens', 'avg_tokens', 8)}, {r('avg_latency_seconds', 'avg_latency_seconds', 8)} FROM patterns""",
    "tool_parameters": """
      SELECT session_id, tool_name, 'command' AS parameter, count(*) AS uses FROM m WHERE is_call GROUP BY ALL""",
    "subagent_types": "SELECT * FROM agent_types",
    "subagent_efficiency": f"""
      SELECT session_id, agent_type, invocations, {r('avg_messages', 'avg_messages')},
        {r('avg_tokens', 'avg_tokens')}, {r('avg_duration_seconds', 'avg_duration_seconds')},
        {r('tokens_per_minute', 'tokens_per_minute')},
        CAST(least(100, floor(tokens_per_minute / 10 + 0.5)) AS BIGINT) AS efficiency_score,
        array_to_string(list_filter([
          CASE WHEN least(100, floor(tokens_per_minute / 10 + 0.5)) < 30
               THEN 'Consider optimizing ' || agent_type || ' agent usage' END,
          CASE WHEN avg_tokens > 10000
               THEN agent_type || ' uses high token count - review task complexity' END,
          CASE WHEN avg_duration_seconds > 60
               THEN agent_type || ' takes long to complete - consider breaking down tasks' END],
          lambda x: x IS NOT NULL), '|') AS recommendations
      FROM efficiency""",
    "session_anomalies": f"SELECT * REPLACE ({r('tokens_wasted', 'tokens_wasted')}) FROM anomalies",
    "recommendations": f"""
      SELECT session_id, 'cost' AS category, 'high' AS priority, 'Low cache utilization detected' AS title,
        floor(total_input_tokens * 0.5 + 0.5)::DOUBLE AS token_savings
      FROM stats WHERE total_input_tokens > 10000 AND cache_read_tokens / total_input_tokens < 0.1
      UNION ALL
      SELECT session_id, 'efficiency', 'medium', 'Tool calls dominate token usage', NULL
      FROM stats JOIN (
        SELECT session_id, sum(total_tokens) AS tool_sum FROM (
          SELECT * FROM tools QUALIFY row_number() OVER (
            PARTITION BY session_id ORDER BY calls DESC, tool_name) <= 5) GROUP BY 1) USING (session_id)
      WHERE tool_sum > total_tokens * 0.5
      UNION ALL
      SELECT DISTINCT session_id, 'performance', 'medium', 'Inefficient subagent usage detected', NULL::DOUBLE
      FROM efficiency WHERE least(100, floor(tokens_per_minute / 10 + 0.5)) < 40
      UNION ALL
      SELECT session_id, 'cost', 'medium', 'High token usage session', NULL FROM stats WHERE total_tokens > 100000
      UNION ALL
      SELECT session_id, 'performance', 'high', description, round(nullif(tokens_wasted, 0), 6)
      FROM anomalies WHERE severity = 'high'""",
    "compare_sessions": f"""
      SELECT a, b, tokens_diff, {r('p', 'tokens_diff_percent')}, message_diff, tool_calls_diff,
        {r('duration_diff', 'duration_diff')}, {r('e', 'efficiency_diff')},
        array_to_string(list_filter([
          CASE WHEN abs(p) > 20 THEN 'Session 1 uses ' || CAST(abs(floor(p + 0.5)) AS BIGINT) || '%'
            || CASE WHEN tokens_diff > 0 THEN ' more ' ELSE ' fewer ' END || 'tokens' END,
          CASE WHEN abs(message_diff) > 5 THEN 'Session 1 has ' || abs(message_diff)
            || CASE WHEN message_diff > 0 THEN ' more ' ELSE ' fewer ' END || 'messages' END,
          CASE WHEN e > 0.0001 THEN 'Session 1 is more efficient (fewer tokens per message)'
               WHEN e < -0.0001 THEN 'Session 2 is more efficient (fewer tokens per message)' END],
          lambda x: x IS NOT NULL), '|') AS insights
      FROM (
        SELECT x.session_id AS a, y.session_id AS b, x.total_tokens - y.total_tokens AS tokens_diff,
          coalesce((x.total_tokens - y.total_tokens) * 100 / nullif(y.total_tokens, 0), 0) AS p,
          x.message_count - y.message_count AS message_diff,
          x.total_tool_calls - y.total_tool_calls AS tool_calls_diff,
          x.duration_seconds - y.duration_seconds AS duration_diff,
          coalesce({ratio('x.message_count', 'x.total_tokens')}, 0)
            - coalesce({ratio('y.message_count', 'y.total_tokens')}, 0) AS e
        FROM sessions x JOIN (SELECT * FROM sessions) y ON x.user_id = y.user_id AND y.week = x.week + 1)""",
    "metric_diffs": f"""
      SELECT session_id, total_output_tokens - total_input_tokens AS value, {r('p', 'percent')},
        abs(p) > 20 AS is_large
      FROM (SELECT *, coalesce((total_output_tokens - total_input_tokens) * 100
                               / nullif(total_input_tokens, 0), 0) AS p FROM stats)""",
    "timeline_density": f"""
      SELECT session_id, bucket, role, count(*) AS messages, {r('sum(w)', 'weight_seconds')} FROM (
        SELECT session_id, CASE WHEN record_type = 'user' THEN 'user' WHEN is_call THEN 'tool' ELSE 'model' END AS role,
          least(greatest(coalesce(nx - ts_us, 1000) / 1e6, 1), 1200) AS w,
          CAST(floor(i / greatest(n - 1, 1) * 71) AS BIGINT) AS bucket
        FROM (SELECT *, lead(ts_us) OVER p AS nx, row_number() OVER p - 1 AS i,
                count(*) OVER (PARTITION BY session_id) AS n
              FROM main WINDOW p AS (PARTITION BY session_id ORDER BY line_no)))
      GROUP BY session_id, bucket, role""",
    "timeline_anomalies": """
      SELECT session_id, line_no, uuid, timestamp, i AS message_index, 'model_stall' AS type,
        'Model stall ' || CAST(floor(gap + 0.5) AS BIGINT) || 's' AS label
      FROM (SELECT *, (ts_us - lag(ts_us) OVER p) / 1e6 AS gap, row_number() OVER p - 1 AS i FROM main
            WINDOW p AS (PARTITION BY session_id ORDER BY line_no)) WHERE gap >= 600 AND reply
      UNION ALL
      SELECT session_id, line_no, uuid, timestamp, i, 'tool_error', 'Tool error'
      FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY line_no) - 1 AS i FROM main)
      WHERE failed""",
    "timeline_roles": """
      SELECT session_id, CASE WHEN record_type = 'user' THEN 'user' WHEN is_call THEN 'tool' ELSE 'model' END AS role,
        count(*) AS messages, CAST(0 AS BIGINT) AS technical FROM m GROUP BY ALL""",
    "visible_messages": """
      SELECT session_id, line_no, uuid FROM m x WHERE NOT side AND NOT (is_result AND EXISTS (
        SELECT 1 FROM main u WHERE u.is_call AND u.session_id = x.session_id AND u.tool_id = x.tool_id
          AND u.line_no < x.line_no))""",
    "annotations": "SELECT * FROM iso_notes",
    "selected_annotations": """
      SELECT * FROM iso_notes WHERE annotation_type IN ('tool_error', 'model_timeout')
        AND ts_us >= 1704672000000000""",
    "goals_and_outcomes": """
      SELECT session_id,
        arg_min(CASE WHEN is_result THEN result_text ELSE props END,
                CASE WHEN NOT reply THEN line_no END) AS user_goal,
        arg_max(CASE WHEN is_call THEN 'tool:' || tool_name ELSE props END,
                CASE WHEN reply THEN line_no END) AS final_outcome
      FROM main GROUP BY session_id""",
    "synopsis": f"""
      SELECT session_id, ecosystem, project_path, git_branch, total_messages, total_tokens, total_tool_calls,
        {r('duration_seconds', 'duration_seconds')}, bottleneck, {r('automation_ratio', 'automation_ratio')},
        tool_error_count, compact_count, subagent_count, coalesce(top_tools, '') AS top_tools,
        coalesce(cats, '') AS tool_error_categories, user_goal, final_outcome
      FROM sessions
      LEFT JOIN (SELECT session_id, string_agg(tool_name, '|' ORDER BY calls DESC, tool_name) AS top_tools
        FROM (SELECT * FROM tools QUALIFY row_number() OVER (
              PARTITION BY session_id ORDER BY calls DESC, tool_name) <= 5) GROUP BY 1) USING (session_id)
      LEFT JOIN (SELECT session_id, string_agg(category, '|' ORDER BY n DESC, category) AS cats
        FROM (SELECT * FROM (SELECT session_id, category, count(*) AS n FROM errors GROUP BY ALL)
              QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY n DESC, category) <= 5) GROUP BY 1) USING (session_id)
      LEFT JOIN (SELECT session_id,
          arg_min(CASE WHEN is_result THEN result_text ELSE props END,
                  CASE WHEN NOT reply THEN line_no END) AS user_goal,
          arg_max(CASE WHEN is_call THEN 'tool:' || tool_name ELSE props END,
                  CASE WHEN reply THEN line_no END) AS final_outcome
        FROM main GROUP BY session_id) USING (session_id)""",
    "summary_work_list": """
      SELECT session_id, sha256(session_id) AS synopsis_hash FROM sessions
      WHERE NOT (week % 2 = 0 AND week % 3 > 0)""",
    "capability_drift": """
      SELECT session_id, ecosystem, 'subagent_events=false but parsed session includes subagent sessions; check manifest drift' AS warning
      FROM sessions WHERE ecosystem = 'source_0' AND subagent_count > 0
      UNION ALL SELECT session_id, ecosystem,
        'cache_creation_tokens=false but parsed stats include cache_creation_tokens; check manifest drift'
      FROM sessions WHERE ecosystem = 'source_0' AND cache_creation_tokens > 0
      UNION ALL SELECT session_id, ecosystem,
        'tool_call_events=false but parsed stats include tool calls; check parser/manifest drift'
      FROM sessions WHERE ecosystem = 'source_1' AND total_tool_calls > 0""",
    "capability_notices": """
      SELECT ecosystem, sessions, id, severity, label, reason
      FROM (SELECT ecosystem, count(*) AS sessions FROM sessions GROUP BY 1)
      JOIN (VALUES ('source_0', 'reasoning_tokens', 'info', 'Reasoning tokens',
                    'Not exposed by this ecosystem; related metrics should render as N/A.'),
                   ('source_0', 'lineage_links', 'info', 'Parent/child lineage',
                    'Physical parent-child session links are not available.'),
                   ('source_1', 'reasoning_tokens', 'info', 'Reasoning tokens',
                    'Not exposed by this ecosystem; related metrics should render as N/A.'),
                   ('source_1', 'timestamp_inference', 'warning', 'Time-based metrics',
                    'Missing timestamps are inferred best-effort; latency/time metrics are approximate.'))
        n(ecosystem, id, severity, label, reason) USING (ecosystem)""",
    "export_metrics": "SELECT session_id, metric, round(value, 6) AS value FROM (" + " UNION ALL ".join(
        f"SELECT session_id, '{name}' AS metric, CAST(coalesce({expr}, 0) AS DOUBLE) AS value FROM stats"
        for name, expr in _EXPORTED) + ")",
    "export_tools": """
      SELECT session_id, tool_name, tool_group, calls AS total_calls, total_tokens, success_count, error_count,
        printf('%.2f', success_count / greatest(success_count + error_count, 1) * 100) AS success_rate,
        round(avg_latency_seconds, 3) AS avg_latency_seconds
      FROM tools""",
    "export_tool_patterns": """
      SELECT p.session_id, p.tool_name, calls AS total_calls, printf('%.2f', avg_tokens::DOUBLE) AS avg_tokens_per_call,
        printf('%.2f', success_rate::DOUBLE * 100) AS success_rate,
        CASE WHEN u.tool_name IS NULL THEN '' ELSE 'command' END AS parameters
      FROM patterns p LEFT JOIN (SELECT DISTINCT session_id, tool_name FROM m WHERE is_call) u
        ON p.session_id = u.session_id AND p.tool_name = u.tool_name""",
    "export_bottlenecks": f"""
      SELECT session_id, type, severity, description, component AS affected_component,
        {r('coalesce(tokens_wasted, 0)', 'tokens_wasted')}, recommendation FROM anomalies""",
    "log_lines_to_messages": f"""
      SELECT session_id, count(*) AS messages, count(*) FILTER (is_result) AS results,
        count(*) FILTER (reply) AS with_usage, CAST(sum(tin) AS BIGINT) AS input_tokens,
        CAST(sum(tout) AS BIGINT) AS output_tokens, CAST(sum(tread) AS BIGINT) AS cache_read_tokens,
        CAST(sum(ts_us) AS VARCHAR) AS ts_sum
      FROM m GROUP BY session_id""",
    "document_characters": f"""
      SELECT lang, {s('length(text)', 'total')}, CAST(0 AS BIGINT) AS cjk, {s(keep('A-Za-z', 'text'), 'latin')},
        {s(keep('0-9', 'text'), 'digit')}, {s(keep(' ' + chr(92) + 't' + chr(92) + 'n' + chr(92) + 'r', 'text'), 'space')},
        {s('length(text) - ' + keep('A-Za-z0-9 ' + chr(92) + 't' + chr(92) + 'n' + chr(92) + 'r', 'text'), 'other')}
      FROM documents GROUP BY lang""",
    "conversation_characters": f"""
      SELECT conv_id, role, count(*) AS turns, {s('length(text)', 'chars')},
        {s(keep('A-Za-z', 'text'), 'latin')} FROM conversations GROUP BY conv_id, role""",
    "document_previews": r"""
      SELECT doc_id, CASE WHEN length(flat) <= 80 THEN flat ELSE
        rtrim(CASE WHEN contains(rtrim(left(flat, 80)), ' ')
                   THEN rtrim(regexp_replace(rtrim(left(flat, 80)), ' [^ ]*$', ''))
                   ELSE rtrim(left(flat, 80)) END, ' ,;:') || '...' END AS preview
      FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM documents)""",
    "document_error_rules": f"""
      SELECT {category_sql('rule')} AS category, count(*) AS documents
      FROM (SELECT {rule_sql('text')} AS rule FROM documents) GROUP BY 1""",
    "repeated_prompts": r"""
      SELECT sha256(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS prompt, count(*) AS uses,
        min(conv_id) AS first_conv
      FROM conversations WHERE role = 'user' GROUP BY 1""",
    "cosine_to_centroid": """
      WITH x AS (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
      c AS (SELECT label, i, avg(v::DOUBLE) AS c FROM x GROUP BY ALL)
      SELECT lpad(CAST(vec_id AS VARCHAR), 12, '0') AS id, CAST(label AS BIGINT) AS label,
        round(sum(v::DOUBLE * c) / sqrt(sum(v::DOUBLE * v::DOUBLE)) / sqrt(sum(c * c)), 4) AS similarity
      FROM x JOIN c USING (label, i) GROUP BY vec_id, label""",
    "best_centroid": """
      WITH x AS (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
      c AS (SELECT label, i, avg(v::DOUBLE) AS c FROM x GROUP BY ALL),
      d AS (SELECT vec_id, c.label AS leader,
              sum(v::DOUBLE * c) / sqrt(sum(v::DOUBLE * v::DOUBLE)) / sqrt(sum(c * c)) AS similarity
            FROM x JOIN c USING (i) GROUP BY vec_id, c.label)
      SELECT lpad(CAST(vec_id AS VARCHAR), 12, '0') AS id, CAST(leader AS VARCHAR) AS leader,
        round(similarity, 4) AS similarity
      FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, CAST(leader AS VARCHAR)) = 1""",
    "leader_clusters": f"{_LEADERS} SELECT * FROM members",
    "leader_cluster_sizes": f"{_LEADERS} SELECT leader, count(*) AS members FROM members GROUP BY 1",
    "similarity_links": """
      WITH x AS (SELECT lpad(CAST(vec_id AS VARCHAR), 12, '0') AS id, embedding::DOUBLE[] AS e FROM embeddings)
      SELECT a.id, (SELECT min(c.id) FROM x c WHERE c.e = a.e) AS class_id, count(b.id) AS n_links
      FROM x a LEFT JOIN x b ON a.id <> b.id AND list_cosine_similarity(a.e, b.e) >= 0.3
      GROUP BY a.id, a.e""",
    "session_page_rows": """
      SELECT session_id, total_tokens FROM sessions ORDER BY total_tokens DESC, session_id DESC LIMIT 30 OFFSET 30""",
    "session_page_counts": """
      SELECT count(DISTINCT logical_session_id) AS sessions,
        CAST(ceil(count(DISTINCT logical_session_id) / 30) AS BIGINT) AS pages FROM sessions""",
    "user_messages": """
      SELECT session_id, count(*) AS messages FROM m WHERE NOT reply GROUP BY 1""",
    "document_hashes": "SELECT doc_id, sha256(text) AS hash FROM documents",
    "file_ids": """
      SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'rollout-2026-none' ELSE
        regexp_replace(md5(CAST(doc_id AS VARCHAR)), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') END
        AS file_id FROM documents""",
    "night_time_in_zone": """
      WITH x AS (SELECT user_id, (epoch_us(ts) + 19800000000) % 86400000000 AS t FROM events)
      SELECT user_id, CAST(sum(greatest(least(t + 3600000000, 32400000000) - greatest(t, 3600000000), 0)) AS BIGINT)
        AS night_us, count(*) AS events FROM x GROUP BY 1""",
    "latest_cluster_members": """
      SELECT 'run' || label AS run_id, CAST(vec_id AS VARCHAR) AS session_id FROM embeddings
      WHERE label = (SELECT max(label) FROM embeddings)""",
    "cluster_run": """
      SELECT 'r' AS run_id, 't' AS generated_at, 'cosine_threshold_greedy' AS algorithm, 'v1' AS algorithm_version,
        'm' AS source_model_id, 0.3::DOUBLE AS similarity_threshold, count(*) AS session_count,
        count(DISTINCT label) AS cluster_count FROM embeddings""",
    "completed_vectors": """
      SELECT CAST(vec_id AS VARCHAR) AS id, CAST(len(embedding) AS BIGINT) AS dimension FROM embeddings
      WHERE vec_id % 5 > 0 AND vec_id % 3 > 0 AND vec_id % 7 > 0""",
    "embedding_dimension": """
      SELECT count(*) AS vectors, CAST(max(len(embedding)) AS BIGINT) AS dimension FROM embeddings""",
}


def statements() -> dict[str, str]:
    out = {name: with_ctes(sql) for name, sql in RAW.items()}
    out["role_coverage"] = coverage_sql("SELECT *")
    out["coverage_ratios"] = coverage_sql(
        "SELECT role, round(least(day_seconds / day_window_seconds, 1), 6) AS day_coverage, "
        "round(least(night_seconds / night_window_seconds, 1), 6) AS night_coverage")
    out.update(logs.statements())
    return out
