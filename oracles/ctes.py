"""Shared subqueries: the event feed as messages, and what is derived from it."""

from __future__ import annotations

import re

# The rules as SQL patterns, written out here so that a lost or changed rule shows.
RULES = [
    ("permission_denied", "permission", "permission denied|operation not permitted|eacces|eperm"),
    ("command_not_found", "command", "command not found|is not recognized as an internal or external command"),
    ("file_not_found", "file_not_found", "no such file|not found|enoent|cannot stat|does not exist"),
    ("timeout", "timeout", "timed out|timeout|deadline exceeded"),
    ("rate_limited", "rate_limit", "rate limit|too many requests|429"),
    ("network", "network", "connection refused|connection reset|network|enotfound|dns"),
    ("auth", "authentication", "unauthorized|forbidden|invalid api key|authentication failed"),
    ("patch_apply_failed", "patch", "patch failed|hunk failed|apply_patch verification failed"),
    ("parse_error", "parsing", "jsondecodeerror|parse error|invalid json|yaml"),
    ("execution_failure", "execution", r"process exited with code\s*-?[1-9]\d*|exited with status\s*[1-9]\d*"
                                       r"|non[- ]zero exit|command failed|failed to execute"),
    ("runtime_exception", "runtime_exception",
     r"\btraceback\b|\bexception\b|runtimeerror|typeerror|valueerror"),
    ("web_search_failure", "web_search",
     r"""web[_ ]search.*(failed|error)|search (failed|error)|result_status["'=:\s]+failed"""),
    ("test_failure", "test_failure", r"assertionerror|\\bfailed\\b|traceback"),
]
HOUR = 3_600_000_000
_RULE = " ".join(
    f"WHEN regexp_matches(result_text, '{pat.replace(chr(39), chr(39) * 2)}', 'i') THEN '{rule}'"
    for rule, _, pat in RULES)
_CATEGORY = " ".join(f"WHEN '{rule}' THEN '{cat}'" for rule, cat, _ in RULES)


def rule_sql(column: str) -> str:
    return f"CASE {_RULE.replace('result_text', column)} END"


def category_sql(rule: str) -> str:
    return f"CASE {rule} {_CATEGORY} ELSE 'uncategorized' END"


def keep(pattern: str, column: str) -> str:
    """Number of characters of a column that match a class."""
    return f"length(regexp_replace({column}, '[^{pattern}]', '', 'g'))"


def ratio(top: str, bottom: str) -> str:
    return f"(CAST({top} AS DOUBLE) / nullif({bottom}, 0))"


CTES = {
    "e": """
      SELECT event_id, user_id, event_type, props, epoch_us(ts) AS ts_us,
             CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
             CAST(round(value) AS BIGINT) AS amount
      FROM events""",
    "m": """
      SELECT 'u' || user_id || '-' || (ts_us // 604800000000) AS session_id,
             event_id AS line_no, 'e' || event_id AS uuid, ts_us, props, k, user_id, amount,
             ts_us // 604800000000 AS week, 'source_' || (user_id % 2) AS ecosystem,
             event_type IN ('view', 'click') AS reply,
             event_type = 'click' AS is_call,
             event_type IN ('purchase', 'error') AS is_result,
             event_type = 'error' AS failed, event_type = 'signup' AS plain,
             CASE WHEN event_type IN ('view', 'click') THEN 'assistant' ELSE 'user' END AS record_type,
             event_type IN ('view', 'click') AND k % 11 = 0 AS side,
             CASE WHEN event_type IN ('view', 'click') AND k % 11 = 0 THEN 'a' || (k % 2) END AS agent_id,
             CASE WHEN event_type IN ('view', 'click') THEN amount END AS tin,
             CASE WHEN event_type IN ('view', 'click') THEN k END AS tout,
             CASE WHEN event_type IN ('view', 'click') AND k % 4 = 0 THEN k END AS tcreate,
             CASE WHEN event_type IN ('view', 'click') AND k % 3 = 0 THEN amount END AS tread,
             CASE WHEN event_type = 'click' THEN
               CASE WHEN k % 7 = 0 THEN 'Bash' WHEN k % 7 = 1 THEN 'mcp__srv_' || (k % 3) || '__run'
                    ELSE 'tool_' || (k % 7) END END AS tool_name,
             CAST(k % 5 AS VARCHAR) AS tool_id,
             CASE WHEN event_type = 'click' AND k % 7 = 0 THEN
               'cd /srv/u' || user_id || ' && MODE=' || k || ' /usr/bin/run_' || (k % 4) || ' --n ' || k
               || CASE WHEN k % 3 = 0 THEN ' | tail -n 5' ELSE '' END
               || CASE WHEN k % 5 = 0 THEN '; echo done' ELSE '' END END AS command,
             CASE WHEN event_type = 'error' THEN
               ['Permission denied', 'bash: rgx: command not found', 'operation timed out',
                'Process exited with code 2', 'unexpected widget explosion',
                'HTTP 429 Too Many Requests', 'AssertionError: expected 2'][k % 7 + 1] || ' at ' || k
               WHEN event_type = 'purchase' THEN props END AS result_text
      FROM e""",
    "iso": """
      SELECT *, strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S')
             || CASE WHEN ts_us % 1000000 > 0 THEN '.' || lpad(CAST(ts_us % 1000000 AS VARCHAR), 6, '0')
                ELSE '' END || '+00:00' AS timestamp
      FROM m""",
    "g0": """
      SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY session_id ORDER BY line_no) AS raw_gap FROM m""",
    "g1": """
      SELECT *, CASE WHEN raw_gap >= 0 THEN raw_gap END AS gap_us FROM g0""",
    "g": f"""
      SELECT *, CASE WHEN gap_us IS NULL THEN NULL WHEN gap_us > {6 * HOUR} THEN 'inactive'
                     WHEN reply THEN 'model' WHEN is_result THEN 'tool' ELSE 'user' END AS gap_kind,
             coalesce(gap_us <= {6 * HOUR} AND reply AND gap_us > {2 * HOUR}, false) AS is_timeout
      FROM g1""",
    "totals": """
      SELECT session_id, count(*) AS message_count,
        count(*) FILTER (NOT reply) AS user_message_count,
        count(*) FILTER (reply) AS assistant_message_count,
        CAST(0 AS BIGINT) AS other_message_count,
        count(*) FILTER (plain) AS user_interaction_count,
        CAST(sum(coalesce(tin, 0)) AS BIGINT) AS total_input_tokens,
        CAST(sum(coalesce(tout, 0)) AS BIGINT) AS total_output_tokens,
        CAST(sum(coalesce(tread, 0)) AS BIGINT) AS cache_read_tokens,
        CAST(sum(coalesce(tcreate, 0)) AS BIGINT) AS cache_creation_tokens,
        min(ts_us) AS first_us, max(ts_us) AS last_us,
        CAST(coalesce(sum(gap_us) FILTER (gap_kind = 'model'), 0) AS BIGINT) AS model_us,
        CAST(coalesce(sum(gap_us) FILTER (gap_kind = 'tool'), 0) AS BIGINT) AS tool_us,
        CAST(coalesce(sum(gap_us) FILTER (gap_kind = 'user'), 0) AS BIGINT) AS user_us,
        CAST(coalesce(sum(gap_us) FILTER (gap_kind = 'inactive'), 0) AS BIGINT) AS inactive_us,
        count(*) FILTER (is_timeout) AS model_timeout_count
      FROM g GROUP BY ALL""",
    "cmds": """
      SELECT *, CASE WHEN command IS NULL THEN NULL ELSE list_transform(
          list_filter(regexp_split_to_array(command, '&&|;|\\|'), lambda x: trim(x) <> ''),
          lambda x: regexp_replace(split_part(regexp_replace(trim(x), '^[A-Z]+=[^ ]+ ', ''), ' ', 1),
                              '.*/', '')) END AS commands
      FROM m""",
    "pairs": """
      SELECT r.session_id, r.line_no, r.ts_us, r.tool_id, r.failed, r.result_text,
             u.line_no IS NOT NULL AS matched, coalesce(u.tool_name, 'unknown') AS name,
             u.ts_us AS call_us,
             CASE WHEN r.ts_us >= u.ts_us THEN r.ts_us - u.ts_us END AS latency_us
      FROM (SELECT * FROM m WHERE is_result) r
      ASOF LEFT JOIN (SELECT * FROM m WHERE is_call) u
        ON r.session_id = u.session_id AND r.tool_id = u.tool_id AND r.line_no > u.line_no""",
    "bash_pairs": """
      SELECT p.*, u.commands
      FROM pairs p ASOF LEFT JOIN (SELECT * FROM cmds WHERE commands IS NOT NULL) u
        ON p.session_id = u.session_id AND p.tool_id = u.tool_id AND p.line_no > u.line_no""",
    "tools0": """
      SELECT session_id, tool_name, count(*) AS calls, sum(tin + tout) AS total_tokens,
             0 AS success_count, 0 AS error_count, 0 AS latency_us, 0 AS latency_count
      FROM m WHERE is_call GROUP BY ALL
      UNION ALL
      SELECT session_id, name, 0, 0, count(*) FILTER (NOT failed), count(*) FILTER (failed),
             coalesce(sum(latency_us), 0), count(latency_us)
      FROM pairs GROUP BY ALL
      UNION ALL
      SELECT session_id, name, count(DISTINCT tool_id), 0, 0, 0, 0, 0
      FROM pairs WHERE NOT matched GROUP BY ALL""",
    "tools": """
      SELECT session_id, tool_name, CAST(sum(calls) AS BIGINT) AS calls,
             CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
             CAST(sum(success_count) AS BIGINT) AS success_count,
             CAST(sum(error_count) AS BIGINT) AS error_count,
             CAST(sum(latency_us) AS BIGINT) AS latency_us,
             CAST(sum(latency_count) AS BIGINT) AS latency_count,
             CASE WHEN starts_with(tool_name, 'mcp__')
                  THEN regexp_extract(tool_name, '_([0-9])__', 1) || ' (MCP)' ELSE tool_name END AS tool_group,
             coalesce(sum(latency_us) / (nullif(sum(latency_count), 0) * 1e6), 0.0) AS avg_latency_seconds
      FROM tools0 GROUP BY session_id, tool_name""",
    "errs": f"""
      SELECT session_id, line_no, ts_us, name AS tool_name, tool_id AS tool_call_id, result_text,
             {rule_sql("result_text")} AS matched_rule FROM pairs WHERE failed""",
    "errors": f"""
      SELECT *, {category_sql("matched_rule")} AS category FROM errs""",
    "texts": """
      SELECT session_id, CASE WHEN is_result THEN 'tool' WHEN reply THEN 'model' ELSE 'user' END AS producer,
             CASE WHEN is_result THEN result_text ELSE props END AS t
      FROM m WHERE NOT is_call""",
    "chars": f"""
      SELECT session_id,
        CAST(coalesce(sum(length(t)) FILTER (producer = 'user'), 0) AS BIGINT) AS user_chars,
        CAST(coalesce(sum(length(t)) FILTER (producer = 'model'), 0) AS BIGINT) AS model_chars,
        CAST(coalesce(sum(length(t)) FILTER (producer = 'tool'), 0) AS BIGINT) AS tool_chars,
        CAST(0 AS BIGINT) AS cjk_chars,
        CAST(sum({keep("A-Za-z", "t")}) AS BIGINT) AS latin_chars,
        CAST(sum({keep("0-9", "t")}) AS BIGINT) AS digit_chars,
        CAST(sum({keep(" ", "t")}) AS BIGINT) AS space_chars,
        CAST(sum(length(t) - {keep("A-Za-z0-9 ", "t")}) AS BIGINT) AS other_chars,
        CAST(sum(length(t)) AS BIGINT) AS total_chars
      FROM texts GROUP BY session_id""",
    "tool_sums": """
      SELECT session_id, CAST(sum(calls) AS BIGINT) AS total_tool_calls,
        CAST(sum(total_tokens) AS BIGINT) AS tool_tokens,
        CAST(sum(success_count) AS BIGINT) AS tool_success_count,
        CAST(sum(error_count) AS BIGINT) AS tool_error_count,
        CAST(sum(latency_us) AS BIGINT) AS tool_latency_us
      FROM tools GROUP BY session_id""",
    "shell_sums": """
      SELECT session_id, count(*) AS shell_calls, CAST(sum(len(commands)) AS BIGINT) AS shell_sub_commands
      FROM cmds WHERE commands IS NOT NULL GROUP BY session_id""",
    "agents": """
      SELECT session_id, agent_id, count(*) AS messages, min(ts_us) AS start_us,
        CASE WHEN count(*) > 1 THEN max(ts_us) END AS end_us,
        CAST(sum(tin + tout) AS BIGINT) AS tokens, 'root' AS parent_uuid
      FROM m WHERE side GROUP BY session_id, agent_id""",
    "s0": """
      SELECT t.*, total_input_tokens + total_output_tokens AS total_tokens,
        c.* EXCLUDE (session_id), coalesce(total_tool_calls, 0) AS total_tool_calls,
        coalesce(tool_tokens, 0) AS tool_tokens, coalesce(tool_success_count, 0) AS tool_success_count,
        coalesce(tool_error_count, 0) AS tool_error_count,
        coalesce(tool_latency_us, 0) AS tool_latency_us, coalesce(shell_calls, 0) AS shell_calls,
        coalesce(shell_sub_commands, 0) AS shell_sub_commands,
        coalesce(subagent_count, 0) AS subagent_count, CAST(0 AS BIGINT) AS compact_count,
        CAST(0 AS BIGINT) AS trajectory_file_size_bytes
      FROM totals t
      LEFT JOIN (SELECT session_id, user_chars, model_chars, tool_chars, cjk_chars, latin_chars,
                        digit_chars, space_chars, other_chars, total_chars FROM chars) c USING (session_id)
      LEFT JOIN tool_sums USING (session_id) LEFT JOIN shell_sums USING (session_id)
      LEFT JOIN (SELECT session_id, count(*) AS subagent_count FROM agents GROUP BY 1) USING (session_id)""",
    "s1": """
      SELECT * REPLACE (
          coalesce(user_chars, 0) AS user_chars, coalesce(model_chars, 0) AS model_chars,
          coalesce(tool_chars, 0) AS tool_chars, coalesce(cjk_chars, 0) AS cjk_chars,
          coalesce(latin_chars, 0) AS latin_chars, coalesce(digit_chars, 0) AS digit_chars,
          coalesce(space_chars, 0) AS space_chars, coalesce(other_chars, 0) AS other_chars,
          coalesce(total_chars, 0) AS total_chars),
        last_us - first_us AS duration_us, (last_us - first_us) / 1e6 AS duration_seconds,
        model_us + tool_us + user_us AS active_us,
        model_us + tool_us + user_us + inactive_us AS span_us
      FROM s0""",
    "stats0": f"""
      SELECT *,
        CASE WHEN span_us > 0 THEN coalesce({ratio("model_us * 100", "active_us")}, 0) END AS model_time_percent,
        CASE WHEN span_us > 0 THEN coalesce({ratio("tool_us * 100", "active_us")}, 0) END AS tool_time_percent,
        CASE WHEN span_us > 0 THEN coalesce({ratio("user_us * 100", "active_us")}, 0) END AS user_time_percent,
        {ratio("inactive_us * 100", "span_us")} AS inactive_time_percent,
        {ratio("active_us", "span_us")} AS active_time_ratio,
        CASE WHEN span_us > 0 THEN
          coalesce({ratio("user_interaction_count * 3600000000", "active_us")}, 0) END AS interactions_per_hour,
        21600.0::DOUBLE AS inactivity_threshold_seconds, 7200.0::DOUBLE AS model_timeout_threshold_seconds,
        {ratio("total_input_tokens * 100", "every")} AS input_percent,
        {ratio("total_output_tokens * 100", "every")} AS output_percent,
        {ratio("cache_read_tokens * 100", "every")} AS cache_read_percent,
        {ratio("cache_creation_tokens * 100", "every")} AS cache_creation_percent,
        {ratio("total_output_tokens + tool_tokens", "total_input_tokens")} AS user_yield_ratio_tokens,
        {ratio("model_chars + tool_chars", "user_chars")} AS user_yield_ratio_chars,
        {ratio("total_tokens * 1000000", "model_us")} AS avg_tokens_per_second,
        {ratio("total_input_tokens * 1000000", "model_us")} AS read_tokens_per_second,
        {ratio("total_output_tokens * 1000000", "model_us")} AS output_tokens_per_second,
        {ratio("(cache_read_tokens + cache_creation_tokens) * 1000000", "model_us")} AS cache_tokens_per_second,
        {ratio("cache_read_tokens * 1000000", "model_us")} AS cache_read_tokens_per_second,
        {ratio("cache_creation_tokens * 1000000", "model_us")} AS cache_creation_tokens_per_second,
        total_tokens / message_count AS avg_tokens_per_message,
        {ratio("shell_sub_commands", "shell_calls")} AS avg_commands_per_call,
        CASE WHEN span_us > 0 AND user_interaction_count > 0
             THEN round(total_tool_calls / user_interaction_count, 2) END AS automation_ratio
      FROM (SELECT *, total_input_tokens + total_output_tokens + cache_read_tokens
                      + cache_creation_tokens AS every FROM s1)""",
    "stats": """
      SELECT * EXCLUDE (every, rm, rt, ru),
        CASE WHEN span_us > 0 THEN CASE WHEN rm >= rt AND rm >= ru THEN 'Model'
             WHEN rt >= ru THEN 'Tool' ELSE 'User' END END AS bottleneck
      FROM (SELECT *, round(model_time_percent, 1) AS rm, round(tool_time_percent, 1) AS rt,
                   round(user_time_percent, 1) AS ru FROM stats0)""",
    "sessions": """
      SELECT st.*, f.user_id, f.week, f.ecosystem, f.ts_us AS created_us,
        CAST(make_timestamp(f.ts_us) AS DATE) AS created_date, l.last_ts AS updated_us,
        '/srv/team/p' || (f.user_id % 10) AS project_path, 'p' || (f.user_id % 10) AS project_name,
        CASE WHEN f.user_id % 4 > 0 THEN 'branch_' || (f.user_id % 4) END AS git_branch,
        'u' || f.user_id || '-' || (f.week - f.week % 2) AS logical_session_id,
        '/logs/u' || f.user_id || '/events.jsonl' AS source_path, f.message_count AS total_messages
      FROM stats st
      JOIN (SELECT session_id, count(*) AS message_count, any_value(user_id) AS user_id,
                   any_value(week) AS week, any_value(ecosystem) AS ecosystem,
                   arg_min(ts_us, line_no) AS ts_us FROM m GROUP BY session_id) f USING (session_id)
      JOIN (SELECT session_id, arg_max(ts_us, line_no) AS last_ts FROM m GROUP BY session_id) l
        USING (session_id)""",
    "rows": """
      SELECT * FROM sessions QUALIFY row_number() OVER (PARTITION BY ecosystem, logical_session_id
        ORDER BY (session_id = logical_session_id) DESC, created_us DESC, session_id DESC) = 1""",
    "windowed": """
      SELECT * FROM sessions WHERE created_date BETWEEN DATE '2024-01-03' AND DATE '2024-01-20'
      QUALIFY row_number() OVER (PARTITION BY ecosystem, logical_session_id
        ORDER BY (session_id = logical_session_id) DESC, created_us DESC, session_id DESC) = 1""",
    "patterns": """
      SELECT session_id, tool_name, calls, total_tokens, error_count,
        coalesce(success_count / nullif(success_count + error_count, 0), 1.0) AS success_rate,
        coalesce(total_tokens / nullif(calls, 0), 0.0) AS avg_tokens,
        nullif(avg_latency_seconds, 0.0) AS avg_latency_seconds
      FROM tools""",
    "heat": """
      SELECT session_id, line_no, timestamp, uuid, record_type AS message_type,
        tin + tout + coalesce(tread, 0) + coalesce(tcreate, 0) AS tokens, tin AS input_tokens,
        tout AS output_tokens, coalesce(tread, 0) AS cache_read_tokens,
        coalesce(tcreate, 0) AS cache_creation_tokens
      FROM iso WHERE reply""",
    "agent_types": """
      SELECT session_id, agent_id,
        coalesce(arg_min(CASE WHEN is_call AND tool_name = 'Bash' THEN 'Bash' END,
                         CASE WHEN is_call AND tool_name = 'Bash' THEN line_no END), 'other') AS agent_type
      FROM m WHERE side GROUP BY ALL""",
    "efficiency": """
      SELECT *, CASE WHEN avg_duration_seconds > 0 THEN avg_tokens / avg_duration_seconds * 60 ELSE 0 END
                AS tokens_per_minute
      FROM (SELECT session_id, agent_type, count(*) AS invocations, avg(messages) AS avg_messages,
                   avg(tokens) AS avg_tokens,
                   avg(coalesce(end_us - start_us, 0) / 1e6) AS avg_duration_seconds
            FROM agents JOIN agent_types USING (session_id, agent_id) GROUP BY ALL)""",
    "means": "SELECT session_id, avg(tokens) AS mean FROM heat GROUP BY ALL",
    "anomalies": """
      SELECT session_id, 'token_spike' AS type, CASE WHEN count(*) > 5 THEN 'high' ELSE 'medium' END AS severity,
        'Detected ' || count(*) || ' token usage spikes (>3x average)' AS description,
        'Session messages' AS component, sum(tokens - mean) AS tokens_wasted,
        CAST(NULL AS BIGINT) AS error_count,
        'Review messages with high token usage and optimize prompts' AS recommendation
      FROM heat JOIN means USING (session_id) WHERE tokens > mean * 3 GROUP BY session_id
      UNION ALL
      SELECT session_id, 'high_error_rate', CASE WHEN success_rate < 0.5 THEN 'high' ELSE 'medium' END,
        'Tool "' || tool_name || '" has ' || CAST(floor((1 - success_rate) * 100 + 0.5) AS BIGINT)
          || '% error rate',
        tool_name, NULL, CAST(floor(calls * (1 - success_rate) + 0.5) AS BIGINT),
        'Review and fix error conditions for ' || tool_name
      FROM patterns WHERE success_rate < 0.7 AND calls > 3
      UNION ALL
      SELECT session_id, 'inefficient_tool', CASE WHEN avg_tokens > 10000 THEN 'high' ELSE 'medium' END,
        'Tool "' || tool_name || '" uses ' || CAST(floor(avg_tokens + 0.5) AS BIGINT)
          || ' tokens per call on average',
        tool_name, floor(avg_tokens * calls * 0.3 + 0.5), NULL,
        'Optimize ' || tool_name || ' usage or consider alternative approaches'
      FROM patterns WHERE avg_tokens > 5000 AND calls > 5""",
    "main": "SELECT * FROM iso WHERE NOT side",
    "notes": """
      SELECT session_id, line_no, ts_us, 'tool_error' AS annotation_type, 'error' AS severity,
        'tool' AS source, result_text AS label, result_text AS detail, tool_call_id AS reference_id
      FROM errors
      UNION ALL
      SELECT session_id, line_no, ts_us, 'model_timeout', 'warning', 'model',
        'Model timeout ' || (gap_us // 1000000) || 's', NULL, uuid FROM g WHERE is_timeout
      UNION ALL
      SELECT session_id, line_no, ts_us, 'inactivity_gap', 'warning', 'user',
        'Inactive ' || (gap_us // 1000000) || 's', NULL, uuid FROM g WHERE gap_kind = 'inactive'""",
    "iso_notes": """
      SELECT *, strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S')
             || CASE WHEN ts_us % 1000000 > 0 THEN '.' || lpad(CAST(ts_us % 1000000 AS VARCHAR), 6, '0')
                ELSE '' END || '+00:00' AS timestamp
      FROM notes""",
    "tracked": """
      SELECT '/logs/u' || user_id || '/events.jsonl' AS file_path,
        CAST(sum(length(props)) AS BIGINT) AS file_size, max(event_id) AS file_mtime,
        lpad(CAST(max(event_id) AS VARCHAR), 12, '0') AS last_parsed_at,
        CASE WHEN user_id % 10 < 7 THEN 'parsed' WHEN user_id % 10 = 7 THEN 'error'
             ELSE 'pending' END AS parse_status
      FROM events GROUP BY user_id""",
    "fresh": "SELECT * FROM sessions WHERE created_us > 1704672000000000",
    "tool_use": """
      SELECT tool_name, CAST(sum(calls) AS BIGINT) AS calls, count(*) AS sessions,
        CAST(sum(error_count) AS BIGINT) AS error_count, sum(latency_us) AS latency_us
      FROM tools WHERE session_id IN (SELECT session_id FROM rows) GROUP BY tool_name""",
}


def with_ctes(sql: str) -> str:
    """Put the subqueries a statement needs in front of it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                visit(CTES[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in needed) + "\n" + sql
