"""Column layout of the two central tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# One content block of a message; string content is one block of type "string".
BLOCK = """struct<
  block_type: string, text: string,
  tool_name: string, tool_id: string, command: string, param_keys: array<string>,
  input_json: string, is_error: boolean, result_text: string, result_string: string,
  output_chars: bigint>"""

MESSAGES = f"""
  ecosystem string, source_path string, session_id string, line_no bigint, uuid string,
  timestamp string, ts_us bigint, inferred_ts boolean, record_type string, role string,
  parent_uuid string, user_type string, cwd string, version string, git_branch string,
  is_sidechain boolean, agent_id string, is_meta boolean, model string,
  has_usage boolean, input_tokens bigint, output_tokens bigint,
  cache_creation_tokens bigint, cache_read_tokens bigint, service_tier string,
  content_string boolean, has_tool_result boolean, summary string, details_json string,
  blocks array<{BLOCK}>"""

SESSION = "session_id"


def explode_blocks(messages: DataFrame) -> DataFrame:
    """One row per content block with the message facts the operators need."""
    parts = messages.select(
        "session_id", "line_no", "uuid", "ts_us", "timestamp", "record_type", "role",
        "is_sidechain", "agent_id", "has_usage",
        (F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0)))
        .alias("usage_tokens"),
        (F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))
         + F.coalesce("cache_creation_tokens", F.lit(0))
         + F.coalesce("cache_read_tokens", F.lit(0))).alias("all_tokens"),
        F.posexplode("blocks").alias("block_no", "b"),
    )
    return parts.select("*", "b.*").drop("b")
