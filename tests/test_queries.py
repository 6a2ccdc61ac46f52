"""Registered queries next to their SQL, and the shape of their plans."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from logloom.plans.catalog import QUERIES
from oracles.queries import statements
from verify import compare, duck

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["time_attribution", "gap_rows", "tool_pairs", "tool_stats", "session_statistics", "list_sessions_logical",
          "yield_and_throughput", "top_tools", "role_coverage", "project_swimlane", "expensive_operations",
          "timeline_density", "synopsis", "best_centroid", "log_lines_to_messages",
          "log_messages_a", "log_results_b", "log_grown_runs", "log_grown_sessions", "log_grown_compactions",
          "log_grown_messages", "similarity_links", "leader_clusters"]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    assert compare(spark, duck(FOLDER), name, queries()[name], oracle_sql()[name], FOLDER) is None


def test_every_statement_has_a_query():
    assert set(oracle_sql()) <= set(queries())
    assert set(QUERIES) == set(statements())


def test_entry(spark):
    assert entry(spark).limit(1).count() == 1


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name,unread", [
    ("time_by_session", ["value", "props"]), ("tool_pairs", ["value"]),
    ("char_totals", ["value", "event_id"]), ("main_and_side_messages", ["value", "event_id"]),
])
def test_plans_have_no_cross_join_and_prune_columns(spark, name, unread):
    plan = plan_of(queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    scans = [x.split("ReadSchema")[1] for x in plan.splitlines() if "ReadSchema" in x]
    assert scans and not any(f"{c}:" in x for x in scans for c in unread)


def test_date_filter_reaches_the_scan(spark, tmp_path):
    from logloom.operators.sessions import filter_sessions

    path = str(tmp_path / "sessions")
    spark.sql("SELECT 'a' AS session_id, DATE'2026-01-01' AS created_date, 'e' AS ecosystem").write.partitionBy(
        "created_date").parquet(path)
    plan = plan_of(filter_sessions(spark.read.parquet(path), start_date="2026-01-01", ecosystem="e"))
    assert "PartitionFilters: [isnotnull(created_date" in plan and "EqualTo(ecosystem,e)" in plan
