"""Every operator as a query over a folder of parquet tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.functions import text as tx
from logloom.functions import vectors as vec
from logloom.operators import attribution as at
from logloom.operators import capabilities as cap
from logloom.operators import clustering as clu
from logloom.operators import coverage as cov
from logloom.operators import deep
from logloom.operators import overview as ov
from logloom.operators import pairing as pair
from logloom.operators import projects as pj
from logloom.operators import session_stats as st
from logloom.operators import sessions as ses
from logloom.operators import similarity as sim
from logloom.operators import synopsis as syn
from logloom.operators import timeline as tl
from logloom.plans import report as rep
from logloom.plans.bindings import event_log_lines, read_table
from logloom.plans.staging import stage
from logloom.sources import export
from logloom.plans.event_store import INACTIVITY, EventStore, event_store
from logloom.plans.log_queries import GROWN_QUERIES, LOG_QUERIES
from logloom.plans.log_store import GrownStore, LogStore, grown_store, log_store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

START, END = "2024-01-03", "2024-01-20"
WATERMARK = 1_704_672_000_000_000  # 2024-01-08T00:00:00Z
SIMILAR = 0.3


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Plain result types: rounded doubles, 64-bit integers, arrays as joined text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), digits)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.DecimalType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), "|")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        out.append(c.alias(f.name))
    return df.select(*out)


def on_events(digits: int = 6):
    """Register a query over the event store of a folder."""
    def register(f: Callable[[EventStore], DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: tidy(f(event_store(spark, folder)), digits)
        return f
    return register


def on_table(*tables: str, digits: int = 6):
    """Register a query over plain tables."""
    def register(f: Callable[..., DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: tidy(
            f(*[read_table(spark, folder, t) for t in tables]), digits)
        return f
    return register


# --- sessions: time, messages, tools, shell, characters --------------------------

@on_events()
def time_attribution(s):
    return st.message_totals(s.gaps)


@on_events()
def gap_rows(s):
    return s.gaps.select("session_id", "line_no", "gap_us", "gap_kind", "is_timeout")


@on_events()
def time_by_session(s):
    return at.time_by_session(s.gaps)


@on_events()
def activity_windows(s):
    return at.activity_windows(s.messages, INACTIVITY)


@on_events()
def tool_pairs(s):
    return s.pairs.select("session_id", "line_no", "tool_id", "matched", "name", "call_us",
                          "latency_us", F.array_join("call_commands", ",").alias("commands"))


@on_events()
def orphan_results(s):
    return pair.orphan_counts(s.pairs)


@on_events(digits=8)
def tool_stats(s):
    return st.tool_stats(s.blocks, s.pairs)


@on_events(digits=8)
def tool_group_stats(s):
    return st.tool_group_stats(s.tools)


@on_events()
def tool_success(s):
    return st.tool_success(s.tools)


@on_events()
def tool_categories(s):
    return s.tools.groupBy(tx.tool_category(F.col("tool_name")).alias("category")).agg(
        F.sum("calls").alias("calls"))


@on_events()
def top_tools_by_session(s):
    return st.top_tools_by_session(s.tools, 3).select("session_id", "tool_rank", "tool_name", "calls")


@on_events()
def error_prone_tools(s):
    return st.top_tools_by_session(s.tools, 2, by="error_count").select(
        "session_id", "tool_rank", "tool_name", "error_count")


@on_events()
def error_records(s):
    return st.error_records(s.pairs)


@on_events()
def error_categories(s):
    return st.error_categories(s.errors)


@on_events()
def shell_distribution(s):
    return st.shell_distribution(s.blocks)


@on_events(digits=8)
def shell_commands(s):
    return st.shell_commands(s.blocks, s.pairs)


@on_events()
def char_totals(s):
    return st.char_totals(s.blocks)


@on_events()
def session_statistics(s):
    return s.stats


@on_events()
def session_metadata(s):
    return st.session_metadata(s.messages)


@on_events()
def session_rows(s):
    return s.sessions.select("session_id", "logical_session_id", "parent_session_id",
                             "root_session_id", "bottleneck", "automation_ratio",
                             "total_tool_calls", "duration_seconds")


@on_events()
def session_display(s):
    return st.session_display(s.sessions)


@on_events()
def subagents(s):
    return st.subagents(s.messages)


@on_events()
def sidechain_links(s):
    return st.sidechain_links(s.messages)


@on_events()
def models_used(s):
    return st.models_used(s.messages)


@on_events()
def main_and_side_messages(s):
    main = ses.main_stream(s.messages).groupBy("record_type").agg(F.count("*").alias("messages"))
    side = ses.side_chain(s.messages).groupBy("record_type").agg(F.count("*").alias("messages"))
    return main.withColumn("stream", F.lit("main")).unionByName(side.withColumn("stream", F.lit("side")))


# --- session lists -----------------------------------------------------------------

@on_events()
def logical_view(s):
    return ses.logical_view(s.sessions).select("ecosystem", "logical_session_id", "session_id",
                                               "total_tokens")


@on_events()
def list_sessions_physical(s):
    return ses.list_sessions(s.sessions, sort_by="tokens", limit=25, offset=10,
                             start_date=START, end_date=END, min_tokens=50).select(
        "session_id", "total_tokens", "total_messages")


@on_events()
def list_sessions_logical(s):
    return ses.list_sessions(s.sessions, sort_by="automation", sort_order="ASC", limit=40,
                             view_mode="logical", max_messages=30, bottleneck="model").select(
        "session_id", "logical_session_id", "automation_ratio")


@on_events()
def count_sessions(s):
    kinds = [("physical", {}), ("logical", {}), ("physical", {"min_automation": 1.0}),
             ("logical", {"ecosystem": "source_1", "max_tokens": 400})]
    parts = [ses.count_sessions(s.sessions, view_mode=v, **f).withColumn("case", F.lit(i))
             for i, (v, f) in enumerate(kinds)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@on_events()
def browse_sessions(s):
    f = ses.BrowseFilters(search=" TEAM/P3 ", tokens=(900, 100), automation_band="medium",
                          sort_by="duration")
    return ses.browse_sessions(s.sessions, f).select("session_id", "total_tokens", "automation_ratio")


@on_events()
def statistics_of_large_sessions(s):
    ids = s.sessions.filter(F.col("total_tokens") > 500)
    return ses.statistics_for(s.stats, ids).select("session_id", "total_tokens", "message_count")


@on_events()
def sessions_with_files(s):
    return s.sessions.select("session_id", F.col("source_path").alias("file_path")).join(
        s.tracked, "file_path")


@on_events()
def session_totals(s):
    return ses.session_totals(s.sessions)


@on_events()
def distinct_projects(s):
    return ses.distinct_values(s.sessions, "project_path")


# --- cross-session -----------------------------------------------------------------

@on_events()
def overview_totals(s):
    return ov.overview_totals(s.rows())


@on_events()
def yield_and_throughput(s):
    return ov.yield_and_throughput(s.rows())


@on_events()
def bottleneck_distribution(s):
    return ov.bottleneck_distribution(s.rows())


@on_events()
def top_projects(s):
    return ov.top_projects(s.rows(START, END))


@on_events()
def top_tools(s):
    return ov.top_tools(s.rows(), s.tools)


@on_events()
def call_weighted_latency(s):
    return ov.call_weighted_latency(s.tools)


@on_events()
def source_breakdown(s):
    return ov.source_breakdown(s.rows(), {"source_0": "First"})


@on_events()
def role_source_matrix(s):
    return ov.role_source_matrix(s.rows())


@on_events(digits=2)
def day_night_times(s):
    return ov.day_night_times(s.rows())


@on_events()
def day_night_shares(s):
    times = ov.day_night_times(s.rows())
    return ov.day_night_shares(times, False).select("period", "share").withColumn(
        "share_all", F.lit(None).cast("double")).unionByName(
        ov.day_night_shares(times, True).select(
            F.concat("period", F.lit("+")).alias("period"), F.lit(None).cast("double").alias("share"),
            F.col("share").alias("share_all")))


@on_events()
def role_coverage(s):
    return cov.role_coverage(s.rows(START, END), START, END)


@on_events()
def coverage_ratios(s):
    return cov.coverage_ratios(cov.role_coverage(s.rows(START, END), START, END))


@on_events()
def activity_coverage(s):
    """Time with at least one event every 30 minutes, per source."""
    spans = s.messages.select("ecosystem", F.col("ts_us").alias("start_us"),
                              (F.col("ts_us") + 1_800_000_000).alias("end_us"))
    return cov.union_measure(spans, ["ecosystem"])


def _distribution(dimension: str):
    QUERIES[f"distribution_{dimension}"] = lambda spark, folder: tidy(
        ov.distribution(event_store(spark, folder).rows(), dimension,
                        event_store(spark, folder).tools if dimension == "tool" else None))


for _d in ov.DIMENSIONS:
    _distribution(_d)


@on_events()
def timeseries_day(s):
    return ov.timeseries(s.rows(), "day")


@on_events()
def timeseries_week(s):
    return ov.timeseries(s.rows(), "week")


@on_events()
def project_comparison(s):
    return pj.project_comparison(s.rows(), 6)


@on_events()
def project_swimlane(s):
    return pj.project_swimlane(s.rows(), "day", 4)


@on_events()
def swimlane_frame(s):
    return pj.swimlane_frame(s.rows(), "week", 4)


@on_events()
def code_line_estimate(s):
    return ov.code_line_estimate(ov.overview_totals(s.rows()))


@on_events()
def ingest_status(s):
    return rep.ingest_status(s.tracked, s.sessions)


@on_events()
def incremental_summary(s):
    return rep.summary_totals(s.sessions, s.stats, WATERMARK)


@on_events()
def incremental_counts(s):
    return rep.summary_counts(s.sessions, s.errors, WATERMARK)


@on_events()
def incremental_excerpts(s):
    return rep.error_excerpts(s.sessions, s.errors, WATERMARK)


@on_events()
def incremental_top_errors(s):
    return rep.top_error_categories(rep.summary_counts(s.sessions, s.errors, WATERMARK), 3)


# --- deep analytics and timelines ----------------------------------------------------

@on_events()
def token_heatmap(s):
    return deep.token_heatmap(s.messages)


@on_events()
def heatmap_summary(s):
    return deep.heatmap_summary(deep.token_heatmap(s.messages))


@on_events()
def expensive_operations(s):
    return deep.expensive_operations(s.messages, s.blocks, 5)


@on_events(digits=8)
def tool_patterns(s):
    return deep.tool_patterns(s.tools)


@on_events()
def tool_parameters(s):
    return deep.tool_parameters(s.blocks)


@on_events()
def subagent_efficiency(s):
    return deep.subagent_efficiency(_typed_agents(s))


def _typed_agents(s):
    types = tl.subagent_types(s.blocks)
    return st.subagents(s.messages).drop("agent_type").join(types, ["session_id", "agent_id"])


@on_events()
def session_anomalies(s):
    return deep.anomalies(deep.token_heatmap(s.messages), deep.tool_patterns(s.tools))


@on_events()
def recommendations(s):
    found = deep.anomalies(deep.token_heatmap(s.messages), deep.tool_patterns(s.tools))
    return deep.recommendations(s.stats, found, s.tools, deep.subagent_efficiency(_typed_agents(s)))


def _week_pairs(s):
    """Each user's session and the one of the following week."""
    ids = s.sessions.select(F.col("session_id").alias("a"))
    return ids.select("a", F.concat(F.substring_index("a", "-", 1), F.lit("-"),
                                    (F.substring_index("a", "-", -1).cast("bigint") + 1)
                                    .cast("string")).alias("b"))


@on_events()
def compare_sessions(s):
    return deep.compare_sessions(_week_pairs(s), s.stats)


@on_events()
def metric_diffs(s):
    d = deep.metric_diff(F.col("total_input_tokens"), F.col("total_output_tokens"))
    return s.stats.select("session_id", d.alias("d")).select("session_id", "d.*")


@on_events()
def timeline_density(s):
    return tl.timeline_density(s.messages)


@on_events()
def timeline_anomalies(s):
    return tl.timeline_anomalies(s.messages)


@on_events()
def timeline_roles(s):
    return s.messages.groupBy("session_id", tl.timeline_role().alias("role")).agg(
        F.count("*").alias("messages"), F.count_if(tl.is_technical()).alias("technical"))


@on_events()
def subagent_types(s):
    return tl.subagent_types(s.blocks)


@on_events()
def visible_messages(s):
    return pair.visible_messages(s.messages, s.blocks).select("session_id", "line_no", "uuid")


@on_events()
def annotations(s):
    return tl.annotations(s.errors, s.gaps)


@on_events()
def selected_annotations(s):
    return tl.select_annotations(tl.annotations(s.errors, s.gaps), ["tool_error", "model_timeout"],
                                 start_us=WATERMARK)


@on_events()
def goals_and_outcomes(s):
    return syn.goals_and_outcomes(s.messages)


@on_events()
def synopsis(s):
    return syn.synopsis(s.sessions, s.stats, s.messages, s.tools, s.errors).drop(
        "synopsis_hash", "created_at", "updated_at")


@on_events()
def summary_work_list(s):
    n = F.substring_index("session_id", "-", -1).cast("bigint")
    wanted = s.sessions.select("session_id", F.sha2("session_id", 256).alias("synopsis_hash"))
    done = wanted.select(
        "session_id", "synopsis_hash",
        F.when(n % 2 == 0, F.lit("completed")).otherwise(F.lit("failed")).alias("generation_status"),
        (n % 3 > 0).alias("has_output"))
    return syn.work_list(wanted, done, ["session_id", "synopsis_hash"])


@on_events()
def capability_drift(s):
    table = {"source_0": {**cap.CAPABILITIES["format_a"], "cache_creation_tokens": False},
             "source_1": {**cap.CAPABILITIES["format_b"], "tool_call_events": False}}
    stats = s.stats.join(s.sessions.select("session_id", "ecosystem"), "session_id")
    return cap.capability_drift(stats, cap.capability_table(s.spark, table))


@on_events()
def capability_notices(s):
    """Notices of the formats in use, with the sessions each one concerns."""
    table = {"source_0": cap.CAPABILITIES["format_a"], "source_1": cap.CAPABILITIES["format_b"]}
    notices = cap.capability_notices(cap.capability_table(s.spark, table))
    used = s.sessions.groupBy("ecosystem").agg(F.count("*").alias("sessions"))
    return used.join(F.broadcast(notices), "ecosystem")


@on_events()
def export_metrics(s):
    return export.metric_rows(s.stats)


@on_events()
def export_tools(s):
    return export.tool_rows(s.tools)


@on_events()
def export_tool_patterns(s):
    tables = _exports(s)
    return tables["tool_patterns"]


@on_events()
def export_bottlenecks(s):
    return _exports(s)["bottlenecks"]


def _exports(s):
    found = deep.anomalies(deep.token_heatmap(s.messages), deep.tool_patterns(s.tools))
    agents = deep.subagent_efficiency(_typed_agents(s))
    return export.analytics_tables(
        deep.expensive_operations(s.messages, s.blocks), deep.tool_patterns(s.tools),
        deep.tool_parameters(s.blocks), agents, found,
        deep.recommendations(s.stats, found, s.tools, agents), deep.token_heatmap(s.messages))


# --- logs ------------------------------------------------------------------------------

@on_table("events")
def log_lines_to_messages(events):
    """Events rendered as log lines, read back through the line normaliser."""
    from logloom.sources.format_a import normalize_a
    from logloom.sources.variants import decode

    lines = stage(decode(stage(event_log_lines(events), "lines")), "decoded")
    m = normalize_a(lines).messages
    return m.groupBy(F.col("line_session_id").alias("session_id")).agg(
        F.count("*").alias("messages"), F.count_if("has_tool_result").alias("results"),
        F.count_if("has_usage").alias("with_usage"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum("cache_read_tokens").alias("cache_read_tokens"),
        F.sum("ts_us").cast("decimal(38,0)").cast("string").alias("ts_sum"))


# --- texts -----------------------------------------------------------------------------

@on_table("documents")
def document_characters(documents):
    c = documents.select("lang", tx.char_classes(F.col("text")).alias("c"))
    return c.groupBy("lang").agg(*[F.sum(f"c.{n}").alias(n) for n in
                                   ("total", "cjk", "latin", "digit", "space", "other")])


@on_table("conversations")
def conversation_characters(conversations):
    c = conversations.select("conv_id", "role", tx.char_classes(F.col("text")).alias("c"))
    return c.groupBy("conv_id", "role").agg(F.count("*").alias("turns"),
                                            F.sum("c.total").alias("chars"),
                                            F.sum("c.latin").alias("latin"))


@on_table("documents")
def document_previews(documents):
    return documents.select("doc_id", tx.truncate_words(F.col("text"), 80).alias("preview"))


@on_table("documents")
def document_error_rules(documents):
    from logloom.functions.errors import category_of_rule, error_rule

    rule = error_rule(F.col("text"))
    return documents.groupBy(category_of_rule(rule).alias("category")).agg(
        F.count("*").alias("documents"))


@on_table("conversations")
def repeated_prompts(conversations):
    key = tx.prompt_key(F.col("text"))
    return conversations.filter(F.col("role") == "user").groupBy(
        F.sha2(key, 256).alias("prompt")).agg(F.count("*").alias("uses"),
                                              F.min("conv_id").alias("first_conv"))


# --- vectors ---------------------------------------------------------------------------

def _vectors(e):
    return e.select(F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("id"), "label",
                    F.col("embedding").alias("vector"))


@on_table("embeddings", digits=4)
def cosine_to_centroid(embeddings):
    v = _vectors(embeddings)
    return v.join(vec.centroids(v, ["label"]), "label").select(
        "id", "label", vec.cosine(F.col("vector"), F.col("centroid")).alias("similarity"))


@on_table("embeddings", digits=4)
def best_centroid(embeddings):
    v = _vectors(embeddings)
    targets = vec.centroids(v, ["label"]).select(
        F.col("label").cast("string").alias("id"), F.col("centroid").alias("vector"))
    return clu.best_match(v, targets)


@on_table("embeddings", digits=4)
def leader_clusters(embeddings):
    return clu.leader_clusters(_vectors(embeddings), SIMILAR)


@on_table("embeddings")
def similarity_links(embeddings):
    """How many other vectors each vector is similar to, with equal vectors as one class."""
    return sim.similarity_links(_vectors(embeddings), SIMILAR)


@on_table("embeddings")
def leader_cluster_sizes(embeddings):
    return clu.cluster_sizes(clu.leader_clusters(_vectors(embeddings), SIMILAR))


@on_table("embeddings")
def embedding_dimension(embeddings):
    return clu.check_dimension(_vectors(embeddings))


# --- pages, hashes, zones, cluster runs ----------------------------------------------------

@on_events()
def session_page_rows(s):
    return ses.session_page(s.sessions, page=2, page_size=30, sort_by="tokens")[0].select("session_id", "total_tokens")


@on_events()
def session_page_counts(s):
    return ses.session_page(s.sessions, page_size=30, sort_by="parsed", view_mode="logical")[1]


@on_events()
def user_messages(s):
    return ses.messages_of_type(s.messages, "user").groupBy("session_id").agg(F.count("*").alias("messages"))


@on_table("documents")
def document_hashes(documents):
    return documents.select("doc_id", tx.content_hash(F.col("text")).alias("hash"))


@on_table("documents")
def file_ids(documents):
    """Ids at the end of file stems; every third stem carries none."""
    h = F.md5(F.col("doc_id").cast("string"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    own = F.when(F.col("doc_id") % 3 > 0, F.concat_ws("-", *parts)).otherwise(F.lit("none"))
    return documents.select("doc_id", tx.uuid_tail(F.concat(F.lit("rollout-2026-"), own)).alias("file_id"))


@on_table("events")
def night_time_in_zone(events):
    """Night share of an hour after every event, on the clock of a zone half an hour off."""
    from logloom.functions.dates import night_micros, ntz_micros

    night = night_micros(ntz_micros(F.col("ts")), F.lit(3_600_000_000), "Asia/Kolkata")
    return events.groupBy("user_id").agg(F.sum(night).alias("night_us"), F.count("*").alias("events"))


def _runs(embeddings):
    rows = embeddings.select(F.col("vec_id").cast("string").alias("session_id"),
                             F.concat(F.lit("run"), F.col("label").cast("string")).alias("run_id"), "label")
    runs = rows.select("run_id", F.lpad(F.col("label").cast("string"), 4, "0").alias("generated_at")).distinct()
    return runs, rows.select("run_id", "session_id")


@on_table("embeddings")
def latest_cluster_members(embeddings):
    return clu.latest_memberships(*_runs(embeddings))


@on_table("embeddings")
def cluster_run(embeddings):
    return clu.run_snapshot(embeddings.select("vec_id", "label"), run_id="r", generated_at="t", model_id="m",
                            threshold=SIMILAR, cluster="label")


@on_table("embeddings")
def completed_vectors(embeddings):
    n = F.col("vec_id")
    stored = embeddings.select(
        n.cast("string").alias("session_id"), F.when(n % 5 > 0, F.lit("m")).otherwise(F.lit("old")).alias("model_id"),
        F.when(n % 3 > 0, F.lit("completed")).otherwise(F.lit("failed")).alias("generation_status"),
        F.when(n % 7 > 0, F.col("embedding")).otherwise(F.slice("embedding", 1, 0)).alias("vector"))
    return clu.completed_vectors(stored, "m").select("id", F.size("vector").alias("dimension"))


# --- log files ---------------------------------------------------------------------------

def _on_logs(f: Callable[[LogStore], DataFrame]) -> Query:
    return lambda spark, folder: tidy(f(log_store(spark, folder)))


def _on_grown_logs(f: Callable[[GrownStore], DataFrame]) -> Query:
    return lambda spark, folder: tidy(f(grown_store(spark, folder)))


for _f in LOG_QUERIES:
    QUERIES[_f.__name__] = _on_logs(_f)
for _f in GROWN_QUERIES:
    QUERIES[_f.__name__] = _on_grown_logs(_f)
