"""Logs to tables: what is new in the files is parsed, the per-session tables upserted.

A file that was only appended to is read on from its last consumed line; new and rewritten files
are read whole. Messages are kept by file as they come from their lines, so the tables of a session
are made anew from its kept messages and the new ones, and equal those of a run over whole files.
A last line without a line end counts if it is JSON (the file is then read whole next time); else it
is left for the next run. A file that was in error is read whole again.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators import session_stats as st
from logloom.operators.attribution import INACTIVITY, MODEL_TIMEOUT, with_gaps
from logloom.operators.pairing import pair_tools
from logloom.operators.timeline import annotations
from logloom.plans.staging import stage
from logloom.schemas import explode_blocks
from logloom.sources.registry import LogFormat, log_format
from logloom.sources.scan import list_files, number_lines, scan_logs
from logloom.sources.store import TableStore
from logloom.sources.tail import probe, read_tails
from logloom.sources.variants import decode

OTHER_FILE = "another file holds this session"

# Tables with one or more rows per session, replaced as a whole when a session is re-read.
CHILD_TABLES = ("tool_stats", "tool_errors", "tool_groups", "shell_commands",
                "shell_distribution", "compact_events", "subagents", "annotations")


@dataclass
class IngestResult:
    parsed: int
    skipped: int
    errors: int
    #: Files read on from a byte, and bytes of logs to read: whole files and the new parts of others.
    resumed: int = 0
    bytes_read: int = 0


def changed_files(listing: DataFrame, tracked: DataFrame | None, force: bool = False) -> DataFrame:
    """Files that are new, changed, or failed last time."""
    if force or tracked is None:
        return listing
    same = tracked.filter(F.col("parse_status") == "parsed").select(
        "file_path", "file_size", "file_mtime")
    return listing.join(same, ["file_path", "file_size", "file_mtime"], "left_anti")


def _lines_of(spark: SparkSession, root: str, fmt, changed: DataFrame) -> DataFrame:
    """Lines of the changed files: files modified since the oldest of them, less the unchanged ones."""
    second_before = F.timestamp_micros(F.min("file_mtime") - 1_000_000)
    oldest = changed.agg(F.date_format(second_before, "yyyy-MM-dd'T'HH:mm:ss")).first()[0]
    return scan_logs(spark, root, fmt, modified_after=oldest, only=changed)


def session_tables(messages: DataFrame, *, compacts: DataFrame, lineage: DataFrame | None,
                   file_sizes: DataFrame | None, inactivity: float, model_timeout: float) -> dict:
    """Every per-session table of a set of messages."""
    blocks = explode_blocks(messages)
    pairs = stage(pair_tools(blocks), "pairs")
    tools = stage(st.tool_stats(blocks, pairs), "tools")
    errors = stage(st.error_records(pairs), "errors")
    stats = stage(st.session_statistics(
        messages, blocks, compacts=compacts, file_sizes=file_sizes, inactivity=inactivity,
        model_timeout=model_timeout, pairs=pairs, tools=tools), "stats")
    gaps = with_gaps(messages, inactivity, model_timeout)
    return {
        "sessions": st.session_rows(st.session_metadata(messages), stats, lineage),
        "session_statistics": stats,
        "tool_stats": tools,
        "tool_groups": st.tool_group_stats(tools),
        "tool_errors": errors,
        "shell_commands": st.shell_commands(blocks, pairs),
        "shell_distribution": st.shell_distribution(blocks),
        "subagents": st.subagents(messages),
        "compact_events": compacts,
        "annotations": annotations(errors, gaps, compacts),
    }


def one_file_per_session(messages: DataFrame, stored: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Messages of the files that count, and the paths of files that hold a session of another.

    Of several files with one session id the last path counts, whether it was read in this run or
    in an earlier one, so the tables do not depend on the order of runs.
    """
    own = messages.select("session_id", "source_path").distinct()
    known = own if stored is None else own.unionByName(
        stored.select("session_id", "source_path").join(own, "session_id", "left_semi"))
    last = known.groupBy("session_id").agg(F.max("source_path").alias("source_path"))
    both = ["session_id", "source_path"]
    lost = own.join(last, both, "left_anti").select("source_path").distinct()
    return messages.join(last, both, "left_semi"), lost


def _plan(changed: DataFrame, tracked: DataFrame | None, fmt: LogFormat, force: bool) -> DataFrame:
    """changed files with base and base_lines (consumed before; 0 to read whole), line_end and new_mark."""
    known = None
    if tracked is not None and fmt.convert is not None and not force and "mark" in tracked.columns:
        known = tracked.filter((F.col("parse_status") == "parsed") & F.col("mark").isNotNull()).select(
            "file_path", "read_bytes", "read_lines", "mark")
    rows = changed.withColumns({"read_bytes": F.lit(0), "read_lines": F.lit(0), "mark": F.lit(None).cast("string")}) \
        if known is None else changed.join(known, "file_path", "left")
    probed = stage(probe(rows), "probed")
    grown = F.coalesce("grown", F.lit(False))
    return rows.join(probed, "file_path").select(
        *changed.columns, F.when(grown, F.col("read_bytes")).otherwise(0).cast("bigint").alias("base"),
        F.when(grown, F.col("read_lines")).otherwise(0).cast("bigint").alias("base_lines"), "line_end", "new_mark")


def _read(spark: SparkSession, root: str, fmt: LogFormat, plan: DataFrame) -> DataFrame:
    """Numbered lines of the planned files: whole ones and the new parts of the others."""
    parts = []
    whole, tails = plan.filter("base = 0"), plan.filter("base > 0")
    if not whole.isEmpty():
        parts.append(_lines_of(spark, root, fmt, whole).select("source_path", "line_no", "kind", "v"))
    if not tails.isEmpty():
        raw = read_tails(tails).select("source_path", "split", "rank", F.col("value").cast("string").alias("value"))
        numbered = number_lines(stage(decode(raw), "tails"))
        before = tails.select(F.col("file_path").alias("source_path"), "base_lines")
        parts.append(numbered.join(before, "source_path").select(
            "source_path", (F.col("line_no") + F.col("base_lines")).alias("line_no"), "kind", "v"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def _without_open_ends(lines: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines less the broken last ones without a line end; per file read_bytes, read_lines and mark.

    mark is null where the file has to be read whole next time.
    """
    paths = plan.select(F.col("file_path").alias("source_path"), "base_lines", "line_end", "new_mark",
                        ((F.col("line_end") < F.col("file_size")) & (F.col("line_end") > 0)).alias("open"))
    ends = lines.groupBy("source_path").agg(F.max("line_no").alias("last"), F.max_by("kind", "line_no").alias("last_kind"))
    ends = stage(paths.join(ends, "source_path", "left").withColumn(
        "waits", F.coalesce(F.col("open") & (F.col("last_kind") == "bad"), F.lit(False))), "line-ends")
    waiting = ends.filter("waits").select("source_path", F.col("last").alias("line_no"))
    n = F.coalesce("last", "base_lines") - F.col("waits").cast("bigint")
    consumed = F.coalesce("open", F.lit(False)) & ~F.col("waits") & F.col("last").isNotNull()
    progress = ends.select(F.col("source_path").alias("file_path"), F.col("line_end").alias("read_bytes"),
                           n.alias("read_lines"), F.when(~consumed, F.col("new_mark")).alias("mark"))
    return lines.join(waiting, ["source_path", "line_no"], "left_anti"), progress


@dataclass
class _Part:
    """What a run reads of one format: plan and progress by file, and whole messages of the files that count."""

    plan: DataFrame
    progress: DataFrame
    messages: DataFrame
    compacts: DataFrame
    errors: DataFrame
    lineage: DataFrame | None
    read: DataFrame


def _kept_and_new(store: TableStore, name: str, new: DataFrame, plan: DataFrame, errors: DataFrame) -> DataFrame:
    """Rows of the resumed files as they were kept, and the new rows; both go into the store."""
    path = F.col("file_path").alias("source_path")
    resumed = plan.filter("base > 0").select(path).join(errors.select("source_path"), "source_path", "left_anti")
    old = store.read_keys(name, resumed)
    again = plan.filter("base = 0").select(path)
    if old is not None:
        store.delete(name, again)
    store.append(name, new, "source_path")
    return new if old is None else old.unionByName(new, allowMissingColumns=True)


def _first_facts(facts: DataFrame) -> DataFrame:
    """One row per file: of each fact the value of the earliest run that saw one."""
    names = [c for c in facts.columns if c not in ("source_path", "run")]
    return facts.groupBy("source_path").agg(*[
        F.min_by(c, F.when(F.col(c).isNotNull(), F.col("run"))).alias(c) for c in names])


def _read_format(spark: SparkSession, store: TableStore, root: str, fmt: LogFormat, plan: DataFrame) -> _Part:
    lines, progress = _without_open_ends(_read(spark, root, fmt, plan), plan)
    if fmt.convert is None:
        done = fmt.normalize(lines)
        done.messages = stage(done.messages, "messages")
        return _Part(plan, progress, done.messages, done.compacts, done.errors, done.lineage,
                     done.messages.select("source_path").distinct())
    done = fmt.convert(lines)
    errors = stage(done.errors, "rejected")
    messages = _kept_and_new(store, f"file_messages_{fmt.name}", stage(done.messages, "converted"), plan, errors)
    compacts = _kept_and_new(store, f"file_compacts_{fmt.name}", stage(done.compacts, "compacts"), plan, errors)
    facts = None
    if done.facts is not None:
        new = stage(done.facts.withColumn("run", F.lit(store.version)), "facts")
        facts = _first_facts(_kept_and_new(store, f"file_facts_{fmt.name}", new, plan, errors))
    finished, lineage = fmt.finish(messages, facts)
    return _Part(plan, progress, stage(finished, "messages"), compacts, errors, lineage,
                 messages.select("source_path").distinct())
def ingest(spark: SparkSession, roots: dict[str, str], store: TableStore, *, force: bool = False,
           parsed_at: str = "", inactivity: float = INACTIVITY,
           model_timeout: float = MODEL_TIMEOUT) -> IngestResult:
    """One run over the roots of all formats; nothing is visible until the final commit.

    Raises ConcurrentCommit, having changed nothing, if another run committed in the meantime.
    """
    store.begin()
    tracked = store.read("tracked_files")
    parts: list[tuple[LogFormat, _Part]] = []
    found = 0
    for name, root in roots.items():
        fmt = log_format(name)
        listing = list_files(spark, root, fmt).withColumn("ecosystem", F.lit(name))
        listing = stage(listing, "listing")
        found += listing.count()
        mine = tracked.filter(F.col("ecosystem") == name) if tracked is not None else None
        changed = changed_files(listing, mine, force)
        if not changed.isEmpty():
            plan = stage(_plan(changed, mine, fmt, force), "plan")
            parts.append((fmt, _read_format(spark, store, root, fmt, plan)))
    if not parts:
        return IngestResult(0, found, 0)

    union = lambda frames: reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    plan = union([p.plan for _, p in parts])
    all_messages = union([p.messages for _, p in parts])
    counted, lost = one_file_per_session(all_messages, store.read("sessions"))
    messages, lost = stage(counted, "messages"), stage(lost, "lost")
    owners = messages.select("session_id", "source_path").distinct()
    compacts = union([p.compacts for _, p in parts]).drop("session_id").join(owners, "source_path")
    sizes = union([p.plan.select(F.col("file_path").alias("source_path"), F.when(F.lit(fmt.reports_file_size), F.col("file_size"))
                                 .otherwise(0).alias("file_size")) for fmt, p in parts]).join(owners, "source_path")
    lineages = [p.lineage for _, p in parts if p.lineage is not None]
    lineage = union(lineages).groupBy("session_id").agg(
        F.first("parent_session_id", True).alias("parent_session_id"),
        F.first("root_session_id", True).alias("root_session_id")) if lineages else None
    tables = session_tables(messages, compacts=stage(compacts, "compacts"), lineage=lineage,
                            file_sizes=sizes, inactivity=inactivity, model_timeout=model_timeout)

    ids = owners.select("session_id").distinct()
    store.upsert("sessions", tables.pop("sessions").withColumn("parsed_at", F.lit(parsed_at)),
                 ["session_id"])
    store.upsert("session_statistics", tables.pop("session_statistics"), ["session_id"])
    for name in CHILD_TABLES:
        store.upsert(name, tables[name], ["session_id"], replaced=ids)

    reasons = union([p.errors for _, p in parts]).select(F.col("source_path").alias("file_path"), "line_no", "reason")
    read = union([p.read for _, p in parts]).select(
        F.col("source_path").alias("file_path"), F.lit(True).alias("read")).distinct()
    other = lost.select(F.col("source_path").alias("file_path"), F.lit(OTHER_FILE).alias("other"))
    outcome = stage(plan.join(reasons, "file_path", "left").join(read, "file_path", "left")
                    .join(other, "file_path", "left").join(union([p.progress for _, p in parts]), "file_path").withColumn(
        "reason", F.coalesce("reason", F.when(F.col("read").isNull(), F.lit("no valid messages")), "other")),
        "outcome")
    status = F.when(F.coalesce("reason", F.lit(OTHER_FILE)) == OTHER_FILE, F.lit("parsed")).otherwise(F.lit("error"))
    new_tracked = outcome.select("file_path", "file_size", "file_mtime", "ecosystem",
                                 F.lit(parsed_at).alias("last_parsed_at"), status.alias("parse_status"),
                                 "read_bytes", "read_lines", "mark")
    store.upsert("tracked_files", new_tracked, ["file_path"])
    failed = outcome.filter(F.col("reason").isNotNull()).select("file_path", "line_no", "reason")
    store.upsert("ingest_errors", failed, ["file_path"], replaced=outcome.select("file_path"))
    store.commit()
    counts = {r["parse_status"]: r["count"] for r in new_tracked.groupBy("parse_status").count().collect()}
    totals = plan.agg(F.count_if(F.col("base") > 0), F.sum(F.col("file_size") - F.col("base")), F.count("*")).first()
    return IngestResult(counts.get("parsed", 0), found - totals[2], counts.get("error", 0), totals[0], totals[1])


def delete_session(store: TableStore, session_id: str) -> None:
    """Remove one session from every table."""
    store.begin()
    keys = store.spark.createDataFrame([(session_id,)], "session_id string")
    for name in ("sessions", "session_statistics", *CHILD_TABLES):
        store.delete(name, keys)
    store.commit()


def set_file_status(store: TableStore, file_path: str, status: str) -> None:
    """Change the parse status of one tracked file."""
    store.begin()
    keys = store.spark.createDataFrame([(file_path,)], "file_path string")
    mine = store.read_keys("tracked_files", keys)
    store.upsert("tracked_files", mine.withColumn("parse_status", F.lit(status)), ["file_path"])
    store.commit()


def replace_cluster_run(store: TableStore, run: DataFrame, members: DataFrame) -> None:
    """Publish a clustering run; it takes the place of the earlier one."""
    store.write("cluster_runs", run)
    store.write("cluster_memberships", members)
    store.commit()
