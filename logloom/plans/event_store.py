"""Tables derived from an event feed: the inputs of every cross-session operator.

The messages and the per-session tables are written once to the shared folder, as an ingest
run would; other row-level frames stay lazy.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators import sessions as ses
from logloom.operators import session_stats as st
from logloom.operators.pairing import pair_tools
from logloom.plans.bindings import event_lineage, event_messages, read_table
from logloom.plans.staging import stage
from logloom.schemas import explode_blocks

# Events of one user lie hours apart, so the thresholds are in hours too.
INACTIVITY = 6 * 3600.0
MODEL_TIMEOUT = 2 * 3600.0


@dataclass
class EventStore:
    """Frames over `<folder>/events.parquet`."""

    spark: SparkSession
    folder: str

    @cached_property
    def messages(self) -> DataFrame:
        """The feed, dealt out by event and written once; every operator reads it from there."""
        events = read_table(self.spark, self.folder, "events").repartition("event_id")
        return stage(event_messages(events), "messages")

    @cached_property
    def blocks(self) -> DataFrame:
        return explode_blocks(self.messages)

    @cached_property
    def pairs(self) -> DataFrame:
        return pair_tools(self.blocks)

    @cached_property
    def gaps(self) -> DataFrame:
        from logloom.operators.attribution import with_gaps

        return with_gaps(self.messages, INACTIVITY, MODEL_TIMEOUT)

    @cached_property
    def paired(self) -> DataFrame:
        """The pairs written once, for the tables built from them."""
        return stage(self.pairs, "pairs")

    @cached_property
    def tools(self) -> DataFrame:
        return stage(st.tool_stats(self.blocks, self.paired), "tools")

    @cached_property
    def errors(self) -> DataFrame:
        return stage(st.error_records(self.paired), "errors")

    @cached_property
    def stats(self) -> DataFrame:
        return stage(st.session_statistics(
            self.messages, self.blocks, inactivity=INACTIVITY, model_timeout=MODEL_TIMEOUT,
            pairs=self.paired, tools=self.tools), "stats")

    @cached_property
    def sessions(self) -> DataFrame:
        return stage(st.session_rows(st.session_metadata(self.messages), self.stats,
                                     event_lineage(self.messages)), "sessions")

    def rows(self, start: str | None = None, end: str | None = None,
             ecosystem: str | None = None) -> DataFrame:
        return ses.analytics_rows(self.sessions, self.stats, start, end, ecosystem)

    @cached_property
    def tracked(self) -> DataFrame:
        """One tracked file per user, its status following the user id."""
        e = read_table(self.spark, self.folder, "events")
        files = e.groupBy("user_id").agg(
            F.sum(F.length("props")).alias("file_size"), F.max("event_id").alias("last"))
        status = F.when(F.col("user_id") % 10 < 7, F.lit("parsed")).when(
            F.col("user_id") % 10 == 7, F.lit("error")).otherwise(F.lit("pending"))
        return files.select(
            F.concat(F.lit("/logs/u"), F.col("user_id").cast("string"), F.lit("/events.jsonl"))
            .alias("file_path"), "file_size", F.col("last").alias("file_mtime"),
            F.lpad(F.col("last").cast("string"), 12, "0").alias("last_parsed_at"),
            status.alias("parse_status"))


_open: dict[tuple, EventStore] = {}


def file_state(spark: SparkSession, folder: str, table: str) -> tuple:
    """Changes when the files of a table change; a listing, no content is read."""
    files = spark.read.format("binaryFile").load(f"{folder}/{table}.parquet")
    row = files.agg(F.count("*"), F.sum("length"), F.max("modificationTime")).first()
    return tuple(row)


def event_store(spark: SparkSession, folder: str) -> EventStore:
    """The store of a folder, kept as long as its session and its input files stay the same."""
    key = (spark.sparkContext.applicationId, folder, file_state(spark, folder, "events"))
    if key not in _open:
        _open[key] = EventStore(spark, folder)
    return _open[key]
