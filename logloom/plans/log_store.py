"""Log files rendered from ordinary tables, and the tables an ingest run makes of them.

`events` become files of format A, `conversations` files of format B. Both cover their whole
table; rows are dealt over sessions, one file each, whose number grows with the rows, so that no
file gets long and writing and reading have as many tasks as the data asks for. The lines carry
the odd forms that readers have to accept: missing and numeric-looking fields, unknown roles and
kinds, repeated prompts, blank and broken lines.

The files are written as text under the shared folder; the session is the folder of a file.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.functions.dates import iso_text, ntz_micros
from logloom.plans.bindings import read_table
from logloom.plans.event_store import file_state
from logloom.plans.ingest import IngestResult, delete_session, ingest
from logloom.plans.staging import shared_folder, stage
from logloom.sources.format_a import Normalized, normalize_a
from logloom.sources.format_b import convert_b, finish_b, normalize_b
from logloom.sources.registry import LogFormat, as_they_are, log_format, register_format
from logloom.sources.scan import list_files, scan_logs
from logloom.sources.store import TableStore

#: Least number of sessions of each format, and rows of a table for which there is one more.
SESSIONS_A, SESSIONS_B, ROWS_A_SESSION = 40, 50, 2_500
#: The session of format A whose file gets a broken line.
BROKEN = SESSIONS_A - 1
#: In the grown store: the session of format A whose file is written anew, and the one that is deleted.
REWRITTEN, DELETED = "a2", "a1"
FIRST_TURN_US = 1_767_225_600_000_000  # 2026-01-01T00:00:00Z


def session_of(path: Column) -> Column:
    return F.regexp_extract(path, "/session=([^/]+)/", 1)


def _folder_session(done: Normalized) -> Normalized:
    """Normalised lines whose session is named by the folder, not by the file."""
    own = session_of(F.col("source_path"))
    return Normalized(done.messages.withColumn("session_id", own), done.compacts.withColumn("session_id", own),
                      done.errors, done.lineage, done.diagnostics)


def _rendered_a(lines: DataFrame) -> Normalized:
    return _folder_session(normalize_a(lines, "rendered_a"))


RENDERED_A = register_format(LogFormat(
    "rendered_a", "*.txt", lambda path: path.contains("/session="), _rendered_a,
    convert=_rendered_a, finish=as_they_are))
RENDERED_B = register_format(LogFormat(
    "rendered_b", "*.txt", lambda path: path.contains("/session="),
    lambda lines: normalize_b(lines, "rendered_b"), reports_file_size=False,
    convert=lambda lines: convert_b(lines, "rendered_b"), finish=finish_b))


def session_count(rows: DataFrame, least: int) -> int:
    return max(least, rows.count() // ROWS_A_SESSION)


def _json(**fields: Column) -> Column:
    """A JSON object; null fields are left out."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


def lines_a(events: DataFrame) -> DataFrame:
    """(session, place, value) of format A; `place` orders the lines of a file."""
    n, kind, sessions = F.col("event_id"), F.col("event_type"), session_count(events, SESSIONS_A)
    reply = kind.isin("view", "click")
    e = events.select("event_id", "event_type", "props", ntz_micros(F.col("ts")).alias("ts_us"),
                      F.round("value").cast("bigint").alias("amount"),
                      F.concat(F.lit("a"), ((F.floor(n / 8) * 31 + F.col("user_id")) % sessions).cast("string"))
                      .alias("session"))
    call = _json(type=F.lit("tool_use"), id=(n % 5).cast("string"),
                 name=F.concat(F.lit("tool_"), (n % 7).cast("string")), input=F.struct(F.col("props").alias("q")))
    flag = (F.when(n % 6 == 0, F.lit('"yes"')).when(n % 6 == 1, F.lit("1")).when(n % 6 == 2, F.lit("false"))
            .when(n % 6 == 3, F.lit('"maybe"')).when(n % 6 == 4, F.lit("null")))
    result = F.concat(F.lit('{"type":"tool_result","tool_use_id":"'), (n % 5).cast("string"), F.lit('","content":'),
                      F.to_json(F.array("props")).substr(F.lit(2), F.length(F.to_json(F.array("props"))) - 2),
                      F.coalesce(F.concat(F.lit(',"is_error":'), flag), F.lit("")), F.lit("}"))
    said = F.to_json(F.array("props")).substr(F.lit(2), F.length(F.to_json(F.array("props"))) - 2)
    content = (F.when(kind == "click", F.concat(F.lit("["), call, F.lit("]")))
               .when(kind.isin("purchase", "error"), F.concat(F.lit("["), result, F.lit("]")))
               .otherwise(said))
    tokens = (F.when(n % 4 == 0, F.concat(F.lit('" '), F.col("amount").cast("string"), F.lit(' "')))
              .when(n % 4 == 1, F.lit("true")).when(n % 4 == 2, F.lit("2.5"))
              .otherwise(F.col("amount").cast("string")))
    role = (F.when(n % 9 == 0, F.lit('" USER "')).when(n % 9 == 1, F.lit('"critic"')).when(n % 9 == 2, F.lit("7"))
            .when(reply, F.lit('"assistant"')).otherwise(F.lit('"user"')))
    message = F.concat(F.lit('{"role":'), role, F.when(reply, F.concat(
        F.lit(',"usage":{"input_tokens":'), tokens, F.lit(',"output_tokens":3}'))).otherwise(F.lit("")),
        F.lit(',"content":'), content, F.lit("}"))
    line_type = F.when(n % 17 == 0, F.lit("progress")).when(reply, F.lit("assistant")).otherwise(F.lit("user"))
    head = _json(type=line_type, sessionId=F.col("session"), uuid=F.when(n % 29 != 0, F.concat(F.lit("u"), n)),
                 timestamp=F.when(n % 23 != 0, iso_text(F.col("ts_us"))))
    line = F.concat(F.regexp_replace(head, r"\}\z", ""), F.lit(',"message":'), message, F.lit("}"))
    compaction = F.when(n % 31 == 0, F.concat(
        F.lit('{"type":"system","subtype":"compact_boundary","timestamp":"'), iso_text(F.col("ts_us")),
        F.lit('","compactMetadata":{"trigger":"auto","preTokens":'), n.cast("string"), F.lit("}}")))
    lines = F.array_compact(F.array(F.when(n % 37 == 0, F.lit("")), line, compaction))
    rows = e.select("session", "event_id", F.posexplode(lines).alias("nth", "value"))
    out = rows.select("session", (F.col("event_id") * 4 + F.col("nth")).alias("place"), "value")
    broken = out.filter(F.col("session") == f"a{BROKEN}").agg(
        F.max("session").alias("session"), (F.max("place") + 1).alias("place"), F.lit('{"broken": ').alias("value"))
    return out.unionByName(broken.filter("session is not null"))


def lines_b(conversations: DataFrame) -> DataFrame:
    """(session, place, value) of format B."""
    group = F.col("conv_id") % session_count(conversations, SESSIONS_B)
    place = F.col("conv_id") * 64 + F.col("turn")
    t = conversations.select(
        F.concat(F.lit("b"), group.cast("string")).alias("session"), place.alias("place"), "turn", "role",
        F.concat(F.lit("Q "), F.coalesce("text", F.lit(""))).alias("text"))
    at = F.col("place") * 10_000_000 + FIRST_TURN_US

    def envelope(kind: str, payload: Column, after_us: int = 0) -> Column:
        return F.concat(F.lit('{"timestamp":"'), iso_text(at + after_us), F.lit(f'","type":"{kind}","payload":'),
                        payload, F.lit("}"))

    user, turn = F.col("role") == "user", F.col("turn")
    call_id = F.concat(F.lit("k"), F.col("place").cast("string"))
    prompt = envelope("event_msg", _json(type=F.lit("user_message"), message=F.col("text")))
    said = envelope("response_item", _json(
        type=F.lit("message"), role=F.col("role"),
        content=F.array(F.struct(F.lit("output_text").alias("type"), F.col("text").alias("text")))), 400_000)
    call = envelope("response_item", _json(type=F.lit("function_call"), name=F.lit("run"), call_id=call_id,
                                           arguments=F.lit('{"command":"ls"}')), 500_000)
    outputs = [F.to_json(F.struct((turn % 3).alias("exit_code"))), F.lit("Process exited with code 2"),
               F.lit('{"steps":[{"status":"failed"}]}'), F.lit("all done, 0 errors"), F.lit('{"ok":true,"n":[1]}')]
    output = F.element_at(F.array(*outputs), (F.col("place") % 5 + 1).cast("int"))
    result = envelope("response_item", _json(type=F.lit("function_call_output"), call_id=call_id, output=output),
                      600_000)
    tokens = envelope("event_msg", _json(type=F.lit("token_count"), info=F.struct(F.struct(
        (turn * 10).alias("input_tokens"), turn.alias("output_tokens"),
        F.lit(1).alias("cached_input_tokens")).alias("last_token_usage"))), 700_000)
    context = envelope("turn_context", F.lit("{}"), 800_000)
    unknown = envelope("telemetry", F.lit("{}"), 900_000)
    lines = F.array_compact(F.array(
        F.when(user, prompt), F.when(~user | (turn % 4 == 0), said), F.when(~user, call), F.when(~user, result),
        F.when(turn % 3 == 1, tokens), F.when(turn == 0, context), F.when(turn == 5, unknown)))
    body = t.select("session", (F.col("place") * 8).alias("place"), F.posexplode(lines).alias("nth", "value")).select(
        "session", (F.col("place") + F.col("nth")).alias("place"), "value")
    number = F.substring("session", 2, 9).cast("bigint")
    root = F.concat(F.lit("b"), (number - number % 5).cast("string"))
    linked = number % 5 > 0
    nested = F.when(linked & (number % 2 == 1), F.struct(F.struct(F.struct(
        root.alias("parentThreadId")).alias("thread_spawn")).alias("subagent")))
    head = t.select("session").distinct().select("session", F.lit(-1).cast("bigint").alias("place"), F.concat(
        F.lit('{"timestamp":"2025-12-31T00:00:00Z","type":"session_meta","payload":'),
        _json(id=F.col("session"), cwd=F.lit("/srv/b"), cli_version=F.lit("1.0"), source=nested,
              root_session_id=F.when(linked & (number % 2 == 0), root)), F.lit("}")).alias("value"))
    return head.unionByName(body)


def write_files(lines: DataFrame, folder: str) -> None:
    """One text file per session, in a folder named after it."""
    (lines.repartition("session").sortWithinPartitions("session", "place").select("session", "value")
     .write.mode("append").partitionBy("session").text(folder))


def early(lines: DataFrame, per: int) -> Column:
    """Whether a line is of the first two thirds of the places; `per` lines share one."""
    last = lines.agg(F.max(F.floor(F.col("place") / per))).first()[0] or 0
    return F.floor(F.col("place") / per) <= last * 2 // 3


def grow_files(lines: DataFrame, folder: str, fmt: LogFormat) -> None:
    """Add lines to the ends of the sessions' files, which lie in a folder that all tasks can open.

    A task that runs again cuts the file back to its size of before. The file of REWRITTEN is
    emptied first; sessions without a file get one.
    """
    files = stage(list_files(lines.sparkSession, folder, fmt).select(
        session_of(F.col("file_path")).alias("session"), "file_path",
        F.when(session_of(F.col("file_path")) == REWRITTEN, 0).otherwise(F.col("file_size")).alias("size")), "files")
    write_files(lines.join(files, "session", "left_anti"), folder)

    def run(batches):
        import os

        path, out = None, None
        for batch in batches:
            for own, size, value in zip(*(c.to_pylist() for c in batch.columns)):
                if own != path:
                    if out:
                        out.close()
                    path, out = own, open(own, "r+b")  # noqa: SIM115
                    checksum = os.path.join(os.path.dirname(own), f".{os.path.basename(own)}.crc")
                    if os.path.exists(checksum):  # of the file as it was written
                        os.remove(checksum)
                    out.truncate(size)
                    out.seek(size)
                out.write(value.encode() + b"\n")
            yield batch.slice(0, 0).select(["file_path"])
        if out:
            out.close()

    (lines.join(files, "session").repartition("session").sortWithinPartitions("session", "place")
     .select("file_path", "size", "value").mapInArrow(run, "file_path string").count())


@dataclass
class LogStore:
    """Files of both formats over a folder of tables, ingested once and then once more unchanged."""

    spark: SparkSession
    folder: str

    @cached_property
    def root(self) -> str:
        root = f"{shared_folder(self.spark)}/logs-{uuid.uuid4().hex}"
        write_files(lines_a(read_table(self.spark, self.folder, "events")), f"{root}/a")
        write_files(lines_b(read_table(self.spark, self.folder, "conversations")), f"{root}/b")
        return root

    def _run(self) -> IngestResult:
        roots = {"rendered_a": f"{self.root}/a", "rendered_b": f"{self.root}/b"}
        return ingest(self.spark, roots, self._store, parsed_at="run")

    @cached_property
    def _store(self) -> TableStore:
        return TableStore(self.spark, f"{self.root}/store")

    @cached_property
    def runs(self) -> list[IngestResult]:
        return [self._run(), self._run()]

    def table(self, name: str) -> DataFrame:
        self.runs  # noqa: B018 - the tables are made on first use
        return self._store.read(name)

    @cached_property
    def done_a(self) -> Normalized:
        done = RENDERED_A.normalize(scan_logs(self.spark, f"{self.root}/a", log_format("rendered_a")))
        done.messages = stage(done.messages, "messages")
        return done

    @cached_property
    def done_b(self) -> Normalized:
        done = RENDERED_B.normalize(scan_logs(self.spark, f"{self.root}/b", log_format("rendered_b")))
        done.messages = stage(done.messages, "messages")
        return done


class GrownStore(LogStore):
    """Files ingested when they hold two thirds of their lines, grown, ingested again; then a session is deleted.

    The file of one session is written anew in between, with its later lines only.
    """

    @cached_property
    def _lines(self) -> list[tuple[str, LogFormat, DataFrame, int]]:
        a = stage(lines_a(read_table(self.spark, self.folder, "events")), "lines-a")
        b = stage(lines_b(read_table(self.spark, self.folder, "conversations")), "lines-b")
        return [("a", RENDERED_A, a, 4), ("b", RENDERED_B, b, 8)]

    @cached_property
    def root(self) -> str:
        root = f"{shared_folder(self.spark)}/logs-{uuid.uuid4().hex}"
        for name, _, lines, per in self._lines:
            write_files(lines.filter(early(lines, per)), f"{root}/{name}")
        return root

    @cached_property
    def runs(self) -> list[IngestResult]:
        first = self._run()
        for name, fmt, lines, per in self._lines:
            grow_files(lines.filter(~early(lines, per)), f"{self.root}/{name}", fmt)
        found = [first, self._run()]
        delete_session(self._store, DELETED)
        return found


_open: dict[tuple, LogStore] = {}


def _opened(kind: type[LogStore], spark: SparkSession, folder: str) -> LogStore:
    key = (kind, spark.sparkContext.applicationId, folder,
           *(file_state(spark, folder, name) for name in ("events", "conversations")))
    if key not in _open:
        _open[key] = kind(spark, folder)
    return _open[key]


def log_store(spark: SparkSession, folder: str) -> LogStore:
    """The store of a folder, kept as long as its session and its input files stay the same."""
    return _opened(LogStore, spark, folder)


def grown_store(spark: SparkSession, folder: str) -> GrownStore:
    return _opened(GrownStore, spark, folder)
