"""Reading log files from a byte on: only what was added since the last run is read.

A run stores for each file how many bytes and lines it has consumed and a mark, the digest of the
last bytes before that place. `probe` reads two short stretches of each changed file: the bytes
under the old mark, which tell whether the file was only appended to, and its end, which tells
where its last complete line ends. Appended files are then cut into splits behind the consumed
bytes, and each split gives the lines that start inside it. Files are opened where the splits run,
through pyarrow's file systems; a file that cannot be opened that way has no mark and is read whole
by Spark's own reader.

`LogTail` offers the same as a data source: `spark.read.format("log_tail")` for the lines behind
given offsets, `spark.readStream.format("log_tail")` for a feed that follows growing files, whose
offsets are kept by the checkpoint of the stream.
"""

from __future__ import annotations

import hashlib
import json
import sys
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

# the readers run in workers, which may not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes under a mark, of a split, of one read, and of the end of a file that is searched for a line end.
MARK, SPLIT, READ, LAST = 1024, 32 << 20, 1 << 20, 4 << 20
_LINES = pa.schema([("source_path", pa.string()), ("split", pa.int64()), ("rank", pa.int64()), ("byte_start", pa.int64()),
                    ("terminated", pa.bool_()), ("file_size", pa.int64()), ("value", pa.binary())])
LINES_DDL = ("source_path string, split bigint, rank bigint, byte_start bigint, terminated boolean,"
             " file_size bigint, value binary")


def _file_system(path: str):
    from pyarrow import fs

    if "://" in path:
        scheme, rest = path.split("://", 1)
        return fs.FileSystem.from_uri(f"{scheme}://{quote(rest)}")
    return fs.LocalFileSystem(), path


def open_file(path: str):
    system, inner = _file_system(path)
    return system.open_input_file(inner)


def mark_of(file, upto: int) -> str:
    """Digest of the bytes before a place of a file."""
    start = max(upto - MARK, 0)
    return f"{upto}:{hashlib.md5(file.read_at(upto - start, start)).hexdigest()}"


def last_line_end(file, size: int) -> int | None:
    """The place behind the last line end among the last bytes; None where there is none."""
    step = MARK
    while True:
        start = max(size - step, 0)
        at = file.read_at(size - start, start).rfind(b"\n")
        if at >= 0:
            return start + at + 1
        if start == 0 or step >= LAST:
            return 0 if start == 0 else None
        step *= 16


def lines_in(file, start: int, end: int, base: int, size: int) -> Iterator[tuple[int, bytes, bool]]:
    """(first byte, line, whether a line end follows) of the lines that start in [start, end).

    A line starts at `base` and behind each line end; the file counts up to `size`.
    """
    at, rest = start, b""
    if start > base:  # the line that crosses the start belongs to the split before
        at = start - 1
        while at < size:
            block = file.read_at(min(READ, size - at), at)
            cut = block.find(b"\n")
            if cut >= 0:
                at += cut + 1
                break
            at += len(block)
    parts: list[bytes] = []
    first, place = at, at
    while place < size and first < end:
        block = file.read_at(min(READ, size - place), place)
        if not block:
            return
        place += len(block)
        pieces = block.split(b"\n")
        for piece in pieces[:-1]:
            line = b"".join([*parts, piece])
            parts = []
            if first >= end:
                return
            yield first, line, True
            first += len(line) + 1
        rest = pieces[-1]
        if rest:
            parts.append(rest)
    if parts and first < end and place >= size:
        yield first, b"".join(parts), False


def _batches(path: str, start: int, end: int, base: int, size: int) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    held = rank = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _LINES)], schema=_LINES)

    with open_file(path) as file:
        for at, line, terminated in lines_in(file, start, end, base, size):
            rows.append((path, start, rank, at, terminated, size, line))
            rank += 1
            held += len(line) + 64
            if held >= READ:
                yield batch()
                rows, held = [], 0
    if rows:
        yield batch()


def read_tails(files: DataFrame, split: int = SPLIT) -> DataFrame:
    """Lines behind `base` of files (file_path, base, file_size); see LINES_DDL for the columns."""
    starts = F.sequence(F.col("base"), F.col("file_size") - 1, F.lit(split).cast("bigint"))
    cut = files.filter("base < file_size").select("file_path", "base", "file_size", F.explode(starts).alias("start"))
    cut = cut.select("file_path", "start", F.least(F.col("start") + split, "file_size").alias("stop"), "base", "file_size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for path, start, stop, base, size in zip(*(c.to_pylist() for c in rows.columns)):
                yield from _batches(path, start, stop, base, size)

    return cut.repartition(F.col("file_path"), F.col("start")).mapInArrow(run, LINES_DDL)


def probe(files: DataFrame) -> DataFrame:
    """files (file_path, file_size, mark) to file_path, grown, line_end, new_mark.

    grown: the bytes under the old mark are as they were. line_end: behind the last complete
    line, null where none is found near the end or the file cannot be opened this way.
    """
    out = pa.schema([("file_path", pa.string()), ("grown", pa.bool_()), ("line_end", pa.int64()), ("new_mark", pa.string())])

    def look(path: str, size: int, mark: str | None) -> tuple:
        try:
            with open_file(path) as file:
                place = int(mark.split(":")[0]) if mark else None
                grown = place is not None and place <= size and mark_of(file, place) == mark
                end = last_line_end(file, size)
                return path, grown, end, None if end is None else mark_of(file, end)
        except (OSError, ValueError, ImportError):  # no such file system here, or the file is gone
            return path, False, None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = [look(*r) for r in zip(*(c.to_pylist() for c in rows.columns))]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), out)], schema=out)

    return (files.select("file_path", F.col("file_size").cast("bigint"), F.col("mark").cast("string"))
            .mapInArrow(run, "file_path string, grown boolean, line_end bigint, new_mark string"))


class _Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int, base: int, size: int) -> None:
        self.path, self.start, self.stop, self.base, self.size = path, start, stop, base, size


def _ranges(old: dict[str, int], new: dict[str, int], split: int) -> list[_Range]:
    """Splits of what files hold beyond their old sizes."""
    out = []
    for path, size in sorted(new.items()):
        base = old.get(path, 0)
        out += [_Range(path, at, min(at + split, size), base, size) for at in range(base, size, split)]
    return out


class _Files:
    """The files of a folder and where their complete lines end."""

    def __init__(self, options: dict) -> None:
        self.root, self.suffix = options["path"], options.get("suffix", ".jsonl")
        self.split = int(options.get("splitbytes", options.get("splitBytes", SPLIT)))

    def ends(self, known: dict[str, int]) -> dict[str, int]:
        from pyarrow import fs

        system, inner = _file_system(self.root)
        prefix = self.root.split("://", 1)[0] + "://" if "://" in self.root else ""
        found = {}
        for info in system.get_file_info(fs.FileSelector(inner, recursive=True, allow_not_found=True)):
            if info.type == fs.FileType.File and info.path.endswith(self.suffix):
                path = prefix + info.path
                if info.size <= known.get(path, 0):
                    found[path] = known[path] if path in known else 0
                    continue
                with system.open_input_file(info.path) as file:
                    found[path] = max(last_line_end(file, info.size) or 0, known.get(path, 0))
        return found


class _TailReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.files, self.old = _Files(options), json.loads(options.get("offsets", "{}"))

    def partitions(self) -> list[_Range]:
        return _ranges(self.old, self.files.ends(self.old), self.files.split) or [_Range("", 0, 0, 0, 0)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        if part.stop > part.start:
            yield from _batches(part.path, part.start, part.stop, part.base, part.size)


class _TailStream(DataSourceStreamReader):
    """Offsets are the ends of the complete lines of all files."""

    def __init__(self, options: dict) -> None:
        self.files, self.last = _Files(options), {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        self.last = self.files.ends(self.last)
        return self.last

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        self.last = dict(end)
        return _ranges(start, end, self.files.split)

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        yield from _batches(part.path, part.start, part.stop, part.base, part.size)


class LogTail(DataSource):
    """Format `log_tail`. Options: path, suffix (.jsonl), splitBytes, and for a batch offsets (JSON of path to byte)."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return LINES_DDL

    def reader(self, schema) -> DataSourceReader:
        return _TailReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _TailStream(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LogTail)
