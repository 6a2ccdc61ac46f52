"""Token ids as binary files of fixed-width bit-packed integers.

Each id takes the minimum bits that the vocabulary needs. A folder has `kind=ids` with the files and
`kind=index` with lines `range,ids`. A file is a row of segments (numbers are little-endian):

| bytes | content |
|---|---|
| 4 | `TKB1` |
| 12 | range (u32), start: number of ids before the segment in its range (u64) |
| 24 | bits an id (u8), 3 zero bytes, documents (u32), ids (u64), ids a block (u32), blocks (u32) |
| ceil(documents / 8) | one bit per document: its doc_id is null |
| 8 a document | doc_id (i64) |
| 4 a document | ids of the document, end id included (u32) |
| 8 a block, and 8 | byte offsets of the blocks in the payload, and its end (u64) |
| payload | the ids: block by block, each starting at a byte, the lowest bit first |

and one line end after it. Documents are in ascending doc_id order, nulls last: ranges are in order,
as are the names of their files, and the sums of the index give each range its start. Block
offsets and the fixed width find any id without reading others; unpacking gathers five bytes an id
with numpy.

Writing. A range shuffle over (doc_id, row) sorts the documents; a hot or null id is split by its
row, so ranges stay even. Each task encodes its range once, a few MB of text together, and makes segments of about
`segment_ids` ids (a document is never cut), counting from its own zero. Files are written by
Spark's writer, so they land in any store Spark can write, and lost tasks run again.

Defined results: a null text is empty and has the end id only; null and repeated ids are all
written, in the order of their staged rows; an empty table gives no segments and reads back as an
empty table; further columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.llm.packing import TokenIds
from logloom.llm.word_hashes import byte_ends
from logloom.plans.staging import shared_folder

MAGIC = b"TKB1"
_PLACE, _HEAD = struct.Struct("<IQ"), struct.Struct("<B3xIQII")
BLOCK = 4096
#: Text bytes that are encoded together.
PASS_BYTES = 4 << 20
#: Ranges whose totals are added up together.
_RUN = 4096
_ROWS = pa.schema([("kind", pa.string()), ("value", pa.binary())])
_DOCS = pa.schema([("doc_id", pa.int64()), ("part", pa.int64()), ("own_start", pa.int64()), ("n_tokens", pa.int64()),
                   ("ids_crc32", pa.int64()), ("ids", pa.binary())])


def bits_for(vocabulary: int) -> int:
    """Least bits that hold every id below `vocabulary`."""
    return max((vocabulary - 1).bit_length(), 1)


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    """Ids of `width` bits each, the lowest bit first."""
    if not len(ids):
        return b""
    octets = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)[:, :-(-width // 8)]
    bits = np.unpackbits(octets, axis=1, bitorder="little")[:, :width]
    return np.packbits(bits, bitorder="little").tobytes()


def unpack_bits(packed: np.ndarray, first: int, n: int, width: int) -> np.ndarray:
    """Ids first to first + n of a packed block (bytes), as 32-bit unsigned integers."""
    at = np.arange(first, first + n, dtype=np.int64) * width
    lead = int(at[0] >> 3) if n else 0
    end = (first + n) * width + 7 >> 3
    own = np.zeros(end - lead + 5, np.uint64)
    own[:end - lead] = packed[lead:end]
    byte = (at >> 3) - lead
    value = own[byte].copy()
    for k in range(1, (width + 14) // 8):
        value |= own[byte + k] << np.uint64(8 * k)
    return ((value >> (at & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.uint32)


def segment_bytes(part: int, start: int, doc_ids: list, lengths: list[int], ids: np.ndarray, width: int,
                  block: int = BLOCK) -> bytes:
    """A segment of range `part` that has `start` ids before it there."""
    blocks = [pack_bits(ids[k:k + block], width) for k in range(0, len(ids), block)]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8")
    nulls = np.packbits(np.array([d is None for d in doc_ids], bool), bitorder="little")
    known = np.array([0 if d is None else d for d in doc_ids], "<i8")
    return b"".join([MAGIC, _PLACE.pack(part, start), _HEAD.pack(width, len(doc_ids), len(ids), block, len(blocks)), nulls.tobytes(), known.tobytes(),
                     np.array(lengths, "<u4").tobytes(), offsets.tobytes(), *blocks])


class Segment:
    """A segment at a place of a file; ids are unpacked only where they are asked for."""

    def __init__(self, data: memoryview, at: int = 0) -> None:
        if bytes(data[at:at + 4]) != MAGIC:
            raise ValueError("no token segment at this place")
        self.part, self.start = _PLACE.unpack_from(data, at + 4)
        at += 4 + _PLACE.size
        self.width, self.n_docs, self.n_ids, self.block, n_blocks = _HEAD.unpack_from(data, at)
        at += _HEAD.size

        def column(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, kind, n, at)
            at += found.nbytes
            return found

        self.nulls = np.unpackbits(column("u1", -(-self.n_docs // 8)), count=self.n_docs, bitorder="little").astype(bool)
        self.doc_ids, self.lengths = column("<i8", self.n_docs), column("<u4", self.n_docs).astype(np.int64)
        self.offsets = column("<u8", n_blocks + 1).astype(np.int64)
        self.payload = column("u1", int(self.offsets[-1]))
        self.end = at
        self.firsts = np.cumsum(self.lengths) - self.lengths

    def ids(self, first: int, n: int) -> np.ndarray:
        """Ids first to first + n of the segment, from the blocks that hold them."""
        parts = []
        while n > 0:
            k, within = divmod(first, self.block)
            take = min(n, self.block - within)
            parts.append(unpack_bits(self.payload[self.offsets[k]:self.offsets[k + 1]], within, take, self.width))
            first, n = first + take, n - take
        return np.concatenate(parts) if parts else np.empty(0, np.uint32)

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document of the segment."""
        return self.ids(int(self.firsts[k]), int(self.lengths[k]))


def segments(data: bytes) -> Iterator[Segment]:
    """The segments of a file."""
    view, at = memoryview(data), 0
    while at < len(view):
        found = Segment(view, at)
        yield found
        at = found.end + 1


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of about PASS_BYTES of text, at least one row each."""
    ends, at = byte_ends(batch.column(1)), 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, base + PASS_BYTES, "right")))
        yield batch.slice(at, end - at)
        at = end


def _make(path: str, end_id: int, width: int, segment_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token_ids = TokenIds.of(path)
        part, before, held = TaskContext.get().partitionId(), 0, 0
        docs: list = []
        parts: list[np.ndarray] = []

        def row(kind: str, value: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([value], pa.binary())], schema=_ROWS)

        def segment() -> pa.RecordBatch:
            return row("ids", segment_bytes(part, before, docs, [len(p) for p in parts], np.concatenate(parts), width))

        for batch in batches:
            for rows in _parts(batch):
                ids, counts = token_ids.joined([text or "" for text in rows.column(1).to_pylist()])
                stops = np.cumsum(counts)
                ids, stops = np.insert(ids, stops, end_id), stops + np.arange(1, len(stops) + 1)
                for doc_id, start, stop in zip(rows.column(0).to_pylist(), [0, *stops.tolist()], stops.tolist()):
                    n = stop - start
                    if held and held + n > segment_ids:
                        yield segment()
                        before, held, docs, parts = before + held, 0, [], []
                    docs.append(doc_id)
                    parts.append(ids[start:stop])
                    held += n
        if held:
            yield segment()
            yield row("index", f"{part},{before + held}".encode())
        token_ids.rest()

    return run


def _read(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for found in segments(content.as_buffer()):
                    ids = found.ids(0, found.n_ids).astype("<u4", copy=False)
                    own = [ids[a:a + n].tobytes() for a, n in zip(found.firsts.tolist(), found.lengths.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(found.doc_ids, mask=found.nulls), pa.array(np.full(found.n_docs, found.part)),
                         pa.array(found.start + found.firsts),
                         pa.array(found.lengths), pa.array([zlib.crc32(x) for x in own], pa.int64()),
                         pa.array(own if with_ids else [None] * len(own), pa.binary())], schema=_DOCS)

    return run


def _starts(index: DataFrame) -> DataFrame:
    """Rows (part, ids) of the ranges to part, base: ids of all ranges before, added up in runs of ranges."""
    rows = index.withColumn("run", F.floor(F.col("part") / _RUN))
    before = lambda w: F.coalesce(F.sum("ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = rows.groupBy("run").agg(F.sum("ids").alias("ids"))
    runs = runs.select("run", before(Window.orderBy("run")).alias("run_base"))
    own = before(Window.partitionBy("run").orderBy("part"))
    return rows.withColumn("own", own).join(runs, "run").select("part", (F.col("own") + F.col("run_base")).alias("base"))


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                 end_id: int = 2, segment_ids: int = 1 << 20, range_bytes: int = 256 << 20,
                 least_bytes: int = 4 << 20, segments_a_file: int = 8) -> None:
    """Encode all documents and write their ids to `folder`, which must not exist yet.

    A range holds about range_bytes of text; smaller tables are dealt to all shuffle partitions, but
    to no ranges under least_bytes.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    width = bits_for(max(Tokenizer.from_file(tokenizer_path).get_vocab_size(with_added_tokens=True), end_id + 1))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    even = min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // least_bytes))
    order = [F.col("doc_id").isNull(), F.col("doc_id"), F.col("row")]
    ranges = (rows.withColumn("row", F.monotonically_increasing_id())
              .repartitionByRange(max(-(-total // range_bytes), even, 1), *order).sortWithinPartitions(*order))
    (ranges.select("doc_id", "text").mapInArrow(_make(tokenizer_path, end_id, width, segment_ids), "kind string, value binary")
     .select("kind", F.col("value").cast("string").alias("value"))
     .write.partitionBy("kind").option("lineSep", "\n").option("maxRecordsPerFile", segments_a_file).text(folder))


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32 (and ids, 32-bit)."""
    def files(kind: str):
        return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").format(kind)

    lines = files("text").load(folder).filter(F.col("_metadata.file_path").contains("/kind=index/"))
    pair = F.split("value", ",")
    # one row per range of about range_bytes of text: some MB for 100 TB
    starts = F.broadcast(_starts(lines.select(pair[0].cast("long").alias("part"), pair[1].cast("long").alias("ids"))))
    found = files("binaryFile").load(folder).filter(F.col("path").contains("/kind=ids/")).select("content").mapInArrow(
        _read(with_ids), "doc_id long, part long, own_start long, n_tokens long, ids_crc32 long, ids binary")
    found = found.join(starts, "part").select(
        "doc_id", (F.col("base") + F.col("own_start")).alias("start"), "n_tokens", "ids_crc32", "ids")
    return found if with_ids else found.drop("ids")


def fresh_folder(spark: SparkSession) -> str:
    """A new folder for token files under the shared one."""
    return f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
