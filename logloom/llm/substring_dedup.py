"""Substring dedup: remove every word covered by a window of words that occurs elsewhere.

All copies of a window must meet in one index, and no document may be held against every
index. So windows are dealt by content: the anchor of a window is the smallest hash among its
`gram`-word runs, equal windows have equal anchors, and neighbouring windows mostly share one.
A run of windows with one anchor is a segment (at most `SEGMENT_WINDOWS` windows).

1. Anchors of all segments are counted; an anchor seen once cannot belong to a repeat. A
   segment that may repeat a window of its own (some run of words recurs in it) counts twice.
2. The texts of the remaining segments are cut out, with copies combined inside each task.
3. Segments are grouped by anchor into shards of about `shard_words` words. Each shard builds a
   compressed FM-index (`fm_index`) and streams its segments against it by backward search;
   the matching statistics give the runs of windows that occur at least twice. A segment that
   was seen several times is entered twice. An anchor with more than `chunk` segments is cut
   into chunks and every pair of chunks is a shard of its own: a window repeats if it does so
   in any pair, so results are simply united and no shard is larger than two chunks.
4. Runs return to the places of their segments and are merged per document.

Hashes only decide where a window goes. Whether it repeats is decided on the words themselves.

Defined results: a null text has no words; texts shorter than a window stay whole; repeated
rows and rows with null or repeated ids are documents of their own (told apart by the md5 of id
and text), so all their windows repeat; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.fm_index import FMIndex, repeated_windows
from logloom.llm.word_hashes import Words, byte_ends, mix
from logloom.plans.staging import stage

#: With 30 windows of 35 words a segment has 64 words, the depth the index is sorted to.
SEGMENT_WINDOWS = 30
#: Text bytes that one pass over a batch works on.
PASS_BYTES = 4_000_000

ANCHOR_DDL = "anchor long, high long, low long, start int"
PART = pa.schema([("anchor", pa.int64()), ("segment", pa.int64()), ("high", pa.int64()), ("low", pa.int64()),
                  ("start", pa.int32()), ("words", pa.binary()), ("n", pa.int64())])
PART_DDL = ("anchor long, segment long, high long, low long, start int, words binary, n long")
RUN = pa.schema([("anchor", pa.int64()), ("segment", pa.int64()), ("first", pa.int32()), ("end", pa.int32())])
SPAN_DDL = ("doc_id long, n_words long, n_removed long, kept_sha256 string,"
            " spans array<struct<first:int,end:int>>, kept string")


def segments(words: Words, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, first window, number of windows, anchor, looping) of each segment of some texts.

    A looping segment may hold one window twice.
    """
    n = len(words.hashes)
    nothing = (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64), np.empty(0, bool))
    if n < window:
        return nothing
    least = words.grams(gram)
    loops = np.zeros(len(least), bool)
    for step in range(1, SEGMENT_WINDOWS):
        loops[:-step] |= least[:-step] == least[step:]
    width, reach = window - gram + 1, 1
    while reach < width:  # sliding minimum over `width` grams by doubling
        step = min(reach, width - reach)
        least = np.minimum(least[:-step], least[step:])
        reach += step
    at = np.flatnonzero(words.left[:n - window + 1] >= window)
    if not len(at):
        return nothing
    value, doc = least[at], words.doc[at]
    new = np.ones(len(at), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    run = np.flatnonzero(new)
    nth = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
    first = np.flatnonzero(nth % SEGMENT_WINDOWS == 0)
    size = np.diff(np.append(first, len(at)))
    return doc[first], words.within[at[first]], size, mix(value[first]), np.logical_or.reduceat(loops[at], first)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of batches of about PASS_BYTES of text (last column), at least one row each."""
    for batch in batches:
        ends = byte_ends(batch.column(batch.num_columns - 1))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, base + PASS_BYTES, "right")))
            yield batch.slice(at, end - at)
            at = end


def _anchor_rows(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            doc, start, _, anchor, loops = segments(Words(part.column(2)), window, gram)
            twice = np.repeat(np.arange(len(doc)), 1 + loops)
            doc, start, anchor = doc[twice], start[twice], anchor[twice]
            rows = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor.view(np.int64)), part.column(0).take(rows), part.column(1).take(rows),
                 pa.array(start.astype(np.int32))], ["anchor", "high", "low", "start"])

    return run


def _cut(window: int, gram: int):
    """Rows (high, low, starts, text) to the places of the wanted segments and, combined, their words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, bytes], int] = {}
        size = 0
        for part in _parts(batches):
            doc, start, n_windows, anchor, _ = segments(Words(part.column(3)), window, gram)
            wanted = part.column(2)
            wanted_doc = np.repeat(np.arange(part.num_rows), np.diff(wanted.offsets.to_numpy()))
            keys = wanted_doc << 32 | wanted.flatten().to_numpy()
            chosen = np.flatnonzero(np.isin(doc << 32 | start, keys))
            texts, high, low = part.column(3), part.column(0).to_pylist(), part.column(1).to_pylist()
            rows: list[tuple] = []
            last, joined, ends = -1, b"", np.empty(0, np.int64)
            for d, a, k, h in zip(doc[chosen].tolist(), start[chosen].tolist(), n_windows[chosen].tolist(),
                                  anchor.view(np.int64)[chosen].tolist()):
                if d != last:
                    split = texts[d].as_py().split()
                    joined = b" ".join(split)
                    ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)) + 1)
                    last = d
                own = joined[ends[a - 1] if a else 0:ends[a + k + window - 2] - 1]
                rows.append((h, xxhash.xxh64_intdigest(own) - (1 << 63), high[d], low[d], a, None, None))
                if (h, own) not in seen:
                    size += len(own)
                seen[h, own] = seen.get((h, own), 0) + 1
            yield _batch(rows, PART)
            if size > 8 * PASS_BYTES:
                yield _segment_rows(seen)
                seen, size = {}, 0
        yield _segment_rows(seen)

    return run


def _segment_rows(seen: dict[tuple[int, bytes], int]) -> pa.RecordBatch:
    return _batch([(h, None, None, None, None, own, n) for (h, own), n in seen.items()], PART)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _search(window: int, shard_words: int):
    """Rows (anchor, i, j, words, n) sorted by item to the repeated runs of their segments."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: dict[tuple[int, bytes], int] = {}
        held: dict[bytes, int] = {}
        words, item = 0, None

        def close() -> None:
            """A segment that is in several items of a shard is still the same few places."""
            for own, n in held.items():
                shard[item[0], own] = max(shard.get((item[0], own), 0), n)
            held.clear()

        for batch in batches:
            for h, i, j, own, n in zip(*(c.to_pylist() for c in batch.columns)):
                if item is not None and (h, i, j) != item:
                    close()
                    if words >= shard_words:
                        yield _shard_runs(shard, window)
                        shard.clear()
                        words = 0
                item = (h, i, j)
                if own not in held:
                    words += 2 * window
                held[own] = held.get(own, 0) + n
        if item is not None:
            close()
            yield _shard_runs(shard, window)

    return run


def _shard_runs(shard: dict[tuple[int, bytes], int], window: int) -> pa.RecordBatch:
    ids: dict[bytes, int] = {}
    symbols: list[int] = []
    keys, starts, lengths = list(shard), [], []
    for key in keys:
        own = [ids.setdefault(w, len(ids) + 1) for w in key[1].split(b" ")]
        starts.append(len(symbols))
        lengths.append(len(own))
        for _ in range(min(shard[key], 2)):
            symbols += own
            symbols.append(0)
    text = np.array(symbols, np.int64)
    index = FMIndex(text, len(ids) + 1, SEGMENT_WINDOWS + window - 1)
    who, first, end = repeated_windows(index, text, np.array(starts), np.array(lengths), window)
    digests = [xxhash.xxh64_intdigest(keys[k][1]) - (1 << 63) for k in who.tolist()]
    return pa.RecordBatch.from_arrays(
        [pa.array([keys[k][0] for k in who.tolist()], pa.int64()), pa.array(digests, pa.int64()),
         pa.array(first.astype(np.int32)), pa.array(end.astype(np.int32))], schema=RUN)


def _remove(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            out = []
            for doc_id, runs, text in zip(*(c.to_pylist() for c in part.columns)):
                words = (text or b"").split()
                spans: list[list[int]] = []
                for run in sorted((r["first"], r["end"]) for r in runs or []):
                    first, end = run[0], min(run[1] + window - 1, len(words))
                    if spans and first <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], end)
                    else:
                        spans.append([first, end])
                kept, at = [], 0
                for first, end in spans:
                    kept += words[at:first]
                    at = end
                kept += words[at:]
                joined = b" ".join(kept)
                out.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(),
                            [{"first": a, "end": b} for a, b in spans],
                            joined.decode("utf-8", "replace") if with_text else None))
            yield pa.RecordBatch.from_pylist(
                [dict(zip(REMOVED.names, r)) for r in out], schema=REMOVED)

    return run


REMOVED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()),
                     ("n_removed", pa.int64()), ("kept_sha256", pa.string()),
                     ("spans", pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))),
                     ("kept", pa.string())])


def repeated_runs(docs: DataFrame, window: int, gram: int, chunk: int, shard_words: int) -> DataFrame:
    """docs (high, low, text) to high, low, runs of repeated windows."""
    found = docs.mapInArrow(_anchor_rows(window, gram), ANCHOR_DDL)
    often = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor")
    wanted = (found.join(often, "anchor", "left_semi").groupBy("high", "low")
              .agg(F.collect_set("start").alias("starts")))
    parts = stage(docs.join(wanted, ["high", "low"]).select("high", "low", "starts", "text")
                  .mapInArrow(_cut(window, gram), PART_DDL), "segments")

    texts = parts.filter("words is not null").select("anchor", "words", "n")
    counts = texts.groupBy("anchor").agg(F.count(F.lit(1)).alias("rows"))
    chunks = F.ceil(F.col("rows") / chunk).cast("long")
    items = (texts.join(counts, "anchor").withColumn("chunks", chunks)
             .withColumn("own", F.pmod(F.xxhash64("words"), F.col("chunks")))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
             .filter((F.col("chunks") == 1) | (F.col("own") != F.col("other")))
             .select("anchor", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "words", "n"))
    runs = (items.repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j")
            .mapInArrow(_search(window, shard_words), "anchor long, segment long, first int, end int").distinct())
    places = parts.filter("words is null").select("anchor", "segment", "high", "low", "start")
    return (places.join(runs, ["anchor", "segment"])
            .groupBy("high", "low")
            .agg(F.collect_set(F.struct((F.col("start") + F.col("first")).alias("first"),
                                        (F.col("start") + F.col("end")).alias("end"))).alias("runs")))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, gram: int = 10,
                   chunk: int = 8_192, shard_words: int = 1_000_000, with_text: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256, spans (of words) and kept."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    given = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":")).cast("binary")
    digest = F.md5(F.concat(given, F.coalesce("text", F.lit(b""))))
    rows = rows.select("doc_id", "text", *[F.conv(F.substring(digest, at, 16), 16, -10).cast("long").alias(name)
                                           for at, name in ((1, "high"), (17, "low"))])
    runs = repeated_runs(rows.select("high", "low", "text"), window, gram, chunk, shard_words)
    return (rows.join(runs, ["high", "low"], "left").select("doc_id", "runs", "text")
            .mapInArrow(_remove(window, with_text), SPAN_DDL))
