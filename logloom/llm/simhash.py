"""SimHash near-dedup with bit-sliced comparison.

A text becomes the 64-bit majority vote over the XXH64 hashes of its word shingles. Two
fingerprints link when they differ in at most `radius` bits, and linked ones form groups.

Finding links. Only distinct fingerprints are compared. The 64 bits are cut into `blocks`
blocks; within the radius at least `blocks - radius` blocks are equal, so every link shows up
in one of C(blocks, radius) tables keyed by that many equal blocks (ten tables of 25 or 26
bits by default). Keys held once are dropped before any comparison. A key with more than
`chunk` fingerprints is cut into chunks, and each pair of chunks is a work item of its own, so
no task holds more than two chunks and nothing is capped.

Bit-sliced comparison. In a task, bit p of all fingerprints of a key is one bit plane, 64
lanes to a machine word. A query is compared with 64 lanes at once: each plane is XORed with
the query's bit and added to carry-save counters of radius.bit_length() bits; a carry out of
the top marks the lane as too far. Words whose lanes are all too far are abandoned. Links are
merged in the task, and only a spanning forest leaves it: no pairs of a group are emitted.

Defined results: null and blank texts have fingerprint zero and are linked like others; texts
shorter than a shingle are one shingle; repeated rows share a group; the group id is the
smallest non-null id, null if all ids are null; an empty table gives an empty result. Further
columns are ignored by `near_duplicates` and returned by `keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.components import components
from logloom.plans.staging import stage

BITS = 64
#: Rows that a task looks at together, and (query, word) items per pass.
BUFFER_ROWS, PASS_ITEMS = 200_000, 65_536
LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shingle_hashes(text: bytes, size: int, seed: int) -> np.ndarray:
    """XXH64 of every shingle of a text whose A-Z are lower-cased, repeats included."""
    words = text.lower().split()
    if not words:
        return np.empty(0, "<u8")
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = list(accumulate(len(w) + 1 for w in words))
    if len(words) <= size:
        return np.array([digest(joined, seed)], "<u8")
    spans = zip([0, *ends], ends[size - 1:])
    return np.fromiter((digest(joined[a:b - 1], seed) for a, b in spans), "<u8", len(words) - size + 1)


def fingerprint_of(text: bytes | None, size: int = 3, seed: int = 42) -> int:
    hashes = shingle_hashes(text or b"", size, seed)
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at:at + 65_536].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * votes > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprint(text: Column, size: int = 3, seed: int = 42) -> Column:
    """The fingerprint of a text as a signed long."""
    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        found = (fingerprint_of(x.as_py(), size, seed) for x in texts)
        return pa.array(np.fromiter(found, np.uint64, len(texts)).view(np.int64))

    return run(text.cast("binary"))


def table_masks(blocks: int, radius: int) -> list[int]:
    """One bit mask for each choice of blocks that must be equal."""
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(parts, blocks - radius)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


class Lanes:
    """Groups of fingerprints as bit planes: each group starts at a new 64-lane word."""

    def __init__(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.values, self.sizes = values, sizes
        starts = np.cumsum(sizes) - sizes
        self.words = -(-sizes // 64)
        self.first_word = np.cumsum(self.words) - self.words
        group = np.repeat(np.arange(len(sizes)), sizes)
        self.within = np.arange(len(values)) - starts[group]
        self.group = group
        self.word_row = np.flatnonzero(self.within % 64 == 0)
        place = (self.within % 64).astype(np.uint64)
        self.planes = np.empty((BITS, len(self.word_row)), np.uint64)
        for p in range(BITS):
            bit = ((values >> np.uint64(p)) & np.uint64(1)) << place
            self.planes[p] = np.bitwise_or.reduceat(bit, self.word_row)

    def passes(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query row, word, lanes to look at): each query with the later lanes of its group."""
        todo = self.words[self.group] - self.within // 64
        bounds = np.cumsum(todo)
        at = 0
        while at < len(todo):
            base = bounds[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(bounds, base + PASS_ITEMS, "right")))
            query = np.repeat(np.arange(at, end), todo[at:end])
            nth = np.arange(len(query)) - np.repeat(bounds[at:end] - todo[at:end] - base, todo[at:end])
            in_group = self.within[query] // 64 + nth
            word = self.first_word[self.group[query]] + in_group
            left = self.sizes[self.group[query]] - in_group * 64
            full = np.uint64(0xFFFFFFFFFFFFFFFF)
            valid = np.where(left >= 64, full, (np.uint64(1) << np.minimum(left, 63).astype(np.uint64)) - np.uint64(1))
            own = (self.within[query] % 64).astype(np.uint64)
            after = np.where(nth == 0, ~((np.uint64(2) << own) - np.uint64(1)), full)
            valid &= after
            some = valid != 0
            yield query[some], word[some], valid[some]
            at = end

    def near(self, query, word, valid, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Row pairs within the radius."""
        n_bits = max(radius.bit_length(), 1)
        value = self.values[query]
        counters = [np.zeros(len(query), np.uint64) for _ in range(n_bits)]
        far = np.zeros(len(query), np.uint64)
        for p in range(BITS):
            add = self.planes[p][word] ^ (np.uint64(0) - ((value >> np.uint64(p)) & np.uint64(1)))
            for k in range(n_bits):
                carry = counters[k] & add
                counters[k] ^= add
                add = carry
            far |= add
            if p % 8 == 7:
                alive = (far & valid) != valid
                if 10 * np.count_nonzero(alive) < 7 * len(alive):
                    query, word, valid, value, far = (x[alive] for x in (query, word, valid, value, far))
                    counters = [c[alive] for c in counters]
        more, same = np.zeros_like(far), ~np.zeros_like(far)  # counter > radius, from the top bit
        for k in reversed(range(n_bits)):
            if radius >> k & 1:
                same &= counters[k]
            else:
                more |= same & counters[k]
                same &= ~counters[k]
        hit = valid & ~far & ~more
        some = np.flatnonzero(hit)
        lanes = np.unpackbits(hit[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        item, lane = np.nonzero(lanes)
        return query[some][item], self.word_row[word[some][item]] + lane


def merge(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (each the row number of its root) after joining rows i and j."""
    while len(i):
        a, b = labels[i], labels[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(labels, up := labels[labels]):
            labels = up
    return labels


def forest(values: np.ndarray, sizes: np.ndarray, radius: int) -> pa.RecordBatch:
    """Links (value, root) that span the groups' pairs within the radius."""
    lanes, labels = Lanes(values, sizes), np.arange(len(values))
    for item in lanes.passes():
        labels = merge(labels, *lanes.near(*item, radius))
    moved = np.flatnonzero(labels != np.arange(len(labels)))
    pairs = [values[moved].view(np.int64), values[labels[moved]].view(np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in pairs], schema=LINK)


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by work item; a buffer is cut at the last change of item."""
        held: list[np.ndarray] = []
        rows = 0
        for batch in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
            rows += batch.num_rows
            if rows >= BUFFER_ROWS:
                block = np.concatenate(held, axis=1)
                change = np.flatnonzero((block[:-1, 1:] != block[:-1, :-1]).any(axis=0)) + 1
                if len(change):
                    yield _items(block[:, :change[-1]], radius)
                    block = block[:, change[-1]:]
                held, rows = [block], block.shape[1]
        if rows:
            yield _items(np.concatenate(held, axis=1), radius)
    return run


def _items(block: np.ndarray, radius: int) -> pa.RecordBatch:
    change = np.flatnonzero((block[:-1, 1:] != block[:-1, :-1]).any(axis=0)) + 1
    sizes = np.diff(np.concatenate([[0], change, [block.shape[1]]]))
    return forest(np.ascontiguousarray(block[-1]).view(np.uint64), sizes, radius)


def fingerprint_links(distinct: DataFrame, radius: int = 3, blocks: int = 5, chunk: int = 16_384) -> DataFrame:
    """Distinct fingerprints (column fp) to links a, b that span all pairs within the radius."""
    keys = F.array(*[F.struct(F.lit(t).cast("long").alias("t"),
                              F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
                     for t, m in enumerate(table_masks(blocks, radius))])
    dealt = distinct.select("fp", F.explode(keys).alias("k")).select("k.t", "k.key", "fp")
    counts = (dealt.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
              .select("t", "key", F.ceil(F.col("n") / chunk).cast("long").alias("chunks")))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks"))
    items = (dealt.join(counts, ["t", "key"]).withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
             .filter((F.col("chunks") == 1) | (F.col("own") != F.col("other")))
             .select("t", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp"))
    return (items.repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j")
            .mapInArrow(_compare(radius), "a long, b long"))


def _groups(prints: DataFrame, radius: int, blocks: int, chunk: int) -> DataFrame:
    """Staged prints (doc_id, fp) to fp, component_id and lead, the fingerprint of the row that stays."""
    per_print = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(fingerprint_links(prints.select("fp").distinct(), radius, blocks, chunk))
    labelled = per_print.join(found, per_print["fp"] == found["node"], "left").select(
        "fp", "least", F.coalesce("label", "fp").alias("label"))
    place = F.struct(F.col("least").isNull().alias("none"), "least", "fp")
    heads = labelled.groupBy("label").agg(F.min(place).alias("head"))
    return labelled.join(heads, "label").select("fp", F.col("head.least").alias("component_id"),
                                                F.col("head.fp").alias("lead"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, seed: int = 42,
                    radius: int = 3, blocks: int = 5, chunk: int = 16_384) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id."""
    prints = stage(docs.select(F.col(id_col).cast("long").alias("doc_id"),
                               fingerprint(F.col(text_col), size, seed).alias("fp")), "fingerprints")
    groups = _groups(prints, radius, blocks, chunk).drop("lead")
    return prints.join(groups, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                                            "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, seed: int = 42,
             radius: int = 3, blocks: int = 5, chunk: int = 16_384) -> DataFrame:
    """The rows of docs that stay, one of each group: the smallest id, nulls last."""
    whole = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"),
                        fingerprint(F.col(text_col), size, seed).alias("fp"))
    prints = stage(whole.select("doc_id", "fp"), "fingerprints")
    groups = _groups(prints, radius, blocks, chunk)
    heads = groups.filter("fp = lead").select("fp", F.col("component_id").alias("head"))
    found = whole.join(heads, "fp").filter(F.col("doc_id").eqNullSafe(F.col("head")))
    order = Window.partitionBy("fp", "doc_id").orderBy(F.monotonically_increasing_id())
    return found.withColumn("nth", F.row_number().over(order)).filter("nth = 1").select("row.*")
