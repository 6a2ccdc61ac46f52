"""Near dedup of texts: wide SimHash candidates, linked by the exact Jaccard similarity of shingles.

A text's set of distinct `size`-word shingles (A-Z lower-cased) is voted into `prints` SimHashes of
64 bits, each over hashes of its own. Candidates are texts with a fingerprint that differs in
`radius` bits or fewer, which is wide: at a similarity of 0.8 two differ in about ten bits. Exact
block tables find them: within the radius `blocks - radius` of the blocks are equal, so every such
pair shares a key of one of C(blocks, radius) tables. More blocks make keys longer and tables more;
`block_count` takes the number that costs least for the rows at hand, any number finds the same.

Pairs of a key are compared bit-sliced as in `simhash`; a pair counts in the first table that holds
it. A key with up to `dense` pairs a text hands on all of them. In a denser key each text proposes
itself to its nearest earlier texts only (the first and the last of those at the least distance), and
the texts of its pairs are open. Pairs handed on are linked if the exact Jaccard similarity of
their sets is `share` or more, and links form groups. Open texts of unlike groups are then compared
again, all pairs of them, so no pair within the radius goes unchecked unless links join it already:
a group of n alike texts hands on 2 n proposals, and pairs of unlike groups are first thinned by
the bits of `parity`, which rule out only pairs that cannot reach the share. Open texts have block
tables of their own, fewer and with shorter keys as long as these cost less.

Joins are sort-merge joins: no table that grows with the texts passes through the driver.

Skew. Equal sets are one node. A key above `chunk` nodes is cut into chunks whose pairs are work
items of their own. Sets of proposals meet under the later node; a node that more than `salted`
others propose themselves to is copied to as many salts, so that none of them is left out.

What is found. Every link is exact, and groups are those of all pairs that reach the share and have a
fingerprint within the radius; a pair is missed only if all its fingerprints differ in more bits and
no chain of links joins it. The tests hold it against brute force.

Defined results: blank and null texts have no shingles and are alike; texts shorter than a
shingle are one shingle; of each group the row with the smallest id stays, nulls last, and of
repeated rows one; an empty table gives an empty result; further columns are returned as they
are, whatever their names. Sets are told apart by 128-bit digests of their 64-bit shingle hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.components import components, sorted_side
from logloom.llm.simhash import BITS, BUFFER_ROWS, Lanes, shingle_hashes, table_masks
from logloom.llm.word_hashes import IDENTITY, Words, byte_ends, mix
from logloom.plans.staging import stage

LOWER = IDENTITY.copy()
LOWER[65:91] += 32
#: Text bytes that one pass over a batch works on.
PASS_BYTES = 500_000
#: Least bits of a key of a block table.
KEY_BITS = 10
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)
_SKETCH = pa.schema([("doc_id", pa.int64()), ("sha", pa.string()), ("node", pa.binary()), ("fps", pa.list_(pa.int64())),
                     ("n", pa.int64())])
_SET = pa.schema([("node", pa.binary()), ("hashes", pa.binary()), ("parity", pa.list_(pa.int64()))])
#: Words of 64 parities that bound from below in how many shingles two sets differ.
PARITY_WORDS = 16
_PROPOSAL = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of about PASS_BYTES of text, at least one row each."""
    ends, at = byte_ends(batch.column(column)), 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, base + PASS_BYTES, "right")))
        yield batch.slice(at, end - at)
        at = end


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = Words(texts, fold=LOWER)
    grams, ends = words.grams(size), np.cumsum(words.n_words)
    for k, (end, n) in enumerate(zip(ends.tolist(), words.n_words.tolist())):
        if n >= size:
            yield np.unique(grams[end - n:end - size + 1])
        elif n:
            yield shingle_hashes(texts[k].as_py(), size, 0)
        else:
            yield np.empty(0, np.uint64)


def digest(own: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(own.tobytes())


def parity(own: np.ndarray) -> np.ndarray:
    """Whether the number of hashes with each lead is odd, as signed words: sets differ in as many hashes or more as in bits."""
    odd = np.bincount((own >> np.uint64(54)).astype(np.int64), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def vote(own: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    octets = own.view(np.uint8).reshape(-1, 8)
    counts = np.zeros(8 * 256, np.int64)
    for at in range(0, len(octets), 1 << 18):
        counts += np.bincount((octets[at:at + (1 << 18)] + np.arange(8) * 256).ravel(), minlength=8 * 256)
    bits = (2 * (counts.reshape(8, 256) @ _BYTE_BITS) > len(own)).astype(np.uint8)
    return int(np.packbits(bits, axis=1, bitorder="little").ravel().view("<u8")[0])


def votes(own: np.ndarray, prints: int) -> list[int]:
    """Signed fingerprints of a set, each over hashes mixed anew."""
    out = []
    for k in range(prints):
        out.append(vote(own))
        own = mix(own + np.uint64(k + 1))
    return np.array(out, np.uint64).view(np.int64).tolist()


def _sketches(size: int, prints: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in _parts(batch, 2)):
            sets = [(digest(s), votes(s, prints), len(s)) for s in shingle_sets(part.column(2), size)]
            own = [pa.array(c, f.type) for c, f in zip(zip(*sets), list(_SKETCH)[2:])]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *own], schema=_SKETCH)

    return run


def _set_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in _parts(batch, 0)):
            sets = list(shingle_sets(part.column(0), size))
            own = [[digest(s) for s in sets], [s.tobytes() for s in sets], [parity(s) for s in sets]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(own, _SET)], schema=_SET)

    return run


def block_count(rows: int, radius: int, key_bits: int = KEY_BITS) -> int:
    """Blocks whose tables cost least: rows dealt, and 64 comparisons at a 2000th of a dealt row.

    Keys have key_bits or more. With KEY_BITS the tables are the same up to about ten million texts and what
    is dealt grows in proportion to the texts; beyond, longer keys in more tables save comparisons.
    """
    def cost(blocks: int) -> float:
        return comb(blocks, radius) * (1 + rows / 2 ** (BITS * (blocks - radius) / blocks) / 2000)

    return min((b for b in range(radius + 1, radius + 8) if BITS * (b - radius) >= key_bits * b), key=cost)


class _Nearest:
    """The nearest earlier rows of each row: the first and the last of those at the least distance."""

    def __init__(self, values: np.ndarray) -> None:
        self.values, self.far = values, np.iinfo(np.int64).max
        self.first, self.last = np.full(len(values), self.far), np.full(len(values), self.far)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        distance = np.bitwise_count(self.values[i] ^ self.values[j]).astype(np.int64) << 40
        np.minimum.at(self.first, j, distance | i)
        np.minimum.at(self.last, j, distance | (len(self.values) - i))

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        hit = np.flatnonzero(self.first < self.far)
        mask = (1 << 40) - 1
        a, b = self.first[hit] & mask, len(self.values) - (self.last[hit] & mask)
        more = a != b
        return np.concatenate([a, b[more]]), np.concatenate([hit, hit[more]])


def _near(lanes: Lanes, radius: int, share: Fraction, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs within the radius, but those whose set sizes (counts) rule the share out."""
    for item in lanes.passes():
        i, j = lanes.near(*item, radius)
        small, large = np.minimum(counts[i], counts[j]), np.maximum(counts[i], counts[j])
        fits = small * share.denominator >= large * share.numerator
        yield i[fits], j[fits]


def nearest(values: np.ndarray, nodes: np.ndarray, sizes: np.ndarray, radius: int, share: Fraction,
            counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(earlier, later) nodes: each row of a group with its nearest earlier rows, first and last.

    Rows are in groups of `sizes`; pairs whose set sizes (counts) rule the share out are passed over.
    """
    found = _Nearest(values)
    for i, j in _near(Lanes(values, sizes), radius, share, counts):
        found.add(i, j)
    a, b = found.pairs()
    return nodes[a], nodes[b]


def _own(values: np.ndarray, tables: np.ndarray, masks: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the table of each pair is the first of its fingerprint's tables that hold the pair."""
    differ, table = values[i] ^ values[j], tables[j] % len(masks)
    own = np.ones(len(i), bool)
    for t, mask in enumerate(masks):
        own &= (t >= table) | (differ & mask != 0)
    return own


def candidates(values: np.ndarray, nodes: np.ndarray, sizes: np.ndarray, radius: int, share: Fraction, counts: np.ndarray,
               tables: np.ndarray, masks: np.ndarray, dense: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(earlier, later, open) nodes: the pairs of groups of rows, and the nodes of pairs that are not among them.

    A pair counts in the first table that holds it. Groups of up to `dense` pairs a row hand on all
    of them; denser ones the nearest only, and the nodes of all their pairs are open.
    """
    lanes, found = Lanes(values, sizes), _Nearest(values)
    many, touched = np.zeros(len(sizes), np.int64), np.zeros(len(values), bool)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for i, j in _near(lanes, radius, share, counts):
        found.add(i, j)
        own = _own(values, tables, masks, i, j)
        i, j = i[own], j[own]
        touched[i] = touched[j] = True
        many += np.bincount(lanes.group[j], minlength=len(sizes))
        few = (many <= dense * sizes)[lanes.group[j]]
        held.append((i[few], j[few]))
    full = (many > dense * sizes)[lanes.group]
    i, j = (np.concatenate([pair[k] for pair in held] or [np.empty(0, np.int64)]) for k in (0, 1))
    few = ~full[j]
    a, b = found.pairs()
    a, b = a[full[b]], b[full[b]]
    return nodes[np.concatenate([i[few], a])], nodes[np.concatenate([j[few], b])], nodes[np.flatnonzero(full & touched)]


def _by_item(work):
    """work over whole work items: rows (t, key, i, j, ...) come sorted by them; a buffer is cut at the last change of item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows = 0
        for batch in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
            rows += batch.num_rows
            if rows >= BUFFER_ROWS:
                block = np.concatenate(held, axis=1)
                change = np.flatnonzero((block[:4, 1:] != block[:4, :-1]).any(axis=0)) + 1
                if len(change):
                    yield from work(block[:, :change[-1]], _sizes(block[:, :change[-1]]))
                    block = block[:, change[-1]:]
                held, rows = [block], block.shape[1]
        if rows:
            block = np.concatenate(held, axis=1)
            yield from work(block, _sizes(block))

    return run


def _sizes(block: np.ndarray) -> np.ndarray:
    change = np.flatnonzero((block[:4, 1:] != block[:4, :-1]).any(axis=0)) + 1
    return np.diff(np.concatenate([[0], change, [block.shape[1]]]))


def _propose(radius: int, share: Fraction, masks: np.ndarray, dense: int):
    """Rows (t, key, i, j, fp, node, n) to pairs, and open nodes with b null."""
    def work(block: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b, left = candidates(np.ascontiguousarray(block[4]).view(np.uint64), block[5], sizes, radius, share, block[6],
                                block[0], masks, dense)
        b = pa.concat_arrays([pa.array(b), pa.nulls(len(left), pa.int64())])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, left])), b], schema=_PROPOSAL)

    return _by_item(work)


def _apart(radius: int, share: Fraction, masks: np.ndarray):
    """Rows (t, key, i, j, fp, node, n, label, parities) to all pairs of unlike labels, each in the first table that holds it.

    Left out are pairs whose parities differ in more bits than sets of that share may differ in hashes.
    """
    more, less = share.denominator + share.numerator, share.denominator - share.numerator

    def work(block: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
        values, nodes, labels = np.ascontiguousarray(block[4]).view(np.uint64), block[5], block[7]
        for i, j in _near(Lanes(values, sizes), radius, share, block[6]):
            unlike = labels[i] != labels[j]
            i, j = i[unlike], j[unlike]
            own = _own(values, block[0], masks, i, j)
            i, j = i[own], j[own]
            differ = np.zeros(len(i), np.int64)
            for word in block[8:]:
                differ += np.bitwise_count((word[i] ^ word[j]).view(np.uint64))
            fits = differ * more <= (block[6][i] + block[6][j]) * less
            if fits.any():
                yield pa.RecordBatch.from_arrays([pa.array(nodes[i[fits]]), pa.array(nodes[j[fits]])], schema=_PROPOSAL)

    return _by_item(work)


def _dealt(nodes: DataFrame, radius: int, blocks: int) -> DataFrame:
    """Nodes (id, fps, n, further columns) to rows t, key, fp, id, n, further columns: one for each fingerprint and table."""
    masks, more = [m - (1 << 64) if m >> 63 else m for m in table_masks(blocks, radius)], [c for c in nodes.columns if c not in ("id", "fps", "n")]
    tables = F.array(*[F.struct(F.lit(t).cast("long").alias("t"), F.lit(m).cast("long").alias("mask")) for t, m in enumerate(masks)])
    each = nodes.select("id", "n", *more, F.posexplode("fps").alias("p", "fp")).withColumn("k", F.explode(tables))
    return each.select((F.col("p") * len(masks) + F.col("k.t")).alias("t"), F.col("fp").bitwiseAND(F.col("k.mask")).alias("key"),
                       "fp", "id", "n", *more)


def _items(dealt: DataFrame, keys: DataFrame, chunk: int, *more: str) -> DataFrame:
    """Dealt rows of keys (t, key, rows) as work items (t, key, i, j): pairs of chunks of a key."""
    keys = keys.select("t", "key", F.ceil(F.col("rows") / chunk).cast("long").alias("chunks"))
    own = F.pmod(F.xxhash64("id"), F.col("chunks"))
    items = (dealt.join(sorted_side(keys), ["t", "key"]).withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
             .filter((F.col("chunks") == 1) | (F.col("own") != F.col("other")))
             .select("t", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", "id", "n", *more))
    order = ["t", "key", "i", "j"]
    return items.repartition(*order).sortWithinPartitions(*order, "id")


def proposals(nodes: DataFrame, radius: int, share: Fraction, blocks: int, chunk: int = 16_384, dense: int = 4) -> DataFrame:
    """Nodes (id, fps, n) to pairs a, b that may be alike; b is null for open nodes, which have further ones."""
    dealt = _dealt(nodes, radius, blocks)
    many = dealt.groupBy("t", "key").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    masks = np.array(table_masks(blocks, radius), np.uint64)
    return _items(dealt, many, chunk).mapInArrow(_propose(radius, share, masks, dense), "a long, b long").distinct()


def further(nodes: DataFrame, radius: int, share: Fraction, blocks: int, chunk: int = 16_384) -> DataFrame:
    """Nodes (id, fps, n, label, parity) to all pairs a, b of unlike labels that may be alike."""
    parities = [f"parity{k}" for k in range(PARITY_WORDS)]
    dealt = _dealt(nodes.select("id", "fps", "n", "label", *[F.col("parity")[k].alias(x) for k, x in enumerate(parities)]), radius, blocks)
    mixed = (dealt.groupBy("t", "key").agg(F.count(F.lit(1)).alias("rows"), F.min("label").alias("low"), F.max("label").alias("high"))
             .filter("low < high"))
    masks = np.array(table_masks(blocks, radius), np.uint64)
    return _items(dealt, mixed, chunk, "label", *parities).mapInArrow(_apart(radius, share, masks), "a long, b long").distinct()


def _alike(share: Fraction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(k).to_numpy() for k in (0, 1))
            hit = np.zeros(len(a), bool)
            for k in range(len(a)):
                one, two = (np.frombuffer(batch.column(c)[k].as_buffer(), "<u8") for c in (2, 3))
                both = len(np.intersect1d(one, two, assume_unique=True))
                hit[k] = both * share.denominator >= share.numerator * (len(one) + len(two) - both)
            yield pa.RecordBatch.from_arrays([pa.array(a[hit]), pa.array(b[hit])], schema=_PROPOSAL)

    return run


def linked(pairs: DataFrame, sets: DataFrame, share: Fraction, salted: int = 4096) -> DataFrame:
    """The pairs a, b whose sets reach the share; sets: id, hashes."""
    hubs = (pairs.groupBy("a").agg(F.count(F.lit(1)).alias("rows"))
            .select("a", F.ceil(F.col("rows") / salted).cast("long").alias("salts")))
    salt = F.pmod(F.xxhash64("b"), F.col("salts"))
    dealt = pairs.join(sorted_side(hubs), "a").select("a", "b", salt.alias("salt"))
    copied = (sets.join(sorted_side(hubs), F.col("id") == F.col("a"))
              .select("a", F.col("hashes").alias("one"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt")))
    later = sets.select(F.col("id").alias("b"), F.col("hashes").alias("two"))
    whole = dealt.join(sorted_side(copied), ["a", "salt"]).join(sorted_side(later), "b").select("a", "b", "one", "two")
    return whole.mapInArrow(_alike(share), "a long, b long")


def _staged(docs: DataFrame, id_col: str, text_col: str, size: int, prints: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, sha, node) of all docs, and the distinct nodes (id, node, least, fps, n)."""
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(text, 256).alias("sha"), text.alias("text"))
    rows = stage(rows.mapInArrow(_sketches(size, prints), "doc_id long, sha string, node binary, fps array<long>, n long"), "sketches")
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("fps").alias("fps"), F.first("n").alias("n"))
    return rows, stage(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")


def links(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, size: int, share: Fraction,
          radius: int, chunk: int, dense: int = 4) -> DataFrame:
    """Pairs a, b of node ids that are alike: found by fingerprint, checked by their sets.

    They join whatever the pairs within the radius join: those that the first proposals leave out are
    compared between open nodes that the first links leave apart.
    """
    blocks = block_count(nodes.count(), radius)
    both = stage(proposals(nodes, radius, share, blocks, chunk, dense), "proposals")
    pairs, left = both.filter("b is not null"), both.filter("b is null").select(F.col("a").alias("id"))
    wanted = stage(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).unionByName(left).distinct()
                   .join(sorted_side(nodes.select("id", "node", "least")), "id"), "wanted")
    # only texts of wanted nodes are read again, one of each
    near = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    near = near.join(sorted_side(wanted.select("least").distinct()), F.col("doc_id").eqNullSafe(F.col("least")), "left_semi")
    sets = near.select("text").mapInArrow(_set_rows(size), "node binary, hashes binary, parity array<long>")
    sets = sets.join(sorted_side(wanted.select("id", "node")), "node").groupBy("id").agg(F.first("hashes").alias("hashes"), F.first("parity").alias("parity"))
    sets = stage(sets, "sets")
    found = stage(linked(pairs, sets, share), "alike")
    if left.isEmpty():
        return found
    labels = components(found).select(F.col("node").alias("id"), "label")
    open_nodes = nodes.select("id", "fps", "n").join(sorted_side(left), "id").join(sorted_side(sets.select("id", "parity")), "id")
    open_nodes = open_nodes.join(sorted_side(labels), "id", "left")
    open_nodes = stage(open_nodes.select("id", "fps", "n", F.coalesce("label", "id").alias("label"), "parity"), "open")
    # open texts are dense: every table compares most pairs of a cloud again, so few of them, with short keys, do
    few = block_count(open_nodes.count(), radius, key_bits=1)
    more = stage(further(open_nodes, radius, share, few, chunk).join(sorted_side(pairs), ["a", "b"], "left_anti"), "further")
    return found.unionByName(stage(linked(more, sets, share), "alike"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5,
           share: Fraction = Fraction(4, 5), prints: int = 2, radius: int = 10, chunk: int = 16_384,
           dense: int = 4) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, sha, node) of all docs, and nodes with head_node and head, the node and id that stay."""
    rows, nodes = _staged(docs, id_col, text_col, size, prints)
    found = components(links(docs, nodes, id_col, text_col, size, share, radius, chunk, dense))
    labelled = nodes.join(sorted_side(found.select(F.col("node").alias("id"), "label")), "id", "left").select(
        "node", "least", F.coalesce("label", "id").alias("label"))
    place = F.struct(F.col("least").isNull().alias("none"), "least", "node")
    heads = labelled.groupBy("label").agg(F.min(place).alias("head"))
    return rows, labelled.join(sorted_side(heads), "label").select("node", F.col("head.node").alias("head_node"),
                                                      F.col("head.least").alias("head"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5,
             share: Fraction = Fraction(4, 5), prints: int = 2, radius: int = 10, chunk: int = 16_384,
           dense: int = 4) -> DataFrame:
    """The rows of docs that stay, one of each group: the smallest id, nulls last."""
    rows, nodes = groups(docs, id_col, text_col, size, share, prints, radius, chunk, dense)
    heads = nodes.filter("node = head_node").select("node", "head")
    # texts of one id and one set that are written differently: the least digest stays
    stays = (rows.join(sorted_side(heads), "node").filter(F.col("doc_id").eqNullSafe(F.col("head")))
             .groupBy("node").agg(F.min("sha").alias("sha"), F.first("head").alias("head")).select("head", "sha"))
    return _rows_of(docs, stays, F.col(id_col).cast("long"), F.col(text_col))


def _rows_of(docs: DataFrame, stays: DataFrame, doc_id: Column, text: Column) -> DataFrame:
    """One row of docs for each (head, sha)."""
    whole = docs.select(F.struct("*").alias("row"), doc_id.alias("doc_id"),
                        F.sha2(F.coalesce(text.cast("binary"), F.lit(b"")), 256).alias("text_sha"))
    found = whole.join(sorted_side(stays), F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("text_sha") == F.col("sha")))
    order = Window.partitionBy("sha", "doc_id").orderBy(F.monotonically_increasing_id())
    return found.withColumn("nth", F.row_number().over(order)).filter("nth = 1").select("row.*")
