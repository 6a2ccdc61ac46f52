"""Benchmark decontamination by greedy string tiling.

A document is contaminated by a benchmark item when tiles cover at least `threshold` of the
item's words. A tile is a common run of at least `min_words` words; tiles do not overlap on
either side and may come in any order, so reordered passages are found.

Seeds. The benchmark is the stated query set. It is cut into blocks of about `block_words`
words, each small enough to be sent to every task; a benchmark of any size takes more blocks.
Documents are scanned once with no shuffle: runs of `min_words` words are hashed and looked up
among the seeds of the block. The words of an item under the seeds a document shares with it
bound the coverage from above, and only pairs that can reach the threshold are tiled.

Tiling. Running Karp-Rabin: runs of length s in the item are hashed, the document's are rolled
past them, hits are compared word by word and extended; the longest are marked first. When no
run of s words is left, s is halved, down to `min_words`. Marked words take no further part.

Words are letters and digits of the lower-cased text. Items of fewer than `min_words` words
need all their words in one run; items without words match nothing.

Defined results: null and empty texts are clean; null or repeated ids are judged row by row;
an empty benchmark leaves every document clean; further columns are ignored by
`contaminations` and returned by `keep_clean`.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.word_hashes import Words

NO_WORD = re.compile(r"[\W_]+")
HIT_DDL = "array<struct<item:int,coverage:double,tiles:int,longest:int>>"
HIT = pa.list_(pa.struct([("item", pa.int32()), ("coverage", pa.float64()), ("tiles", pa.int32()),
                          ("longest", pa.int32())]))
_BASE, _PRIME = 1_000_003, (1 << 61) - 1


def clean(text: str | None) -> str:
    return NO_WORD.sub(" ", (text or "").lower()).strip()


def _free_runs(marked: list[bool], length: int) -> list[tuple[int, int]]:
    """Unmarked (start, end) of at least `length` words."""
    runs, at = [], 0
    for k, used in enumerate([*marked, True]):
        if used:
            if k - at >= length:
                runs.append((at, k))
            at = k + 1
    return runs


def _rolled(words: list[int], runs: list[tuple[int, int]], length: int):
    """(place, Karp-Rabin hash) of every run of `length` words inside the free runs."""
    lead = pow(_BASE, length - 1, _PRIME)
    for start, end in runs:
        value = 0
        for k in range(start, end):
            if k - start >= length:
                value = (value - words[k - length] * lead) % _PRIME
            value = (value * _BASE + words[k]) % _PRIME
            if k - start >= length - 1:
                yield k - length + 1, value


def tile(item: list[int], doc: list[int], min_words: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in item, place in doc, length), longest first."""
    used_item, used_doc = [False] * len(item), [False] * len(doc)
    tiles: list[tuple[int, int, int]] = []
    size = max(min_words, len(item))
    while True:
        best, matches = 0, []
        places = defaultdict(list)
        for a, value in _rolled(item, _free_runs(used_item, size), size):
            places[value].append(a)
        for b, value in _rolled(doc, _free_runs(used_doc, size), size) if places else ():
            for a in places.get(value, ()):
                if a and b and not used_item[a - 1] and not used_doc[b - 1] and item[a - 1] == doc[b - 1]:
                    continue  # not the left end of a match
                n = 0
                while (a + n < len(item) and b + n < len(doc) and item[a + n] == doc[b + n]
                       and not used_item[a + n] and not used_doc[b + n]):
                    n += 1
                if n >= size:
                    best = max(best, n)
                    matches.append((a, b, n))
        for a, b, n in sorted(matches):
            if n == best and not any(used_item[a:a + n]) and not any(used_doc[b:b + n]):
                used_item[a:a + n] = used_doc[b:b + n] = [True] * n
                tiles.append((a, b, n))
        if not matches and size <= max(min_words, 1):
            break
        if not matches:
            size = max(min_words, size // 2)
    return tiles


class Block:
    """Seeds of some benchmark items: a bitmap, the sorted seed hashes and their places."""

    def __init__(self, texts: list[str | None], min_words: int, threshold: float) -> None:
        self.min_words, self.threshold = min_words, threshold
        words = Words(pa.array([clean(t).encode() for t in texts], pa.binary()))
        self.hashes, self.item, self.within = words.hashes, words.doc, words.within
        self.n_words = words.n_words
        self.first = np.cumsum(words.n_words) - words.n_words
        self.seeds = [s for g in range(1, min_words + 1) if (s := self._seeds(words, g))]

    def _seeds(self, words: Words, gram: int):
        """Seeds of `gram` words: of items with just so many, or with more if gram is min_words."""
        grams = words.grams(gram)
        own = self.n_words[words.doc[:len(grams)]]
        fits = words.left[:len(grams)] >= gram
        at = np.flatnonzero(fits & ((own >= gram) if gram == self.min_words else (own == gram)))
        if not len(at):
            return None
        order = at[np.argsort(grams[at], kind="stable")]
        values, start = np.unique(grams[order], return_index=True)
        size = 1 << max(10, int(16 * len(values) - 1).bit_length())
        bitmap = np.zeros(size, bool)
        bitmap[(values & np.uint64(size - 1)).astype(np.int64)] = True
        return gram, values, np.append(start, len(order)), order, bitmap

    def hits(self, texts: pa.Array) -> list[list[dict]]:
        cleaned = [clean(t) for t in texts.to_pylist()]
        out: list[list[dict]] = [[] for _ in cleaned]
        words = Words(pa.array([t.encode() for t in cleaned], pa.binary()))
        shared: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = defaultdict(list)
        for gram, values, start, order, bitmap in self.seeds:
            grams = words.grams(gram)
            maybe = np.flatnonzero(bitmap[(grams & np.uint64(len(bitmap) - 1)).astype(np.int64)]
                                   & (words.left[:len(grams)] >= gram))
            seed = np.minimum(np.searchsorted(values, grams[maybe]), len(values) - 1)
            held = values[seed] == grams[maybe]
            maybe, seed = maybe[held], seed[held]
            docs = words.doc[maybe]
            cuts = np.flatnonzero(np.diff(docs, prepend=-1, append=-1)) if len(docs) else []
            for a, b in zip(cuts[:-1], cuts[1:]):
                shared[int(docs[a])].append((gram, maybe[a:b], np.unique(seed[a:b])))
        for doc, found in shared.items():
            out[doc] = self._judge(words, doc, found)
        return out

    def _judge(self, words: Words, doc: int, found: list) -> list[dict]:
        under: dict[int, set[int]] = defaultdict(set)
        seeds = {gram: (start, order) for gram, _, start, order, _ in self.seeds}
        near = set()
        for gram, places, own in found:
            start, order = seeds[gram]
            for s in own.tolist():
                for at in order[start[s]:start[s + 1]].tolist():
                    under[int(self.item[at])].update(range(at, at + gram))
            for place in places.tolist():
                near.update(range(place, place + gram))
        out = []
        doc_words: list[int] | None = None
        for item in sorted(under):
            n = int(self.n_words[item])
            if len(under[item]) < self.threshold * n:
                continue
            if doc_words is None:  # words outside all seeds are in no tile; a gap keeps runs apart
                doc_words, last = [], None
                for at in sorted(near):
                    if last is not None and at != last + 1:
                        doc_words.append(-1)
                    doc_words.append(int(words.hashes[at]))
                    last = at
            first = int(self.first[item])
            tiles = tile(self.hashes[first:first + n].tolist(), doc_words, min(self.min_words, n))
            coverage = sum(t[2] for t in tiles) / n
            if coverage >= self.threshold:
                out.append({"item": item, "coverage": coverage, "tiles": len(tiles),
                            "longest": max(t[2] for t in tiles)})
        return out


def _blocks(bench: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[list[tuple]]:
    """Yields the benchmark in parts of about block_words words, one at a time."""
    rows = bench.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    size = F.sum(F.size(F.split(F.coalesce("text", F.lit("")), r"\s+")))
    total = rows.agg(size).first()[0] or 0
    n = -(-total // block_words)
    for k in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r["item_id"], r["text"]) for r in part.collect()]


def _hits(docs: DataFrame, items: list[tuple], text: Column, min_words: int, threshold: float) -> Column:
    block = docs.sparkSession.sparkContext.broadcast(Block([t for _, t in items], min_words, threshold))

    @F.arrow_udf(HIT_DDL)
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([h for k in range(0, len(texts), 256) for h in block.value.hits(texts.slice(k, 256))], HIT)

    return run(text)


def contaminations(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   item_col: str = "item_id", item_text_col: str = "text", min_words: int = 5,
                   threshold: float = 0.5, block_words: int = 2_000_000) -> DataFrame:
    """One row per contaminated pair: doc_id, item_id, coverage, tiles, longest."""
    spark = docs.sparkSession
    out = spark.createDataFrame([], "doc_id long, item_id long, coverage double, tiles int, longest int")
    for items in _blocks(bench, item_col, item_text_col, block_words):
        ids = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(items)], "item int, item_id long")
        found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.explode(
            _hits(docs, items, F.col(text_col), min_words, threshold)).alias("hit")).select("doc_id", "hit.*")
        out = out.unionByName(found.join(F.broadcast(ids), "item").drop("item"))
    return out


def keep_clean(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text", min_words: int = 5, threshold: float = 0.5,
               block_words: int = 2_000_000) -> DataFrame:
    """The rows of docs that no benchmark item contaminates."""
    for items in _blocks(bench, item_col, item_text_col, block_words):
        docs = docs.filter(F.size(_hits(docs, items, F.col(text_col), min_words, threshold)) == 0)
    return docs
