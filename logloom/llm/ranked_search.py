"""Ranked lexical search by the Best Position Algorithm over impact lists.

Documents are scored by a saturating term weight (BM25 in whole numbers, see `search`). The
stated query set is cut into blocks of about `block_terms` words, small enough for every task.

Index. Texts are read once; each document becomes one row with the query terms it holds and how
often, and its length. The rows are written to the shared folder and hold every document with a
term. Numbers of documents, of all words and of documents per term are added up by Spark.

Search. A task takes rows until they make a shard of about `shard_postings` postings and turns
them into impact lists: per term the documents by falling impact. An item is answered by direct
accesses. Each round looks at the next positions behind the best position of every list (the last
of the unbroken run of positions already seen), completes the scores of the documents found there
by looking them up in all lists, and marks those positions as seen too, so runs often go on by
themselves. What is unseen scores at most the sum of the impacts at the best positions. A search
stops only when that sum is strictly below the score of the k-th document, so ties are complete.
The k best of an item are carried from shard to shard, which tightens the bound; a task hands on
k rows an item, and Spark ranks these.

Defined results: null and empty texts have no terms and are neither counted nor found; an item
without terms, or a null one, finds nothing; null ids rank behind others of the same score;
repeated documents are ranked row by row, and so are repeated items, each with ranks of its own;
an empty table on either side gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.plans.staging import stage

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
              for b in range(256))
_NO_TERM = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
#: Bytes of a text that are cut into words at once, and positions that a round looks at per list.
SLICE, FIRST_ROUND, LAST_ROUND = 4 << 20, 32, 4096
_ROWS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tf", pa.list_(pa.int64()))])
_ROWS_DDL = "doc_id long, n long, terms array<int>, tf array<long>"
_FOUND = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])


def _slices(text: bytes) -> Iterator[bytes]:
    """A text in slices of about SLICE bytes, cut where no term is."""
    at = 0
    while at < len(text):
        gap = _NO_TERM.search(text, at + SLICE) if at + SLICE < len(text) else None
        end = gap.end() if gap else len(text)
        yield text[at:end]
        at = end


def term_counts(text: bytes) -> Counter:
    """How often each term is in a text: runs of ASCII letters, digits and non-ASCII signs, A-Z lower-cased."""
    found: Counter = Counter()
    for part in _slices(text):
        found.update(part.translate(_FOLD).split())
    return found


def _index(vocabulary: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = vocabulary.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = []
                part = batch.slice(at, 512)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1)):
                    counts = term_counts(text.as_py() or b"")
                    if counts:
                        held = counts.keys() & ids.keys()
                        rows.append((doc_id, counts.total(), [ids[w] for w in held], [counts[w] for w in held]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ROWS)], schema=_ROWS)

    return run


def _statistics(n_terms: int):
    """Rows to (key, value): documents per term, and under -1 and -2 all documents and words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, docs, words = np.zeros(n_terms, np.int64), 0, 0
        for batch in batches:
            docs, words = docs + batch.num_rows, words + int(batch.column(0).to_numpy().sum())
            seen += np.bincount(batch.column(1).flatten().to_numpy(), minlength=n_terms)
        held = np.flatnonzero(seen)
        keys, values = np.append(held, [-1, -2]), np.append(seen[held], [docs, words])
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(values)], ["key", "value"])

    return run


class Shard:
    """Impact lists of some documents: per term the documents by falling impact, and by their number."""

    def __init__(self, n_terms: int, term: np.ndarray, doc: np.ndarray, impact: np.ndarray) -> None:
        order = np.lexsort((doc, -impact, term))
        self.impact, self.doc = impact[order], doc[order]
        self.first = np.searchsorted(term[order], np.arange(n_terms + 1))
        within = np.arange(len(order)) - self.first[term[order]]
        by_doc = np.lexsort((self.doc, term[order]))
        self.docs_sorted, self.place = self.doc[by_doc], within[by_doc]

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores) that may be among the k best or reach `floor`, and direct accesses done.

        Scores of 0 are left out. floor: a score that k documents are known to reach already.
        """
        lists = [(slice(self.first[t], self.first[t + 1]), int(w)) for t, w in zip(terms.tolist(), weights.tolist())
                 if w > 0 and self.first[t] < self.first[t + 1]]
        impacts = [self.impact[s] for s, _ in lists]
        docs = [self.doc[s] for s, _ in lists]
        by_doc = [(self.docs_sorted[s], self.place[s]) for s, _ in lists]
        seen = [np.zeros(len(i) + 1, bool) for i in impacts]  # the last one never turns true
        best = [0] * len(lists)  # positions 0 to best - 1 have been seen
        found_docs, found_scores, accesses, step = [], [], 0, FIRST_ROUND
        top = np.empty(0, np.int64)
        while any(b < len(i) for b, i in zip(best, impacts)):
            fresh = [d[b:b + step][~s[b:b + step][:len(d[b:b + step])]] for d, b, s in zip(docs, best, seen)]
            new = np.unique(np.concatenate(fresh))  # a document met before has all its positions seen
            scores = np.zeros(len(new), np.int64)
            for j, ((_, weight), (sorted_docs, place)) in enumerate(zip(lists, by_doc)):
                at = np.minimum(np.searchsorted(sorted_docs, new), len(sorted_docs) - 1)
                held = sorted_docs[at] == new
                position = place[at[held]]
                scores[held] += weight * impacts[j][position]
                seen[j][position] = True
                accesses += len(position)
            for j, s in enumerate(seen):
                while s[best[j]]:
                    run = s[best[j]:best[j] + LAST_ROUND]
                    best[j] += len(run) if run.all() else int(np.argmin(run))
            found_docs.append(new)
            found_scores.append(scores)
            top = np.concatenate([top, scores])
            if len(top) > k:
                top = np.partition(top, len(top) - k)[len(top) - k:]
            kth = max(floor, int(top.min()) if len(top) == k else 0)
            bound = sum(w * int(i[b - 1]) for (_, w), i, b in zip(lists, impacts, best) if 0 < b < len(i))
            if bound < kth and all(best):
                break
            step = min(2 * step, LAST_ROUND)
        if not found_docs:
            return np.empty(0, np.int64), np.empty(0, np.int64), 0
        all_docs, all_scores = np.concatenate(found_docs), np.concatenate(found_scores)
        kth = max(floor, int(top.min()) if len(top) == k else 0, 1)
        keep = all_scores >= kth
        return all_docs[keep], all_scores[keep], accesses


def impacts_of(tf: np.ndarray, length: np.ndarray, n_docs: int, n_words: int, k1: int, b: int) -> np.ndarray:
    """(10^9 tf) div (1000 tf + k1 m), where m is 100 - b + (b n N) div L."""
    if int(length.max(initial=0)) * b * n_docs < 1 << 63:
        m = 100 - b + (b * length * n_docs) // n_words
    else:
        m = 100 - b + np.array([b * n * n_docs // n_words for n in length.tolist()], np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + k1 * m)


def _search(plan: Broadcast, k: int, k1: int, b: int, shard_postings: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_docs, n_words, n_terms, items = plan.value
        kept: list[list[tuple[int, float, int | None]]] = [[] for _ in items]

        def shard(held: list[pa.RecordBatch]) -> None:
            ids = [x for h in held for x in h.column(0).to_pylist()]
            n = np.concatenate([h.column(1).to_numpy() for h in held])
            sizes = np.concatenate([h.column(2).value_lengths().to_numpy() for h in held])
            term = np.concatenate([h.column(2).flatten().to_numpy() for h in held]).astype(np.int64)
            tf = np.concatenate([h.column(3).flatten().to_numpy() for h in held])
            doc = np.repeat(np.arange(len(ids)), sizes)
            lists = Shard(n_terms, term, doc, impacts_of(tf, n[doc], n_docs, n_words, k1, b))
            for own, (terms, weights) in zip(kept, items):
                floor = -own[-1][0] if len(own) == k else 0
                docs, scores, _ = lists.best(terms, weights, k, floor)
                if len(docs):
                    own.extend((-s, math.inf if ids[d] is None else ids[d], ids[d])
                               for d, s in zip(docs.tolist(), scores.tolist()))
                    own.sort(key=lambda r: r[:2])
                    del own[k:]

        held: list[pa.RecordBatch] = []
        postings = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                held.append(part)
                postings += len(part.column(2).flatten())
                if postings >= shard_postings:
                    shard(held)
                    held, postings = [], 0
        if held:
            shard(held)
        rows = [(item, doc_id, -score) for item, own in enumerate(kept) for score, _, doc_id in own]
        columns = list(zip(*rows)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FOUND)], schema=_FOUND)

    return run


def _blocks(items: DataFrame, id_col: str, text_col: str, block_terms: int) -> Iterator[list[tuple]]:
    """Yields the items in parts of about block_terms words, one at a time."""
    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    size = F.sum(F.size(F.split(F.coalesce("text", F.lit("")), r"\s+")))
    total = rows.agg(size).first()[0] or 0
    n = -(-total // block_terms)
    if n > 1:
        rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "items")
    for k in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("row"), F.lit(n)) == k)
        yield [(r["item_id"], r["text"]) for r in part.collect()]


def weight_of(n_docs: int, seen: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * seen + 1)))


def _ranked(docs: DataFrame, block: list[tuple], k: int, k1: int, b: int, shard_postings: int) -> DataFrame:
    spark = docs.sparkSession
    context = spark.sparkContext
    wanted = [term_counts((text or "").encode()) for _, text in block]
    vocabulary = {w: t for t, w in enumerate(sorted(set().union(*wanted)))}
    shared = context.broadcast(vocabulary)
    rows = stage(docs.mapInArrow(_index(shared), _ROWS_DDL), "postings")
    counts = rows.select("n", "terms").mapInArrow(_statistics(len(vocabulary)), "key long, value long")
    total = {r["key"]: r["value"] for r in counts.groupBy("key").agg(F.sum("value").alias("value")).collect()}
    n_docs, n_words = total.get(-1, 0), total.get(-2, 0)
    queries = []
    for counted in wanted:
        terms = np.array([vocabulary[w] for w in counted], np.int64)
        weights = [q * weight_of(n_docs, total.get(vocabulary[w], 0)) for w, q in counted.items()]
        queries.append((terms, np.array(weights, np.int64)))
    plan = context.broadcast((n_docs, n_words, len(vocabulary), queries))
    found = rows.mapInArrow(_search(plan, k, k1, b, shard_postings), "item int, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salted = Window.partitionBy("item", "salt").orderBy(*order)
    whole = Window.partitionBy("item").orderBy(*order)
    few = (found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
           .withColumn("rank", F.row_number().over(salted)).filter(F.col("rank") <= k))
    top = few.withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= k)
    names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(block)], "item int, item_id long")
    out = stage(top.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), "ranked")
    shared.unpersist()
    plan.unpersist()
    return out


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text", k1: int = 12, b: int = 25,
           shard_postings: int = 2_000_000, block_terms: int = 200_000) -> DataFrame:
    """The k best documents of each item with a score above 0: item_id, rank (from 1), doc_id, score.

    A term that df of N documents hold weighs w = floor(1000 ln((2N + 2) / (2 df + 1))). A document of
    n of all L words has m = 100 - b + (b n N) div L, and scores the sum of
    w * ((10^9 tf) div (1000 tf + k1 m)) over the item's terms, repeats included: k1 in tenths, b in
    hundredths. Equal scores rank by ascending id.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    out = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in _blocks(items, item_col, item_text_col, block_terms):
        out = out.unionByName(_ranked(texts, block, k, k1, b, shard_postings))
    return out
