"""Language identification by a byte convolutional network.

The lower-cased UTF-8 text is cut into windows of `window` bytes, the last one filled up with
zeros. A byte embedding feeds filters of several widths; each filter keeps its maximum over the
window; a softmax layer gives the language of the window. A document gets the mean over all its
windows, weighted by their bytes. The network is trained in numpy on the driver with a bounded
sample: at most `rows_a_language` labelled rows of each language (smallest hash of the id), `per_text`
windows of each.

When the network is applied, embedding and filters are folded into tables indexed by single
bytes and byte pairs, so a filter's response is a sum of a few looked-up rows, for all windows
of a batch at once.

Defined results: a text that is null or has no letter is `und` with score 0; rows with a null
language or id are not learned from; without any labelled row every text is `und`; repeated
rows get equal results; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LETTER = re.compile(r"[^\W\d_]")
WINDOW, WIDTHS, FILTERS, DIMENSIONS = 256, (2, 3, 4), 16, 8
#: Windows per pass, when training and when applying.
TRAIN_BATCH, APPLY_BATCH = 64, 512


def windows_of(data: bytes, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(windows x window) bytes and the bytes that count in each; an empty text has none."""
    n = -(-len(data) // window)
    cells = np.zeros(n * window, np.uint8)
    cells[:len(data)] = np.frombuffer(data, np.uint8)
    sizes = np.full(n, window)
    if n:
        sizes[-1] = len(data) - (n - 1) * window
    return cells.reshape(n, window), sizes


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray            # 256 x DIMENSIONS
    filters: list[np.ndarray]        # per width: width x DIMENSIONS x FILTERS
    offsets: list[np.ndarray]        # per width: FILTERS
    dense: np.ndarray                # all filters x languages
    bias: np.ndarray

    def tables(self) -> list[list[tuple[int, np.ndarray]]]:
        """Per width: (first byte, table) whose looked-up rows add up to the response."""
        out = []
        for width, kernel in zip(WIDTHS, self.filters):
            single = [(self.embedding @ kernel[k]).astype(np.float32) for k in range(width)]
            parts = []
            for k in range(0, width - 1, 2):
                pair = (single[k][None, :, :] + single[k + 1][:, None, :]).reshape(65_536, -1)
                parts.append((k, pair))  # index: first byte + 256 * second byte
            if width % 2:
                parts.append((width - 1, single[-1]))
            out.append(parts)
        return out

    def probabilities(self, cells: np.ndarray, sizes: np.ndarray, tables) -> np.ndarray:
        pairs = cells[:, :-1].astype(np.int32) + (cells[:, 1:].astype(np.int32) << 8)
        pooled = []
        for width, parts, offset in zip(WIDTHS, tables, self.offsets):
            n = cells.shape[1] - width + 1
            total = None
            for k, table in parts:
                index = pairs if len(table) > 256 else cells
                rows = table[index[:, k:k + n]]
                total = rows if total is None else np.add(total, rows, out=total)
            short = np.flatnonzero(sizes < cells.shape[1])
            for w in short:  # positions that reach beyond the text do not count
                total[w, max(int(sizes[w]) - width + 1, 1):] = -np.inf
            pooled.append(np.maximum(total.max(axis=1) + offset.astype(np.float32), 0))
        return softmax(np.concatenate(pooled, axis=1) @ self.dense + self.bias)

    def judge(self, texts: list[str | None], tables) -> list[tuple[str, float]]:
        data = [t.lower().encode("utf-8", "replace") if t and LETTER.search(t) else b"" for t in texts]
        found = [("und", 0.0)] * len(texts)
        if not self.languages:
            return found
        total = np.zeros((len(texts), len(self.languages)))
        cells, sizes, owner = [], [], []

        def flush() -> None:
            all_cells, all_sizes, all_owner = (np.concatenate(x) for x in (cells, sizes, owner))
            for at in range(0, len(all_cells), APPLY_BATCH):
                part = slice(at, at + APPLY_BATCH)
                p = self.probabilities(all_cells[part], all_sizes[part], tables)
                np.add.at(total, all_owner[part], p * all_sizes[part, None])
            for x in (cells, sizes, owner):
                x.clear()

        held = 0
        for k, d in enumerate(data):
            c, s = windows_of(d, WINDOW)
            cells.append(c), sizes.append(s), owner.append(np.full(len(c), k))
            held += len(c)
            if held >= 4 * APPLY_BATCH:
                flush()
                held = 0
        if held:
            flush()
        for k, d in enumerate(data):
            if d:
                best = int(total[k].argmax())
                found[k] = self.languages[best], float(total[k, best] / total[k].sum())
        return found


def train(samples: list[bytes], labels: list[str], steps: int = 700, rate: float = 0.01, seed: int = 3) -> Network:
    """Fit by Adam on cross-entropy; classes weigh equally, some windows are shortened at random."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    y_all = np.array([languages.index(x) for x in labels], np.int64)
    model = Network(languages, rng.normal(0, 0.5, (256, DIMENSIONS)),
                    [rng.normal(0, 1 / np.sqrt(w * DIMENSIONS), (w, DIMENSIONS, FILTERS)) for w in WIDTHS],
                    [np.zeros(FILTERS) for _ in WIDTHS],
                    rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))), np.zeros(len(languages)))
    if len(languages) < 2:
        return model
    cells_all = np.zeros((len(samples), WINDOW), np.uint8)
    size_all = np.array([min(len(s), WINDOW) for s in samples])
    for k, s in enumerate(samples):
        cells_all[k, :size_all[k]] = np.frombuffer(s[:WINDOW], np.uint8)
    by_class = [np.flatnonzero(y_all == k) for k in range(len(languages))]
    values = [model.embedding, *model.filters, *model.offsets, model.dense, model.bias]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    for step in range(1, steps + 1):
        picked_class = rng.integers(len(languages), size=TRAIN_BATCH)
        rows = np.array([rng.choice(by_class[k]) for k in picked_class])
        cells, sizes, y = cells_all[rows].copy(), size_all[rows].copy(), y_all[rows]
        for k in np.flatnonzero(rng.random(TRAIN_BATCH) < 0.4):
            sizes[k] = rng.integers(min(12, sizes[k]), sizes[k] + 1)
            cells[k, sizes[k]:] = 0
        grads = _gradients(model, cells, sizes, y)
        for v, g, m, s in zip(values, grads, first, second):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            v -= rate * (1 - step / (steps + 1)) * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.99 ** step)) + 1e-8)
    return model


def _gradients(model: Network, cells: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    batch = np.arange(len(cells))
    embedded = model.embedding[cells]
    pooled, places = [], []
    for width, kernel, offset in zip(WIDTHS, model.filters, model.offsets):
        n = WINDOW - width + 1
        response = sum(embedded[:, k:k + n] @ kernel[k] for k in range(width))
        response[np.arange(n)[None, :] >= np.maximum(sizes - width + 1, 1)[:, None]] = -np.inf
        at = response.argmax(axis=1)
        top = np.take_along_axis(response, at[:, None, :], axis=1)[:, 0] + offset
        pooled.append(np.maximum(top, 0))
        places.append(at)
    hidden = np.concatenate(pooled, axis=1)
    error = softmax(hidden @ model.dense + model.bias)
    error[batch, y] -= 1
    error /= len(cells)
    back = (error @ model.dense.T) * (hidden > 0)
    d_embedding, d_filters, d_offsets = np.zeros_like(model.embedding), [], []
    for k, (width, kernel) in enumerate(zip(WIDTHS, model.filters)):
        g = back[:, k * FILTERS:(k + 1) * FILTERS]
        d_kernel = np.zeros_like(kernel)
        for j in range(width):
            seen = cells[batch[:, None], places[k] + j]               # batch x FILTERS
            d_kernel[j] = np.einsum("bfd,bf->df", model.embedding[seen], g)
            np.add.at(d_embedding, seen, g[:, :, None] * kernel[j].T[None])
        d_filters.append(d_kernel)
        d_offsets.append(g.sum(axis=0))
    return [d_embedding, *d_filters, *d_offsets, hidden.T @ error, error.sum(axis=0)]


def learn(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text",
          usable: Callable[[Column], Column] | None = None, rows_a_language: int = 500, per_text: int = 4,
          steps: int = 700) -> Network:
    """Train on windows of at most rows_a_language labelled rows of each language whose id is usable (not held out).

    Those with the smallest hash of their id are taken, so every language of the usable rows is a
    class at every size of the table.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"),
                       F.col(text_col).alias("text"))
    known = rows.filter("id is not null and lang is not null and text is not null")
    if usable is not None:
        known = known.filter(usable(F.col("id")))
    order = [F.xxhash64("id"), F.col("id"), F.col("lang")]
    # tasks keep the first rows of a language before the shuffle, so a frequent one sends few
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    chosen = known.select("id", "lang").withColumn("nth", nth).filter(F.col("nth") <= rows_a_language)
    chosen = chosen.groupBy("id").agg(F.min("lang").alias("lang"))

    @F.arrow_udf("array<binary>")
    def pick(texts: pa.Array) -> pa.Array:
        return pa.array([sample_windows(t.as_py(), per_text) for t in texts], pa.list_(pa.binary()))

    found = (known.select("id", "text").join(F.broadcast(chosen), "id")
             .select("id", "lang", pick("text").alias("windows"))
             .groupBy("id").agg(F.min("lang").alias("lang"), F.first("windows").alias("windows")).orderBy(*order))
    samples, labels = [], []
    for row in found.collect():
        for w in row["windows"]:
            samples.append(bytes(w))
            labels.append(row["lang"])
    return train(samples, labels, steps)


def sample_windows(text: str, per_text: int) -> list[bytes]:
    """Windows spread evenly over a whole text."""
    if not LETTER.search(text):
        return []
    data = text.lower().encode("utf-8", "replace")
    last = max(len(data) - WINDOW, 0)
    starts = sorted({last * k // max(per_text - 1, 1) for k in range(per_text)})
    return [data[s:s + WINDOW] for s in starts]


def identify(docs: DataFrame, model: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    held: dict[str, list] = {}  # the tables, built once per task

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def run(texts: pa.Array) -> pa.Array:
        model = sent.value
        if "tables" not in held:
            held["tables"] = model.tables()
        out = []
        for at in range(0, len(texts), 512):
            out += model.judge(texts.slice(at, 512).to_pylist(), held["tables"])
        return pa.array([{"lang_pred": a, "score": b} for a, b in out],
                        pa.struct([("lang_pred", pa.string()), ("score", pa.float64())]))

    return docs.select(F.col(id_col).alias("doc_id"), run(F.col(text_col)).alias("found")).select("doc_id", "found.*")
