"""Quality classifier: naive Bayes support vectors (NB-SVM).

A text becomes the set of its n-grams (present or not, however often), hashed to a fixed space.
Each indicator is scaled by its class log-count ratio (naive Bayes), and a linear hinge-loss
model is fitted to the scaled indicators by dual coordinate descent. A logistic curve fitted to
margins from cross-fitting turns the margin into a score from 0 to 1.

Three kinds of n-gram see what a quality label tends to depend on: characters by shape (runs
of letters and digits squeezed to one), words and word pairs, and repeats of the previous word.

The fit uses at most `max_rows` labelled rows, those with the smallest hash of their id, a
documented bound; so the driver gets at most that many index lists. Scoring reads every whole
text, in the scan, with no shuffle. Inputs of a score are the text alone.

Defined results: a null text is scored like an empty one; rows with a null label, null id or a
held-out id are not learned from; one row per id is learned from; if a class has no rows every
text gets the share of label 1 (with one added to both counts); repeated rows get equal scores;
an empty table gives an empty result; further columns are ignored by `score_texts` and
returned by `keep_good`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.word_hashes import Words, byte_ends, mix

#: Number of hashed features: the lower half for shapes, the upper one for words.
SPACE = 1 << 18
HALF = SPACE // 2
PASS_BYTES = 400_000
LETTER, UPPER, DIGIT, BLANK_SHAPE = 1, 2, 3, 4


def _shapes() -> np.ndarray:
    codes = np.arange(256, dtype=np.int16) + 8  # every other sign is a shape of its own
    codes[ord("a"):ord("z") + 1] = codes[128:] = LETTER
    codes[ord("A"):ord("Z") + 1] = UPPER
    codes[ord("0"):ord("9") + 1] = DIGIT
    codes[[9, 11, 12, 13, 32]] = BLANK_SHAPE
    return codes


SHAPES = _shapes()


def _ngrams(codes: np.ndarray, doc: np.ndarray, longest: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(document, feature number before hashing to a range) of all 1- to longest-grams inside documents."""
    out, value = [], np.full(len(codes), seed, np.uint64)
    for n in range(1, longest + 1):
        if len(codes) < n:
            break
        value = mix(value[:len(codes) - n + 1] * np.uint64(31) + codes[n - 1:].astype(np.uint64))
        inside = doc[:len(codes) - n + 1] == doc[n - 1:]
        out.append((doc[:len(codes) - n + 1][inside], value[inside]))
    return out


def features(texts: pa.Array) -> list[np.ndarray]:
    """The set of feature numbers of each text."""
    texts = texts.fill_null(b"") if texts.null_count else texts
    n_docs = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + n_docs + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    doc = np.repeat(np.arange(n_docs, dtype=np.int32), np.diff(offsets))
    codes = SHAPES[data]
    again = np.zeros(len(codes), bool)
    again[1:] = (codes[1:] == codes[:-1]) & (codes[1:] <= DIGIT) & (doc[1:] == doc[:-1])
    found = [(d, (v % np.uint64(HALF)).astype(np.int32)) for d, v in _ngrams(codes[~again], doc[~again], 4, 1)]

    words = Words(texts)
    repeat = np.zeros(len(words.hashes), np.int64)
    repeat[1:] = (words.hashes[1:] == words.hashes[:-1]) & (words.doc[1:] == words.doc[:-1])
    for d, v in _ngrams(words.hashes, words.doc, 2, 2) + _ngrams(repeat, words.doc, 4, 3):
        found.append((d, (v % np.uint64(HALF)).astype(np.int32) + HALF))

    counts = np.zeros(n_docs, np.int64)
    for d, _ in found:
        counts += np.bincount(d, minlength=n_docs)
    ends = np.cumsum(counts)
    flat = np.empty(int(ends[-1]) if n_docs else 0, np.int32)
    at = ends - counts
    for d, v in found:  # each part comes in order of documents
        n = np.bincount(d, minlength=n_docs)
        flat[np.repeat(at - (np.cumsum(n) - n), n) + np.arange(len(d))] = v
        at += n
    out, last = [], np.empty(SPACE, np.int32)
    for a, b in zip(ends - counts, ends):
        own = flat[a:b]
        order = np.arange(b - a, dtype=np.int32)
        last[own] = order
        out.append(own[last[own] == order])
    return out


def slices(texts: pa.Array):
    """Parts of an array of about PASS_BYTES bytes, one text at least."""
    ends = byte_ends(texts)
    at = 0
    while at < len(texts):
        base = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, base + PASS_BYTES, "right")))
        yield texts.slice(at, end - at)
        at = end


@dataclass
class Model:
    """Logistic of the margin of a unit-length row: weights hold w * r, squares hold r * r."""

    weights: np.ndarray
    squares: np.ndarray
    bias: float
    slope: float
    shift: float

    def scores(self, sets: list[np.ndarray]) -> np.ndarray:
        sums = np.array([(self.weights[s].sum(), self.squares[s].sum()) for s in sets]).reshape(-1, 2)
        margin = sums[:, 0] / np.sqrt(np.where(sums[:, 1] > 0, sums[:, 1], 1)) + self.bias
        return logistic(self.slope * margin + self.shift)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def log_count_ratios(sets: list[np.ndarray], labels: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """log of (share of class 1's indicator counts) / (share of class 0's), smoothed."""
    p, q = np.full(SPACE, alpha), np.full(SPACE, alpha)
    for s, y in zip(sets, labels):
        (p if y else q)[s] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def fit_hinge(sets: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, cost: float, rounds: int,
              seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias by dual coordinate descent for the L1 hinge loss; classes weigh equally.

    Rows are scaled to unit length. min |w|^2 / 2 + sum c_i max(0, 1 - y_i w x_i).
    """
    sign = np.where(labels, 1.0, -1.0)
    caps = np.where(labels, cost * len(labels) / 2 / labels.sum(), cost * len(labels) / 2 / (~labels).sum())
    lengths = [float(np.sqrt(np.square(ratios[s]).sum()) or 1.0) for s in sets]
    rows = [ratios[s] / n for s, n in zip(sets, lengths)]
    weights, bias, alpha = np.zeros(SPACE), 0.0, np.zeros(len(sets))
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(sets)):
            s, x, y = sets[i], rows[i], sign[i]
            slope = y * (weights[s] @ x + bias) - 1
            new = min(max(alpha[i] - slope / (x @ x + 1 if len(x) else 1), 0.0), caps[i])
            step = (new - alpha[i]) * y
            if step:
                weights[s] += step * x
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3 * cost:
            break
    return weights, bias


def margins(sets, ratios, weights, bias) -> np.ndarray:
    return np.array([ratios[s] @ weights[s] / float(np.sqrt(np.square(ratios[s]).sum()) or 1.0) for s in sets]) + bias


def fit_logistic(margin: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton steps with a small ridge."""
    x = np.stack([margin, np.ones(len(margin))], axis=1)
    target = np.where(labels, (labels.sum() + 1) / (labels.sum() + 2), 1 / ((~labels).sum() + 2))
    at = np.array([1.0, 0.0])
    for _ in range(50):
        p = logistic(x @ at)
        grad = x.T @ (p - target) + 1e-3 * at
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        at = at - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(at[0]), float(at[1])


def fit(sets: list[np.ndarray], labels: np.ndarray, cost: float = 1.0, rounds: int = 20) -> Model:
    labels = labels.astype(bool)
    if labels.all() or not labels.any():
        share = (labels.sum() + 1) / (len(labels) + 2)
        return Model(np.zeros(SPACE), np.zeros(SPACE), 0.0, 0.0, float(np.log(share / (1 - share))))
    held = np.zeros(len(sets))
    fold = np.arange(len(sets)) % 2
    for k in (0, 1):
        other = np.flatnonzero(fold != k)
        if labels[other].all() or not labels[other].any():
            continue
        part = [sets[i] for i in other]
        ratios = log_count_ratios(part, labels[other])
        w, b = fit_hinge(part, labels[other], ratios, cost, rounds)
        own = np.flatnonzero(fold == k)
        held[own] = margins([sets[i] for i in own], ratios, w, b)
    ratios = log_count_ratios(sets, labels)
    weights, bias = fit_hinge(sets, labels, ratios, cost, rounds)
    return Model(weights * ratios, np.square(ratios), bias, *fit_logistic(held, labels))


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
          text_col: str = "text", usable: Callable[[Column], Column] | None = None, max_rows: int = 6_000,
          cost: float = 1.0, rounds: int = 20) -> Model:
    """Fit on at most max_rows labelled rows whose id is usable (not held out)."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).dropna()
    if usable is not None:
        known = known.filter(usable(F.col("id")))
    chosen = known.orderBy(F.xxhash64("id"), "id", "label").limit(max_rows).dropDuplicates(["id"])

    @F.arrow_udf("array<int>")
    def indices(texts: pa.Array) -> pa.Array:
        return pa.array([x for part in slices(texts) for x in features(part)], pa.list_(pa.int32()))

    rows = (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
            .join(F.broadcast(chosen), "id").select("id", "label", indices("text").alias("features"))
            .groupBy("id").agg(F.first("label").alias("label"), F.first("features").alias("features"))
            .orderBy(F.xxhash64("id"), "id").toArrow())
    sets = [np.asarray(x.values, np.int32) for x in rows.column("features").combine_chunks()] if len(rows) else []
    return fit(sets, np.array(rows.column("label").to_pylist(), np.int64) == 1, cost, rounds)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """The model's score of each text, for use in a select on docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        parts = [sent.value.scores(features(part)) for part in slices(texts)]
        return pa.array(np.concatenate(parts) if parts else np.empty(0), pa.float64())

    return run(F.col(text_col).cast("binary"))


def score_texts(docs: DataFrame, model: Model, threshold: float = 0.7, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, score, predicted."""
    return (docs.select(F.col(id_col).alias("doc_id"), score(docs, model, text_col).alias("score"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of docs that reach the threshold."""
    return docs.filter(score(docs, model, text_col) >= threshold)
