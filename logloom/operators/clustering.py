"""Similarity clusters of vectors.

Leaders are elected in rounds (`similarity.fixed_leaders`), no pairs are handed on. `best_match`
compares vectors with a bounded block of targets at a time.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.vectors import cluster_id  # noqa: F401
from logloom.operators.similarity import fixed_leaders
from logloom.plans.staging import stage

# workers get this module's code with the job, so they need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 2048
ALGORITHM, VERSION = "cosine_threshold_greedy", "v1"


def completed_vectors(embeddings: DataFrame, model_id: str) -> DataFrame:
    """(id, vector) of completed, non-empty embeddings of one model."""
    ok = ((F.col("model_id") == model_id) & (F.col("generation_status") == "completed")
          & (F.size("vector") > 0))
    return embeddings.filter(ok).select(F.col("session_id").alias("id"), "vector")


def check_dimension(vectors: DataFrame) -> DataFrame:
    """One row with the count; fails when vectors differ in length."""
    low, high = F.min(F.size("vector")), F.max(F.size("vector"))
    return vectors.agg(F.count("*").alias("vectors"), F.when(
        low == high, low).otherwise(F.raise_error(F.lit("vectors differ in dimension"))
                                    .cast("int")).alias("dimension"))


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)


def _blocks(sorted_ids: DataFrame, block: int) -> Iterator[tuple[list[str], np.ndarray]]:
    """Rows in id order, `block` of them at a time; never more than one block on the driver."""
    last = None
    while True:
        rest = sorted_ids if last is None else sorted_ids.filter(F.col("id") > last)
        rows = rest.orderBy("id").limit(block).collect()
        if not rows:
            return
        last = rows[-1]["id"]
        yield [r["id"] for r in rows], np.array([r["vector"] for r in rows], dtype="float64")


def _improve(state: DataFrame, ids: list[str], units: np.ndarray) -> DataFrame:
    """Raise each row's best similarity with one block of targets."""
    shared = state.sparkSession.sparkContext.broadcast((np.array(ids, dtype=object), units))

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, targets = shared.value
        for pdf in batches:
            if len(pdf) == 0:
                yield pdf
                continue
            sims = _unit(np.stack(pdf["vector"].to_numpy()).astype("float64")) @ targets.T
            where = sims.argmax(axis=1)
            top = sims[np.arange(len(pdf)), where]
            better = top > pdf["best"].to_numpy(dtype="float64")
            yield pdf.assign(best=np.where(better, top, pdf["best"]),
                             leader=np.where(better, names[where], pdf["leader"]))

    return state.mapInPandas(step, state.schema)


def _start(vectors: DataFrame) -> DataFrame:
    return vectors.select(
        F.col("id").cast("string").alias("id"), F.col("vector").cast("array<double>").alias("vector"),
        F.lit(-2.0).alias("best"), F.lit(None).cast("string").alias("leader"))


def leader_clusters(vectors: DataFrame, threshold: float = 0.92, block: int = BLOCK) -> DataFrame:
    """(id, leader, similarity): fixed-leader clusters in id order, see `similarity.fixed_leaders`."""
    return fixed_leaders(vectors.select(F.col("id").cast("string").alias("id"), "vector"), threshold, block)


def best_match(vectors: DataFrame, targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """(id, leader, similarity): the most similar target of every vector; ties go to the lower id."""
    state = _start(vectors)
    named = targets.select(F.col("id").cast("string").alias("id"),
                           F.col("vector").cast("array<double>").alias("vector"))
    for n, (ids, rows) in enumerate(_blocks(named, block)):
        state = _improve(state, ids, _unit(rows))
        if n % 16 == 15:
            state = stage(state, "matches")
    return state.select("id", "leader", F.col("best").alias("similarity"))


def cluster_sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("leader").agg(F.count("*").alias("members"))


def run_snapshot(members: DataFrame, *, run_id: str, generated_at: str, model_id: str,
                 threshold: float, cluster: str = "cluster_id") -> DataFrame:
    """The one-row description of a clustering run."""
    return members.agg(
        F.lit(run_id).alias("run_id"), F.lit(generated_at).alias("generated_at"),
        F.lit(ALGORITHM).alias("algorithm"), F.lit(VERSION).alias("algorithm_version"),
        F.lit(model_id).alias("source_model_id"), F.lit(threshold).alias("similarity_threshold"),
        F.count("*").alias("session_count"), F.count_distinct(cluster).alias("cluster_count"))


def latest_memberships(runs: DataFrame, memberships: DataFrame) -> DataFrame:
    """Members of the most recent run."""
    latest = runs.agg(F.max_by("run_id", F.struct("generated_at", "run_id")).alias("run_id"))
    return memberships.join(F.broadcast(latest), "run_id", "left_semi")
