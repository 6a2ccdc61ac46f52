"""Exact similarity joins of vectors that hand on counts and best partners, not pairs.

Vectors are dealt to the cells of pivots (a bounded sample) and packed, one row for up to a chunk of
vectors of one cell. By the triangle inequality of angles a vector can only be similar to members of
a chunk whose pivot lies within the threshold's angle plus the chunk's radius, so it is compared with
those chunks and no others: no partner is lost, and far chunks cost nothing. How many are left depends
on how the vectors lie; where all are about as far from each other, all chunks are. Pairs of chunks
meet in a cartesian product of the packed rows, which reads them where they lie: no vector is copied
for the chunks it meets, so disk does not grow with them. Each pair is one matrix product. A visitor
gives one row for each part of the members: how many partners, and the best earlier one. Rows of a
visitor are combined by an aggregation.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.plans.staging import discard, stage

# workers get this module's code with the job, so they need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of a chunk, most pivots, and bytes of members that a task compares its visitors with.
CHUNK, MOST_PIVOTS, PART = 4096, 512, 32 << 20
#: Rows, the lowest undecided ids, among which one task elects leaders.
ELECTED = 8192
#: Slack for rounded angles, and for cosines that were the threshold by another product.
_SLACK, _ROUNDED = 1e-6, 1e-9
#: Packed rows have the id's type in place of {id}.
_PACK = "chunk bigint, cell int, radius double, ids array<{id}>, vectors binary, copies array<bigint>, marks array<bigint>"


def unit_rows(column: pd.Series) -> np.ndarray:
    return _units(np.stack(column.to_numpy()))


def _units(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype("float64")
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)


def _unpacked(vectors: bytes, n: int, element: str) -> np.ndarray:
    return _units(np.frombuffer(vectors, dtype=element).reshape(n, -1))


def _objects(values) -> np.ndarray:
    out = np.empty(len(values), dtype=object)
    out[:] = list(values)
    return out


def _angles(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.nan_to_num(np.arccos(np.clip(units @ pivots.T, -1, 1)), nan=np.pi)


def _plain(vector: str, rows: DataFrame) -> Column:
    """Single precision stays as it is, which takes half the place; all else becomes double."""
    return F.col(vector).cast("array<float>" if dict(rows.dtypes)[vector] == "array<float>" else "array<double>")


def _element(rows: DataFrame) -> str:
    return "float32" if dict(rows.dtypes)["vector"] == "array<float>" else "float64"


def _mark(vector: str) -> Column:
    """Equal vectors have equal marks; unlike ones may have."""
    return F.xxhash64(vector)


def _place(pivots: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                angles = _angles(unit_rows(pdf["vector"]), pivots)
                cell = angles.argmin(axis=1)
                yield pdf.assign(id=pdf["id"].astype(object), cell=cell.astype("int32"), angle=angles[np.arange(len(pdf)), cell])

    return run


def _pack(chunk: int, element: str):
    """Rows in order of their cells to packed rows of up to `chunk` vectors."""

    def packed(parts: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(parts)
        return pd.DataFrame({
            "cell": [rows["cell"].iloc[0]], "radius": [rows["angle"].max()], "ids": [rows["id"].tolist()],
            "vectors": [np.stack(rows["vector"].to_numpy()).astype(element).tobytes()],
            "copies": [rows["copies"].tolist()], "marks": [rows["mark"].tolist()]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        n, cell = 0, None
        for pdf in batches:
            cells = pdf["cell"].to_numpy()
            edges = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), len(pdf)]
            for start, stop in zip(edges, edges[1:]):
                if held and cells[start] != cell:
                    yield packed(held)
                    held, n = [], 0
                while start < stop:
                    cell, part = cells[start], pdf.iloc[start:min(stop, start + chunk - n)]
                    held.append(part)
                    start, n = start + len(part), n + len(part)
                    if n == chunk:
                        yield packed(held)
                        held, n = [], 0
        if held:
            yield packed(held)

    return run


def _staged_packs(rows: DataFrame, chunk: int, name: str) -> DataFrame:
    """rows (id, vector, copies, mark, cell, angle), ordered by cell inside their partitions, as packed rows."""
    schema = _PACK.format(id=dict(rows.dtypes)["id"])
    packs = rows.mapInPandas(_pack(chunk, _element(rows)), schema.split(", ", 1)[1])
    return stage(packs.select(F.monotonically_increasing_id().alias("chunk"), "*"), name)


def _visitors(rows: DataFrame, chunk: int) -> DataFrame:
    """Packed rows (id, vector) in no order."""
    zero = F.lit(0).cast("bigint")
    plain = rows.select("id", "vector", zero.alias("copies"), zero.alias("mark"), F.lit(0).alias("cell"), F.lit(0.0).alias("angle"))
    return _staged_packs(plain.repartition(max(-(-rows.count() // chunk), 1)), chunk, "visitors")


@dataclass
class _Members:
    """Packed members by cell, the units of the pivots, and in how many parts they are compared."""

    packs: DataFrame
    pivots: np.ndarray
    parts: int


def _members(rows: DataFrame, basis: DataFrame, chunk: int) -> _Members | None:
    """rows (id, vector, copies, mark) dealt to cells; basis (id, vector) holds their vectors, maybe more than once."""
    n = basis.count()
    k = min(max(n // chunk, 1), MOST_PIVOTS)
    sample = basis.orderBy(F.xxhash64("id"), "id").limit(k).select("vector").toPandas()
    if not len(sample):
        return None
    pivots = unit_rows(sample["vector"])
    types = dict(rows.dtypes)
    placed = rows.mapInPandas(_place(pivots), f"id {types['id']}, vector {types['vector']}, copies bigint, mark bigint, cell int, angle double")
    chunks = -(-n // chunk)
    dealt = placed.repartitionByRange(chunks, "cell", "id").sortWithinPartitions("cell", "id")
    size = n * pivots.shape[1] * np.dtype(_element(rows)).itemsize
    return _Members(_staged_packs(dealt, chunk, "cells"), pivots, max(-(-size // PART), min(chunks, 3)))


def _compare(pivots: np.ndarray, threshold: float, element: str):
    limit = np.arccos(min(threshold, 1.0)) + _SLACK

    class Visitors:
        def __init__(self, chunk, ids, vectors) -> None:
            self.chunk, self.ids = chunk, _objects(ids)
            self.units = _unpacked(vectors, len(ids), element)
            self.n, self.best = np.zeros(len(ids), dtype="int64"), np.full(len(ids), -2.0)
            self.partner = np.full(len(ids), None, dtype=object)

        def meet(self, members, pivot: np.ndarray, reach: float) -> None:
            near = np.flatnonzero(_angles(self.units, pivot)[:, 0] <= reach)
            if not len(near):
                return
            order = members.ids.argsort(kind="stable")
            ids, copies, targets = members.ids[order], members.copies[order], members.units[order]
            for at in range(0, len(near), 512):
                rows = near[at:at + 512]
                own = self.ids[rows]
                sims = self.units[rows] @ targets.T
                place = np.searchsorted(ids, own)
                itself = np.minimum(place, len(ids) - 1)
                same = np.flatnonzero(ids[itself] == own)
                sims[same, itself[same]] = -2.0
                hit = sims >= threshold
                self.n[rows] += hit @ copies
                sims[~(hit & (np.arange(len(ids)) < place[:, None]))] = -2.0
                where = sims.argmax(axis=1)  # of equal ones the lower id
                best, partner = sims[np.arange(len(rows)), where], ids[where]
                old, held = self.best[rows], self.partner[rows]
                better = (best > old) | np.array([b == o and b > -2 and p < h for b, o, p, h in zip(best, old, partner, held)])
                self.best[rows[better]], self.partner[rows[better]] = best[better], partner[better]

        def found(self) -> pd.DataFrame:
            some = np.flatnonzero(self.n > 0)
            best = _objects([b if b > -2 else None for b in self.best[some].tolist()])
            return pd.DataFrame({"id": self.ids[some], "n": self.n[some], "best": best, "partner": self.partner[some]})

    class Members:
        def __init__(self, ids, vectors, copies) -> None:
            self.ids, self.copies = _objects(ids), np.asarray(copies, dtype="int64")
            self.units = _unpacked(vectors, len(ids), element)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        visitors = None
        for pdf in batches:
            for chunk, own, vectors, cell, radius, ids, others, copies in pdf.itertuples(index=False, name=None):
                if visitors is None or visitors.chunk != chunk:
                    if visitors is not None:
                        yield visitors.found()
                    visitors = Visitors(chunk, own, vectors)
                visitors.meet(Members(ids, others, copies), pivots[cell:cell + 1], limit + radius)
        if visitors is not None:
            yield visitors.found()

    return run


def _compared(visitors: DataFrame, members: _Members, element: str, threshold: float) -> DataFrame:
    """id, n, best, partner of packed visitors with similar members."""
    id_type = dict(visitors.dtypes)["ids"][len("array<"):-1]
    left = visitors.select("chunk", F.col("ids").alias("own"), "vectors").hint("shuffle_replicate_nl")
    right = members.packs.coalesce(members.parts).select("cell", "radius", "ids", F.col("vectors").alias("others"), "copies")
    found = left.crossJoin(right.hint("shuffle_replicate_nl")).mapInPandas(
        _compare(members.pivots, threshold, element), f"id {id_type}, n bigint, best double, partner {id_type}")
    first = F.min_by("partner", F.when(F.col("best").isNotNull(), F.struct(-F.col("best"), F.col("partner"))))
    return found.groupBy("id").agg(F.sum("n").alias("n"), F.max("best").alias("best"), first.alias("partner"))


def similarity_links(vectors: DataFrame, threshold: float, chunk: int = CHUNK) -> DataFrame:
    """vectors (id, vector) to id, class_id, n_links: one row per vector, whatever its partners.

    Equal vectors are one class, named by its lowest id and compared once. n_links counts the
    vectors, copies included, whose cosine is the threshold (above 0) or more. Null, empty and
    all-zero vectors link to nothing. Vectors find their class by a mark; only those whose mark is
    that of two classes are joined by their whole vectors.
    """
    rows = vectors.select("id", _plain("vector", vectors).alias("vector"))
    some = F.coalesce(F.exists("vector", lambda x: x != 0), F.lit(False))
    usable = rows.filter(some)
    alone = rows.filter(~some).select("id", F.col("id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"))
    classes = usable.groupBy("vector").agg(F.min("id").alias("id"), F.count("*").alias("copies")).select(
        "id", "vector", "copies", _mark("vector").alias("mark"))
    members = _members(classes, usable, chunk)
    if members is None:
        return alone
    found = _compared(members.packs, members, _element(rows), threshold).select("id", "n")
    listed = members.packs.select(F.explode(F.arrays_zip("ids", "copies", "marks")).alias("c")).select(
        F.col("c.ids").alias("id"), F.col("c.copies").alias("copies"), F.col("c.marks").alias("mark"))
    counted = stage(listed.join(found, "id", "left").select(
        "mark", F.col("id").alias("class_id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "links")
    shared = stage(counted.groupBy("mark").count().filter("count > 1").select("mark"), "shared-marks")
    marked = usable.withColumn("mark", _mark("vector"))
    out = ["id", "class_id", "n_links"]
    linked = marked.select("id", "mark").join(counted.join(shared, "mark", "left_anti"), "mark").select(*out)
    if not shared.isEmpty():
        unclear = marked.join(shared, "mark", "left_semi").select("id", "vector")
        named = unclear.groupBy("vector").agg(F.min("id").alias("class_id"))
        linked = linked.unionByName(unclear.join(named, "vector").join(
            counted.join(shared, "mark", "left_semi"), "class_id").select(*out))
    return linked.unionByName(alone)


def _rows_up_to(last, element: str):
    """Packed rows to id, vector of the ids up to `last`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for ids, vectors in zip(pdf["ids"], pdf["vectors"]):
                keep = np.flatnonzero([i <= last for i in ids])
                if len(keep):
                    matrix = np.frombuffer(vectors, dtype=element).reshape(len(ids), -1)[keep]
                    yield pd.DataFrame({"id": _objects(ids)[keep], "vector": list(matrix)})

    return run


def _elect(threshold: float):
    """The leaders among all given rows, in id order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable").reset_index(drop=True)
        units, ids = unit_rows(pdf["vector"]), pdf["id"].to_numpy(dtype=object)
        first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))  # rows of one id are decided as one
        stops = np.append(first[1:], len(ids))
        held = np.zeros(len(ids), dtype=bool)
        leads = np.zeros(len(ids), dtype=bool)
        for start, stop in zip(first, stops):
            if not held[start:stop].any():
                leads[start:stop] = True
                for row in units[start:stop]:
                    held[stop:] |= units[stop:] @ row >= threshold
        return pdf[leads]

    return run


def _undecided(threshold: float, last, element: str):
    """Packed rows beside one packed row of new leaders, less the rows up to `last` and those similar to a leader."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for own, vectors, ids, others in pdf.itertuples(index=False, name=None):
                leaders = _unpacked(others, len(ids), element)
                units = _unpacked(vectors, len(own), element)
                keep = np.array([i > last for i in own])
                for at in range(0, len(units), 512):
                    keep[at:at + 512] &= ~(units[at:at + 512] @ leaders.T >= threshold).any(axis=1)
                if keep.any():
                    matrix = np.frombuffer(vectors, dtype=element).reshape(len(own), -1)[keep]
                    yield pd.DataFrame({"ids": [_objects(own)[keep].tolist()], "vectors": [matrix.tobytes()]})

    return run


def _one_pack(element: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        matrix = np.stack(pdf["vector"].to_numpy()).astype(element)
        return pd.DataFrame({"ids": [pdf["id"].tolist()], "others": [matrix.tobytes()]})

    return run


def fixed_leaders(vectors: DataFrame, threshold: float, chunk: int = CHUNK) -> DataFrame:
    """vectors (id, vector) to id, leader, similarity: fixed-leader clusters in id order.

    A row is a leader iff no earlier leader reaches the threshold (above 0); any other row joins its
    most similar earlier leader. Null and empty vectors lead themselves. In a round one task elects
    leaders among the lowest undecided ids, a bounded number of rows, and rows similar to a new leader
    are decided where they lie; rounds run until none is left. So each row is compared with leaders
    only, and only narrow rows are shuffled after the vectors are packed once.
    """
    id_type = dict(vectors.dtypes)["id"]
    rows = vectors.select("id", _plain("vector", vectors).alias("vector"))
    some = F.coalesce(F.size("vector") > 0, F.lit(False))
    usable, alone = rows.filter(some), rows.filter(~some).select("id")
    element, row_schema = _element(rows), f"id {id_type}, vector {dict(rows.dtypes)['vector']}"
    packs = _visitors(usable, chunk)
    todo, before, leaders = packs.select("ids", "vectors"), None, rows.limit(0)
    while True:
        lowest = todo.select(F.explode("ids").alias("id")).orderBy("id").limit(ELECTED)
        last = lowest.agg(F.max("id")).first()[0]
        if last is None:
            break
        block = todo.mapInPandas(_rows_up_to(last, element), row_schema)
        new = stage(block.groupBy().applyInPandas(_elect(threshold), row_schema), "leaders")
        leaders = leaders.unionByName(new)
        pack = new.groupBy().applyInPandas(_one_pack(element), f"ids array<{id_type}>, others binary")
        beside = todo.select(F.col("ids").alias("own"), "vectors").crossJoin(F.broadcast(pack))
        todo = stage(beside.select("own", "vectors", "ids", "others").mapInPandas(
            _undecided(threshold, last, element), f"ids array<{id_type}>, vectors binary"), "undecided")
        if before is not None:
            discard(before)
        before = todo
    leaders = stage(leaders, "all-leaders")
    itself = leaders.select("id").unionByName(alone).select("id", F.col("id").alias("leader"), F.lit(1.0).alias("similarity"))
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    members = _members(leaders.select("id", "vector", one.alias("copies"), zero.alias("mark")), leaders, chunk)
    if members is None:
        return itself
    found = _compared(packs, members, element, threshold - _ROUNDED).filter("partner is not null")
    return itself.unionByName(found.join(leaders.select("id"), "id", "left_anti").select(
        "id", F.col("partner").alias("leader"), F.col("best").alias("similarity")))
