"""Exact mean, median and nearest-rank percentiles over any number of rows.

The built-in exact percentile keeps every distinct value in one aggregation buffer. Here each
wanted rank has an open bracket of values. In a round a mergeable sketch proposes two cuts around
the rank, and exact counts below, at, between and above the cuts tell which part the rank is in.
A rank at a cut is settled; else the part is its next bracket, a few thousandths of the last one.
All is combinable aggregation: no window, no sort, and the driver holds three brackets a measure.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.plans.staging import stage

ACCURACY = 10_000
#: Cuts lie so many sketch errors around the rank.
ERRORS = 2


def _propose(inside: DataFrame, brackets: list[tuple], accuracy: int) -> dict[int, tuple[float, float]]:
    """Two cuts around the rank of each bracket; the shares of a sketch are constants, so each has its own."""
    wanted: dict[tuple, list[int]] = {}
    for t, (_, _, k, n) in enumerate(brackets):
        q = (k - 0.5) / n
        wanted.setdefault((max(0.0, q - ERRORS / accuracy), min(1.0, q + ERRORS / accuracy)), []).append(t)
    sketches = [F.percentile_approx(F.when(F.col("t").isin(ts), F.col("x")), list(q), accuracy).alias(f"q{i}")
                for i, (q, ts) in enumerate(wanted.items())]
    found = inside.groupBy("t").agg(*sketches).collect()
    return {row["t"]: tuple(cut) for row in found for cut in row[1:] if cut is not None}


def summarize(values: DataFrame, measure: str = "measure", value: str = "value",
              p: float = 0.9, accuracy: int = ACCURACY) -> DataFrame:
    """(measure, n, mean, median, p90) over the non-null values of a long table.

    Measures are names of columns, a short list; the result has one row for each.
    """
    spark, kind = values.sparkSession, dict(values.dtypes)[measure]
    rows = values.select(F.col(measure).alias("m"), F.col(value).cast("double").alias("x")).filter(
        "x IS NOT NULL AND m IS NOT NULL")
    base = rows.groupBy("m").agg(F.count("*").alias("n"), F.avg("x").alias("mean")).collect()

    def ranks(n: int) -> tuple[int, int, int]:
        return (n + 1) // 2, (n + 2) // 2, max(math.ceil(p * n), 1)

    # (measure, rank) to its open bracket (low, high), the place of the rank in it and the rows in it
    todo = {(m, k): (None, None, k, n) for m, n, _ in base for k in ranks(n)}
    settled: dict[tuple, float] = {}
    first = True
    while todo:
        names, brackets = list(todo), list(todo.values())
        frame = spark.createDataFrame([(t, m, low, high) for t, ((m, _), (low, high, _, _)) in enumerate(zip(names, brackets))],
                                      f"t int, m {kind}, low double, high double")
        # three rows a measure
        inside = rows.join(F.broadcast(frame), "m").filter(
            "(low IS NULL OR x > low) AND (high IS NULL OR x < high)").select("t", "x")
        if not first:  # a small part of the rows, read by a sketch and by counts
            inside = stage(inside, "inside")
        cuts = _propose(inside, brackets, accuracy)
        marks = F.broadcast(spark.createDataFrame([(t, *c) for t, c in cuts.items()], "t int, c double, d double"))
        counts = inside.join(marks, "t").groupBy("t").agg(
            *[F.count_if(F.expr(part)) for part in ("x < c", "x = c", "x > c AND x < d", "x = d AND d > c", "x > d")]).collect()
        todo = {}
        for t, below, at_c, between, at_d, above in counts:
            (low, high, k, _), (c, d) = brackets[t], cuts[t]
            if k <= below:
                todo[names[t]] = (low, c, k, below)
            elif k <= below + at_c:
                settled[names[t]] = c
            elif k <= below + at_c + between:
                todo[names[t]] = (c, d, k - below - at_c, between)
            elif k <= below + at_c + between + at_d:
                settled[names[t]] = d
            else:
                todo[names[t]] = (d, high, k - below - at_c - between - at_d, above)
        first = False
    out = []
    for m, n, mean in base:
        low, high, tail = (settled[m, k] for k in ranks(n))
        out.append((m, n, mean, (low + high) / 2, tail))
    return spark.createDataFrame(out, f"{measure} {kind}, n bigint, mean double, median double, p90 double")
