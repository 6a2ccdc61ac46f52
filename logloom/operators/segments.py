"""Ordered computations over groups of any size.

A plain window puts a whole group into one task, so one session with a third of all
rows would stall the job. Here a group is cut into segments of consecutive line
numbers: line numbers are unique, so a segment holds at most SEGMENT_LINES rows. The
windowed work happens inside a segment; one small row per segment carries the
boundary values to the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT_LINES = 1 << 20


def with_segment(df: DataFrame, line: str = "line_no", size: int | None = None) -> DataFrame:
    return df.withColumn("segment", F.floor(F.col(line) / F.lit(size or SEGMENT_LINES)))


def with_neighbours(
    df: DataFrame,
    keys: list[str],
    *,
    previous: dict[str, str] | None = None,
    following: dict[str, str] | None = None,
    position: str | None = None,
    total: str | None = None,
    line: str = "line_no",
    size: int | None = None,
) -> DataFrame:
    """Add values of the previous / following row, the 0-based position and the group size.

    `previous` and `following` map new column names to source columns. Rows of a group
    are ordered by `line`, which must be unique inside the group.
    """
    previous, following = previous or {}, following or {}
    wanted = sorted({*previous.values(), *following.values()})
    cut = with_segment(df, line, size)
    seg_keys = [*keys, "segment"]
    inside = Window.partitionBy(*seg_keys).orderBy(line)
    whole = Window.partitionBy(*keys).orderBy("segment")

    edges = cut.groupBy(*seg_keys).agg(
        F.count("*").alias("_n"),
        F.min_by(F.struct(line, *wanted), line).alias("_first"),
        F.max_by(F.struct(line, *wanted), line).alias("_last"),
    )
    edges = edges.select(
        *[F.col(k).alias(f"_k_{k}") for k in seg_keys],
        F.col("_n"),
        F.lag("_last").over(whole).alias("_before"),
        F.lead("_first").over(whole).alias("_after"),
        F.coalesce(F.sum("_n").over(whole.rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_offset"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias("_total"),
    )

    rows = cut.withColumn("_i", F.row_number().over(inside))
    for name, source in previous.items():
        rows = rows.withColumn(f"_p_{name}", F.lag(source).over(inside))
    for name, source in following.items():
        rows = rows.withColumn(f"_f_{name}", F.lead(source).over(inside))
    on = [F.col(k) == F.col(f"_k_{k}") for k in seg_keys]
    joined = rows.join(edges, on, "left")

    added = {}
    for name, source in previous.items():
        edge = F.col(f"_before.{source}")
        added[name] = F.when(F.col("_i") == 1, edge).otherwise(F.col(f"_p_{name}"))
    for name, source in following.items():
        edge = F.col(f"_after.{source}")
        added[name] = F.when(F.col("_i") == F.col("_n"), edge).otherwise(F.col(f"_f_{name}"))
    if position:
        added[position] = F.col("_offset") + F.col("_i") - 1
    if total:
        added[total] = F.col("_total")
    return joined.select(*df.columns, *[c.alias(n) for n, c in added.items()])


def with_carried(
    df: DataFrame,
    keys: list[str],
    values: dict[str, Column],
    *,
    order: list[str],
    line: str = "line_no",
    size: int | None = None,
) -> DataFrame:
    """Add, per row, the last non-null of each value over the earlier rows of its group.

    Segments after the first get one extra row in front that holds what the earlier
    segments left behind; it takes part in the window and is then removed.
    """
    cut = with_segment(df, line, size)
    seg_keys = [*keys, "segment"]
    at = F.struct(*order)
    for name, value in values.items():
        cut = cut.withColumn(f"_v_{name}", value)

    left = cut.groupBy(*seg_keys).agg(*[
        F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), at)).alias(f"_v_{n}")
        for n in values
    ])
    earlier = Window.partitionBy(*keys).orderBy("segment").rowsBetween(
        Window.unboundedPreceding, -1)
    carry = left.select(*seg_keys, *[
        F.last(f"_v_{n}", ignorenulls=True).over(earlier).alias(f"_v_{n}") for n in values
    ])
    some = F.lit(False)
    for n in values:
        some = some | F.col(f"_v_{n}").isNotNull()
    carry = carry.filter(some).withColumn("_carry", F.lit(True))

    both = cut.withColumn("_carry", F.lit(False)).unionByName(carry, allowMissingColumns=True)
    before = Window.partitionBy(*seg_keys).orderBy(
        F.col("_carry").desc(), *order).rowsBetween(Window.unboundedPreceding, -1)
    done = both.select("*", *[
        F.last(f"_v_{n}", ignorenulls=True).over(before).alias(n) for n in values
    ])
    return done.filter(~F.col("_carry")).select(*df.columns, *values)
