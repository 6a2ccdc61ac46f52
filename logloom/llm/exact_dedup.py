"""Exact dedup by skew-safe combining.

Texts are equal when identical after deleting blanks. Equal texts are combined in three
steps, and each step groups by the digest *and* the whole normalised text, so a digest
collision never merges two texts:

1. each map task combines its own rows (the partial aggregation),
2. rows of a digest meet per salt, where the salt comes from the map task, so a group of
   copies of any size is spread over `salts` reducers and sends one row per map task,
3. the winners of the salts are combined.

The narrow class table is joined to the rows by SHA-256 of the text. Should two classes share
an identity (never seen for SHA-256, forced in the tests), their rows are joined by full text.

Defined results: a null text counts as empty; a null id loses to every other id; among rows
alike in id and length one row stays; an empty table gives an empty result; further columns
are ignored by `exact_classes` and `exact_verdicts` and returned as they are by `keep_one`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.shared import without_blanks
from logloom.plans.staging import stage


def sha256(norm: Column) -> Column:
    return F.sha2(norm, 256)


def _rows(docs: DataFrame, id_col: str, text_col: str, identity: Callable[[Column], Column]) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), without_blanks(F.col(text_col)).alias("norm"),
                        F.char_length(text).cast("long").alias("n_chars"))
            .withColumn("identity", identity(F.col("norm"))))


def exact_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64,
                  digest: Callable[[Column], Column] = F.xxhash64,
                  identity: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per distinct text: norm, identity, keep_id, keep_chars, group_size.

    The row with the most code points wins, then the smallest id. Both are put in one decimal,
    so the aggregation keeps fixed-width buffers and needs no sort.
    """
    place = F.expr("cast(n_chars as decimal(10,0)) * 18446744073709551616BD"
                   " - coalesce(cast(doc_id as decimal(20,0)), 9223372036854775808BD)")
    rows = (_rows(docs, id_col, text_col, identity)
            .select("doc_id", "norm", "n_chars", place.alias("place"), digest(F.col("norm")).alias("digest"),
                    F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt")))
    salted = rows.groupBy("digest", "salt", "norm").agg(
        F.max_by("doc_id", "place").alias("doc_id"), F.max("n_chars").alias("n_chars"),
        F.max("place").alias("place"), F.count(F.lit(1)).alias("n"))
    return (salted.groupBy("digest", "norm").agg(
        F.max_by("doc_id", "place").alias("keep_id"), F.max("n_chars").alias("keep_chars"),
        F.sum("n").alias("group_size"))
        .select("norm", identity(F.col("norm")).alias("identity"), "keep_id", "keep_chars", "group_size"))


def _class_table(docs: DataFrame, id_col: str, text_col: str, **options) -> tuple[DataFrame, DataFrame]:
    """The staged narrow classes, and those identities that more than one class has."""
    classes = stage(exact_classes(docs, id_col, text_col, **options).drop("norm"), "exact-classes")
    shared = classes.groupBy("identity").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("identity")
    return classes, shared


def _attach(rows: DataFrame, docs: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    """Join each row (with norm, identity) to its class; on full text where an identity is not unique."""
    classes, shared = _class_table(docs, id_col, text_col, **options)
    shared = stage(shared, "exact-shared")
    if shared.isEmpty():
        return rows.join(classes, "identity")
    alone = rows.join(shared, "identity", "left_anti").join(classes, "identity")
    texts = exact_classes(docs, id_col, text_col, **options).join(shared, "identity", "left_semi")
    return alone.unionByName(rows.join(shared, "identity", "left_semi").join(texts, ["identity", "norm"]))


def exact_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    identity = options.get("identity", sha256)
    rows = _rows(docs, id_col, text_col, identity).withColumn("text_sha256", sha256(F.col("norm")))
    found = _attach(rows, docs, id_col, text_col, **options).select(
        "doc_id", "keep_id", "group_size", "text_sha256", "n_chars",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars"))).alias("won"))
    found = stage(found.withColumn("row", F.monotonically_increasing_id()), "exact-verdicts")
    first = (found.filter("won").groupBy("text_sha256").agg(F.min("row").alias("first"))
             .withColumnRenamed("text_sha256", "sha"))
    return (found.join(first, (F.col("row") == F.col("first")) & (F.col("text_sha256") == F.col("sha")), "left")
            .select("doc_id", "keep_id", "group_size", F.col("first").isNotNull().alias("kept"), "text_sha256"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that stay, with all their columns.

    Winners are settled on ids, lengths and digests; whole rows are then joined to them on all three, so
    the copies of a text meet in no common key. Only rows that won are ranked by the window, so its
    groups hold repeats of one id and text.
    """
    identity = options.get("identity", sha256)
    norm = without_blanks(F.col(text_col))
    whole = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"),
                        F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_chars"),
                        identity(norm).alias("identity"))
    classes, shared = _class_table(docs, id_col, text_col, **options)
    if stage(shared, "exact-shared").isEmpty():
        heads = classes.select(F.col("identity").alias("own"), "keep_id", "keep_chars")
        found = whole.join(heads, (F.col("identity") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
                           & (F.col("n_chars") == F.col("keep_chars"))).withColumn("text_sha", F.lit(""))
    else:
        rows = whole.withColumn("norm", without_blanks(F.col(f"row.`{text_col}`")))
        found = _attach(rows, docs, id_col, text_col, **options).filter(
            F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars"))).withColumn(
            "text_sha", sha256(F.col("norm")))
    order = Window.partitionBy("identity", "text_sha").orderBy(F.monotonically_increasing_id())
    return found.withColumn("nth", F.row_number().over(order)).filter("nth = 1").select("row.*")
