"""Reading log folders: file listings and numbered, parsed lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.plans.staging import stage
from logloom.sources.registry import LogFormat
from logloom.sources.variants import decode


def plain_path(uri: Column) -> Column:
    """Path of a file URI, percent-escapes undone."""
    return F.url_decode(F.replace(F.regexp_replace(uri, r"^file:/+", "/"), F.lit("+"), F.lit("%2B")))


def list_files(spark: SparkSession, root: str, fmt: LogFormat) -> DataFrame:
    """(file_path, file_size, file_mtime) of a format's log files; no content is read."""
    found = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", fmt.glob).load(root))
    files = found.select(plain_path(F.col("path")).alias("file_path"),
                         F.col("length").alias("file_size"),
                         F.unix_micros("modificationTime").alias("file_mtime"))
    return files.filter(fmt.wanted(F.col("file_path")))


def read_raw(spark: SparkSession, paths: str | list[str], fmt: LogFormat,
             modified_after: str | None = None) -> DataFrame:
    """Unnumbered lines with the split they come from and their rank inside the task."""
    reader = (spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n")
              .option("pathGlobFilter", fmt.glob))
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    lines = reader.text(paths).select(
        plain_path(F.col("_metadata.file_path")).alias("source_path"),
        F.col("_metadata.file_block_start").alias("split"),
        F.col("_metadata.file_size").alias("file_size"),
        F.monotonically_increasing_id().alias("rank"), "value")
    return lines.filter(fmt.wanted(F.col("source_path")))


def number_lines(staged: DataFrame) -> DataFrame:
    """Replace (split, rank) by the 1-based physical line number.

    Lines of one split sit next to each other in one task, so their rank differences are
    positions. Splits of a file are offset by the line counts of the splits before them:
    one small row per split, however long the file is.
    """
    counts = staged.groupBy("source_path", "split").agg(
        F.count("*").alias("n"), F.min("rank").alias("first"))
    before = Window.partitionBy("source_path").orderBy("split").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = counts.select("source_path", "split", "first",
                            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    joined = staged.join(offsets, ["source_path", "split"])
    line = F.col("offset") + F.col("rank") - F.col("first") + 1
    return joined.withColumn("line_no", line).drop("split", "rank", "first", "offset")


def scan_logs(spark: SparkSession, root: str | list[str], fmt: LogFormat,
              modified_after: str | None = None, only: DataFrame | None = None) -> DataFrame:
    """Parsed, numbered lines of a folder: source_path, line_no, file_size, kind, v.

    The text is read and parsed once and written to the shared folder; ranks are fixed by
    that write, so later passes over the lines cannot disagree about them.
    """
    raw = read_raw(spark, root, fmt, modified_after)
    if only is not None:
        raw = raw.join(only.select(F.col("file_path").alias("source_path")), "source_path", "left_semi")
    return number_lines(stage(decode(raw), "lines"))
