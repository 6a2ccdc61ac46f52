"""Fill-in-the-middle transformation by a pyarrow.compute pipeline.

A text is cut into units (code points) and two places deal them into prefix, middle and suffix.
The places and the form come from the digits of SHA-256 of `<salt>:<id>`, so they do not depend
on the order or the number of rows, and are computed by Spark's own functions. The rest is one
Arrow pipeline per batch, without a loop over rows:

1. the bytes that start a code point give the units, as list arrays over the text's own bytes,
2. the lists are flattened with the index of their parent, ordinals follow from both,
3. for each role the units are filtered, lists are rebuilt and joined to one piece per text,
4. the pieces and marks are joined in the order of the form.

Long texts are cut into segments of `SEGMENT` bytes whose first ordinals are carried on, and
each pass works on segments of about that size together, so memory per text unit is bounded;
a whole text is held only as its own bytes and its result.

Forms: `psm` is `<P>`prefix`<S>`suffix`<M>`middle, `spm` is `<S>`suffix`<P>`prefix`<M>`middle,
`plain` is the text itself. Texts that are empty or hold a mark are always plain, so `restored`
gets the exact text back from output and form.

Defined results: a null text is empty; a null id counts as the empty string; each repeated row
is transformed and gets the same result; an empty table gives an empty result; further columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of text that one pass takes, and bytes of text that one result batch is made of.
SEGMENT, BATCH_BYTES = 1 << 20, 16 << 20
NOTHING = pa.scalar(b"", pa.large_binary())
_OUT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
                  ("middle_chars", pa.int64()), ("output", pa.binary())])
_DDL = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary"


def cuts(doc_id: Column, n: Column, text: Column, salt: str = "1", plain_from: int = 90,
         spm_below: int = 20) -> list[Column]:
    """Columns form, first_cut, second_cut for an id, a number of units and a text."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h1, h2, h3, h4 = (F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4))
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    form = (F.when((n == 0) | marked | (h3 % 100 >= plain_from), "plain")
            .when(h4 % 100 < spm_below, "spm").otherwise("psm"))
    a, b = h1 % (n + 1), h2 % (n + 1)
    return [form.alias("form"), F.least(a, b).alias("first_cut"), F.greatest(a, b).alias("second_cut")]


def _segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of runs of bytes: whole texts, or runs of long ones cut before a code point."""
    rows, starts, ends = [], [], []
    for k in np.flatnonzero(np.diff(offsets) > SEGMENT).tolist():
        at, end = int(offsets[k]), int(offsets[k + 1])
        while at < end:
            to = min(at + SEGMENT, end)
            while to < end and to > at + 1 and data[to] & 0xC0 == 0x80:
                to -= 1
            rows.append(k)
            starts.append(at)
            ends.append(to)
            at = to
    short = np.flatnonzero(np.diff(offsets) <= SEGMENT)
    row = np.concatenate([short, np.array(rows, np.int64)]).astype(np.int64)
    start = np.concatenate([offsets[short], np.array(starts, np.int64)])
    end = np.concatenate([offsets[short + 1], np.array(ends, np.int64)])
    order = np.argsort(start, kind="stable")
    order = order[np.argsort(row[order], kind="stable")]
    return row[order], start[order], end[order]


def _units(data: pa.Array, bounds: np.ndarray) -> pa.LargeListArray:
    """Runs of bytes, back to back, as lists of their code points."""
    leads = pc.not_equal(pc.bit_wise_and(data, pa.scalar(0xC0, pa.uint8())), pa.scalar(0x80, pa.uint8()))
    starts = pc.indices_nonzero(leads).to_numpy().astype(np.int64)
    heads = bounds[:-1][np.diff(bounds) > 0]
    if len(stray := np.setdiff1d(heads, starts, assume_unique=True)):  # a run that starts inside a code point
        starts = np.union1d(starts, stray)
    ends = pa.py_buffer(np.append(starts, len(data)).astype(np.int64))
    units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, ends, data.buffers()[1]])
    return pa.LargeListArray.from_arrays(pa.array(np.searchsorted(starts, bounds)), units)


def _pieces(lists: pa.LargeListArray, first: np.ndarray, second: np.ndarray) -> list[pa.Array]:
    """Prefix, middle and suffix of each list, cut at the ordinals first and second."""
    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    ordinal = pc.subtract(pa.array(np.arange(len(flat))), pc.take(lists.offsets, parent))
    n = pc.list_value_length(lists).to_numpy()
    a, b = np.clip(first, 0, n), np.clip(second, 0, n)
    role = pc.add(pc.cast(pc.greater_equal(ordinal, pc.take(pa.array(a), parent)), pa.int8()),
                  pc.cast(pc.greater_equal(ordinal, pc.take(pa.array(b), parent)), pa.int8()))
    out = []
    for k, size in enumerate((a, b - a, n - b)):
        offsets = pa.array(np.concatenate([[0], np.cumsum(size)]))
        units = pc.filter(flat, pc.equal(role, pa.scalar(k, pa.int8())))
        out.append(pc.binary_join(pa.LargeListArray.from_arrays(offsets, units), NOTHING))
    return out


def _split(texts: pa.Array, first: np.ndarray, second: np.ndarray) -> list[pa.Array]:
    """Prefix, middle and suffix of each text, in passes over about SEGMENT bytes."""
    texts = texts.cast(pa.large_binary())
    if not len(texts):
        return [texts] * 3
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row, start, end = _segments(data, offsets)
    taken = np.cumsum(end - start)
    parts: list[list[pa.Array]] = [[], [], []]
    at, last, base = 0, -1, 0
    while at < len(row):
        done = taken[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(taken, done + SEGMENT, "right")))
        bounds = np.concatenate([[0], taken[at:to] - done])
        own = pa.array(data[start[at]:end[to - 1]])
        lists = _units(own, bounds)
        shift = np.zeros(to - at, np.int64)
        if row[at] == last:
            shift[0] = base
        for k, piece in enumerate(_pieces(lists, first[row[at:to]] - shift, second[row[at:to]] - shift)):
            parts[k].append(piece)
        n = int(pc.list_value_length(lists)[-1].as_py())
        base = n + (base if row[to - 1] == last and to - 1 == at else 0)
        last, at = row[to - 1], to
    bounds = pa.array(np.searchsorted(row, np.arange(len(texts) + 1)))
    whole = (pa.concat_arrays(p) for p in parts)
    return [pc.binary_join(pa.LargeListArray.from_arrays(bounds, w), NOTHING) for w in whole]


def _batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    doc_id, text, n, form, first, second = batch.columns
    plain, spm = pc.equal(form, "plain"), pc.equal(form, "spm")
    first, second = (pc.if_else(plain, n, c).to_numpy(zero_copy_only=False) for c in (first, second))
    prefix, middle, suffix = _split(text, first, second)

    def mark(name: str, other: str) -> pa.Array:
        lit = [pa.scalar(x.encode(), pa.large_binary()) for x in ("", name, other)]
        return pc.if_else(plain, lit[0], pc.if_else(spm, lit[2], lit[1]))

    output = pc.binary_join_element_wise(
        mark(PREFIX, SUFFIX), pc.if_else(spm, suffix, prefix), mark(SUFFIX, PREFIX), pc.if_else(spm, prefix, suffix),
        mark(MIDDLE, MIDDLE), middle, NOTHING)
    none = pa.scalar(None, pa.int64())
    cut1, cut2 = pa.array(first), pa.array(second)
    return pa.RecordBatch.from_arrays(
        [doc_id, n, form, pc.if_else(plain, none, cut1), pc.if_else(plain, none, pc.subtract(cut2, cut1)),
         output.cast(pa.binary())], schema=_OUT)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends, at = np.cumsum(pc.binary_length(batch.column(1)).to_numpy().astype(np.int64)), 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + BATCH_BYTES, "right")))
            yield _batch(batch.slice(at, to - at))
            at = to


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salt: str = "1",
                   plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """One row per row of docs: doc_id, n, form, prefix_chars, middle_chars, output.

    plain_from: texts whose third number modulo 100 is at least that stay plain; spm_below: of the
    others, those whose fourth number modulo 100 is below that put the suffix first.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = F.char_length("text").cast("long")
    found = rows.select("doc_id", F.col("text").cast("binary").alias("text"), n.alias("n"),
                        *cuts(F.col("doc_id"), n, F.col("text"), salt, plain_from, spm_below))
    return found.mapInArrow(_run, _DDL).withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The exact text, rebuilt from an output and its form."""
    body = F.substring(output, len(PREFIX) + 1, 2 ** 31 - 1)
    psm = F.split(body, f"{SUFFIX}|{MIDDLE}", -1)
    spm = F.split(body, f"{PREFIX}|{MIDDLE}", -1)
    return (F.when(form == "psm", F.concat(psm[0], psm[2], psm[1]))
            .when(form == "spm", F.concat(spm[1], spm[2], spm[0])).otherwise(output))
