"""Typed access to JSON values held as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.functions.text import non_blank, spaced_json, strip


def let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def get(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def kind_of(v: Column, path: str) -> Column:
    """Type name of a value that is known to be small."""
    return F.schema_of_variant(get(v, path))


def string(v: Column, path: str) -> Column:
    """The value if it is a JSON string; numbers and objects give null."""
    return F.when(kind_of(v, path) == "STRING", get(v, path, "string"))


def text_of(x: Column) -> Column:
    """The `text` member of a block."""
    return string(x, "$.text")


def boolean(v: Column, path: str) -> Column:
    return F.when(kind_of(v, path) == "BOOLEAN", get(v, path, "boolean"))


def fields(v: Column, path: str) -> Column:
    """Map of an object's members, null for anything else."""
    return get(v, path, "map<string,variant>")


def items(v: Column, path: str) -> Column:
    return get(v, path, "array<variant>")


def whole_number(v: Column, path: str) -> Column:
    """Integers, booleans and digit strings as BIGINT; anything else, floats included, is null."""
    kind, text = kind_of(v, path), get(v, path, "string")
    return (
        F.when(kind == "BOOLEAN", get(v, path, "boolean").cast("bigint"))
        .when(kind == "BIGINT", get(v, path, "bigint"))
        .when((kind == "STRING") & text.rlike(r"^\s*-*[0-9]+\s*$"), F.trim(text).try_cast("bigint"))
    )


def integer(v: Column, path: str) -> Column:
    """JSON integers (and booleans) only."""
    kind = kind_of(v, path)
    return (F.when(kind == "BIGINT", get(v, path, "bigint"))
            .when(kind == "BOOLEAN", get(v, path, "boolean").cast("bigint")))


def first_text(v: Column, paths: list[str]) -> Column:
    """First non-blank string among several places, stripped."""
    return F.coalesce(*[non_blank(string(v, p)) for p in paths])


def dumped(v: Column, path: str = "$") -> Column:
    """JSON text with a blank after commas and colons."""
    return spaced_json(F.to_json(get(v, path)))


def timestamp_or_line(v: Column, line: Column) -> tuple[Column, Column]:
    """(timestamp text, was it missing): a missing one falls back to a 1970 second by line."""
    text = string(v, "$.timestamp")
    fallback = F.format_string("1970-01-01T00:00:%02dZ", line % 60)
    has = F.length(text) > 0
    return F.when(has, text).otherwise(fallback), ~F.coalesce(has, F.lit(False))


# Limits of stored tool output.
MAX_TEXT_CHARS = 12_000
MAX_JSON_BYTES = 24_000
MAX_ITEMS = 200
PREVIEW_CHARS = 1_000


def reference_of(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.substring(F.sha2(text, 256), 1, 16))


OUTPUT = "struct<text: string, plain: string, chars: bigint>"


def _bounded_text(raw: Column) -> Column:
    """Plain output: itself, or a preview plus a note about what was cut off."""
    def parts(text: Column) -> Column:
        note = spaced_json(F.to_json(F.struct(
            F.lit("truncation_meta").alias("type"),
            reference_of(F.to_json(raw)).alias("raw_ref"),
            F.length(text).alias("original_chars"), F.lit(True).alias("truncated"))))
        cut = F.substring(text, 1, MAX_TEXT_CHARS)
        return F.when(
            F.length(text) <= MAX_TEXT_CHARS, F.struct(text, text, F.length(text)).cast(OUTPUT)
        ).otherwise(F.struct(F.concat(cut, F.lit("\n"), note), F.lit(None), F.length(cut)).cast(OUTPUT))

    return let(get(raw, "$", "string"), parts)


def _bounded_list(raw: Column, one: Column) -> Column:
    """Structured output as blocks: their texts, or a summary when they are too large."""
    def piece(x: Column) -> Column:
        def wrap(text: Column) -> Column:
            wrapped = F.concat(F.lit('{"type": "value", "value": '), text, F.lit("}"))
            return F.when(text.startswith("{"), text).otherwise(wrapped)

        return let(F.coalesce(dumped(x), F.lit("null")), lambda js: F.struct(
            wrap(js).alias("js"), text_of(x).alias("t")))

    def parts(ps: Column) -> Column:
        whole = F.concat(F.lit("["), F.array_join(F.transform(ps, lambda q: q["js"]), ", "), F.lit("]"))
        texts = F.array_join(F.transform(ps, lambda q: F.coalesce(q["t"], q["js"])), "\n")
        chars = F.aggregate(ps, F.lit(0).cast("bigint"), lambda a, q: a + F.coalesce(
            F.length(q["t"]), F.lit(0)).cast("bigint"))

        def bound(serialized: Column) -> Column:
            summary = spaced_json(F.to_json(F.struct(
                F.lit("structured_summary").alias("type"), reference_of(dumped(raw)).alias("raw_ref"),
                F.octet_length(serialized).alias("original_bytes"), F.size(ps).alias("item_count"),
                F.lit(True).alias("truncated"),
                F.substring(serialized, 1, PREVIEW_CHARS).alias("preview"))))
            small = (F.octet_length(serialized) <= MAX_JSON_BYTES) & (F.size(ps) <= MAX_ITEMS)
            return F.when(small, F.struct(texts, F.lit(None), chars).cast(OUTPUT)).otherwise(
                F.struct(summary, F.lit(None), F.lit(0)).cast(OUTPUT))

        return let(whole, bound)

    return let(F.transform(one, piece), parts)


def bounded_output(v: Column, path: str = "$") -> Column:
    """struct(text, plain, chars) of tool output held as a JSON value.

    `text` is what error rules and character counts see, `plain` the output if it stays a
    plain string, `chars` the length of its text parts.
    """
    def parts(raw: Column) -> Column:
        def by_kind(listed: Column) -> Column:
            return (F.when(listed.isNotNull(), _bounded_list(raw, listed))
                    .when(kind_of(raw, "$") == "STRING", _bounded_text(raw))
                    .otherwise(_bounded_list(raw, F.array(raw))))

        return let(items(raw, "$"), by_kind)

    return let(get(v, path), parts)


def decode(lines):
    """Parse `value` once: adds `v` and `kind` (blank / bad / object / other)."""
    text = strip(F.col("value"))
    parsed = lines.withColumn("v", F.try_parse_json(text))
    kind = (F.when(F.length(text) == 0, F.lit("blank"))
            .when(F.col("v").isNull(), F.lit("bad"))
            .when(text.startswith("{"), F.lit("object")).otherwise(F.lit("other")))
    return parsed.withColumn("kind", kind).drop("value")
