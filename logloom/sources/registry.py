"""Log formats by name; further formats register themselves."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.sources.format_a import Normalized, normalize_a
from logloom.sources.format_b import convert_b, finish_b, normalize_b


@dataclass(frozen=True)
class LogFormat:
    """How to find a format's files and turn their lines into messages."""

    name: str
    glob: str
    wanted: Callable[[Column], Column]
    normalize: Callable[[DataFrame], Normalized]
    reports_file_size: bool = True
    #: For files that are read on from a byte: messages and facts line by line, and what is left to do
    #: with all messages of a file. Without them a changed file is read whole.
    convert: Callable[[DataFrame], Normalized] | None = None
    finish: Callable[[DataFrame, DataFrame | None], tuple[DataFrame, DataFrame | None]] | None = None


_formats: dict[str, LogFormat] = {}


def register_format(fmt: LogFormat) -> LogFormat:
    _formats[fmt.name] = fmt
    return fmt


def log_format(name: str) -> LogFormat:
    if name not in _formats:
        raise ValueError(f"unknown log format {name!r}; known: {', '.join(sorted(_formats))}")
    return _formats[name]


def format_names() -> list[str]:
    return sorted(_formats)


def _session_file(path: Column) -> Column:
    return ~path.contains("/subagents/") & ~path.rlike(r"/history\.jsonl\z")


def as_they_are(messages: DataFrame, facts: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """The finish of formats whose lines need no others."""
    return messages, None


register_format(LogFormat("format_a", "*.jsonl", _session_file, normalize_a, convert=normalize_a, finish=as_they_are))
register_format(LogFormat("format_b", "rollout-*.jsonl", lambda path: F.lit(True), normalize_b,
                          reports_file_size=False, convert=convert_b, finish=finish_b))
