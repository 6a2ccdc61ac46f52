"""Filters, views, lists and lookups over the sessions table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.dates import iso_micros, parse_day
from logloom.functions.text import strip

S = "session_id"


def date_range(col: Column, start: str | None, end: str | None) -> Column:
    """Inclusive range on a DATE column, so a table laid out by that date is pruned."""
    test = F.lit(True)
    if start:
        test = test & (col >= F.lit(parse_day(start)))
    if end:
        test = test & (col <= F.lit(parse_day(end)))
    return test


def created_day() -> Column:
    return F.to_date(F.substring("created_at", 1, 10))


def filter_sessions(
    sessions: DataFrame, *, start_date: str | None = None, end_date: str | None = None,
    ecosystem: str | None = None, bottleneck: str | None = None,
    min_tokens: int | None = None, max_tokens: int | None = None,
    min_messages: int | None = None, max_messages: int | None = None,
    min_automation: float | None = None, max_automation: float | None = None,
) -> DataFrame:
    """Conjunctive filter; null counts compare as 0, a null automation ratio never matches."""
    day = F.col("created_date") if "created_date" in sessions.columns else created_day()
    test = date_range(day, start_date, end_date)
    if ecosystem and ecosystem != "all":
        test = test & (F.col("ecosystem") == ecosystem)
    if bottleneck:
        test = test & (F.lower(F.coalesce("bottleneck", F.lit(""))) == bottleneck.strip().lower())
    for name, low, high in (("total_tokens", min_tokens, max_tokens),
                            ("total_messages", min_messages, max_messages)):
        value = F.coalesce(name, F.lit(0))
        test = test & (value >= low) if low is not None else test
        test = test & (value <= high) if high is not None else test
    if min_automation is not None:
        test = test & (F.col("automation_ratio") >= min_automation)
    if max_automation is not None:
        test = test & (F.col("automation_ratio") <= max_automation)
    return sessions.filter(test)


def logical_id() -> Column:
    return F.coalesce("logical_session_id", S)


def logical_view(sessions: DataFrame) -> DataFrame:
    """One row per (ecosystem, logical id): the root, else the latest created.

    An aggregation, not a window: rows of one lineage combine before the shuffle, so a
    lineage of any size is no hot task.
    """
    rank = F.struct(F.col(S).eqNullSafe(logical_id()).alias("root"), F.col("created_us"),
                    F.col(S).alias("id"))
    best = sessions.groupBy("ecosystem", logical_id().alias("_logical")).agg(
        F.max_by(F.struct(*sessions.columns), rank).alias("r"))
    return best.select("r.*")


# Names of sort keys and what they sort by.
SORT_KEYS = {
    "created_at": "created_at", "created": "created_at",
    "updated_at": "coalesce(updated_at, created_at)", "updated": "coalesce(updated_at, created_at)",
    "parsed_at": "parsed_at",
    "total_tokens": "total_tokens", "tokens": "total_tokens",
    "duration_seconds": "duration_seconds", "duration": "duration_seconds",
    "total_messages": "total_messages", "messages": "total_messages",
    "automation_ratio": "automation_ratio", "automation": "automation_ratio",
    "session_id": "session_id",
}


def list_sessions(
    sessions: DataFrame, *, sort_by: str = "created_at", sort_order: str = "DESC",
    limit: int = 200, offset: int = 0, view_mode: str = "physical", **filters,
) -> DataFrame:
    """One page of the session list. Nulls sort as the smallest value.

    In the logical view the kept row of a lineage is its root (else the first in the
    requested order) and it stands where the first member of the lineage stands.
    """
    rows = filter_sessions(sessions, **filters)
    up = sort_order.upper() == "ASC"
    by = SORT_KEYS.get(sort_by, "created_at")
    never_parsed = by == "parsed_at" and "parsed_at" not in sessions.columns
    key = F.struct((F.lit(None).cast("string") if never_parsed else F.expr(by)).alias("k"), F.col(S).alias("id"))
    if view_mode == "logical":
        root = F.col(S).eqNullSafe(logical_id())
        row, first = F.struct(*sessions.columns), F.min(key) if up else F.max(key)
        kept = (F.min_by(row, F.struct((~root).alias("r"), key.alias("k"))) if up
                else F.max_by(row, F.struct(root.alias("r"), key.alias("k"))))
        rows = rows.groupBy(logical_id().alias("_logical")).agg(
            kept.alias("r"), first.alias("_place")).select("r.*", "_place")
    else:
        rows = rows.withColumn("_place", key)
    order = F.col("_place").asc_nulls_first() if up else F.col("_place").desc_nulls_last()
    return rows.orderBy(order).offset(offset).limit(limit).drop("_place")


def count_sessions(sessions: DataFrame, *, view_mode: str = "physical", **filters) -> DataFrame:
    rows = filter_sessions(sessions, **filters)
    if view_mode == "logical":
        rows = rows.select(logical_id().alias("_logical")).distinct()
    return rows.agg(F.count("*").alias("sessions"))


def session_page(sessions: DataFrame, *, page: int = 1, page_size: int = 50, **query) -> tuple:
    """(page frame, one-row frame of the total and the number of pages)."""
    if page < 1 or not 1 <= page_size <= 200:
        raise ValueError("page starts at 1 and page_size lies in 1..200")
    rows = list_sessions(sessions, limit=page_size, offset=(page - 1) * page_size, **query)
    counted = {k: v for k, v in query.items() if k not in ("sort_by", "sort_order")}
    total = count_sessions(sessions, **counted).withColumn(
        "pages", F.ceil(F.col("sessions") / page_size))
    return rows, total


@dataclass
class BrowseFilters:
    """Free-form filters of the session browser."""

    search: str = ""
    bottleneck: str = "all"
    ecosystem: str = "all"
    tokens: tuple = (None, None)
    messages: tuple = (None, None)
    automation: tuple = (None, None)
    automation_band: str = "all"
    sort_by: str = "updated"
    descending: bool = True


# Automation bands of the browser; both ends belong to a band.
AUTOMATION_BANDS = {"low": (0, 1), "medium": (1, 3), "high": (3, None)}


def ordered_range(low, high) -> tuple:
    """Finite bounds in ascending order."""
    from math import isfinite

    low, high = (None if v is None or not isfinite(v) else v for v in (low, high))
    return (high, low) if None not in (low, high) and low > high else (low, high)


def automation_range(band: str, low, high) -> tuple:
    """Manual range narrowed by a band."""
    pairs = [ordered_range(low, high), AUTOMATION_BANDS.get(band, (None, None))]
    lows = [a for a, _ in pairs if a is not None]
    highs = [b for _, b in pairs if b is not None]
    return ordered_range(max(lows, default=None), min(highs, default=None))


def browse_sessions(sessions: DataFrame, f: BrowseFilters) -> DataFrame:
    """Search, filter and sort; ties follow creation time, then id."""
    test = F.lit(True)
    words = f.search.strip().lower()
    if words:
        hit = [F.lower(F.coalesce(c, F.lit(""))).contains(words) for c in ("project_path", S)]
        test = test & (hit[0] | hit[1])
    if f.bottleneck != "all":
        test = test & (F.lower(strip(F.coalesce("bottleneck", F.lit("")))) == f.bottleneck)
    if f.ecosystem != "all":
        test = test & (F.col("ecosystem") == f.ecosystem)
    bounds = (("total_tokens", ordered_range(*f.tokens)),
              ("total_messages", ordered_range(*f.messages)),
              ("automation_ratio", automation_range(f.automation_band, *f.automation)))
    for name, (low, high) in bounds:
        test = test & (F.col(name) >= low) if low is not None else test
        test = test & (F.col(name) <= high) if high is not None else test
    touched = F.when(F.length("updated_at") > 0, F.col("updated_at")).otherwise(F.col("created_at"))
    keys = {
        "updated": iso_micros(touched), "created": iso_micros(F.col("created_at")),
        "tokens": F.coalesce("total_tokens", F.lit(0)),
        "duration": F.coalesce("duration_seconds", F.lit(0)),
        "automation": F.coalesce("automation_ratio", F.lit(0)),
        "messages": F.coalesce("total_messages", F.lit(0)),
    }
    order = [keys.get(f.sort_by, F.lit(0)), iso_micros(F.col("created_at"))]
    order = [c.desc() if f.descending else c.asc() for c in order]
    return sessions.filter(test).orderBy(*order, S)


def main_stream(messages: DataFrame) -> DataFrame:
    return messages.filter(~F.coalesce("is_sidechain", F.lit(False)))


def side_chain(messages: DataFrame) -> DataFrame:
    return messages.filter(F.coalesce("is_sidechain", F.lit(False)))


def messages_of_type(messages: DataFrame, record_type: str) -> DataFrame:
    return messages.filter(F.col("record_type") == record_type)


def lookup(table: DataFrame, session_id: str) -> DataFrame:
    return table.filter(F.col(S) == session_id)


def source_of(sessions: DataFrame, tracked: DataFrame, session_id: str) -> DataFrame:
    """Tracked file behind a session."""
    one = sessions.filter(F.col(S) == session_id).select(S, F.col("source_path").alias("file_path"))
    return one.join(tracked, "file_path")


def with_statistics(sessions: DataFrame, stats: DataFrame) -> DataFrame:
    """sessions left join statistics; columns both have are taken from sessions."""
    extra = [c for c in stats.columns if c == S or c not in sessions.columns]
    return sessions.join(stats.select(*extra), S, "left")


def statistics_for(stats: DataFrame, ids: DataFrame) -> DataFrame:
    return stats.join(ids.select(S), S, "left_semi")


def analytics_rows(sessions: DataFrame, stats: DataFrame, start: str | None = None,
                   end: str | None = None, ecosystem: str | None = None) -> DataFrame:
    """Filter, reduce to logical sessions, then attach the statistics of the survivors."""
    rows = filter_sessions(sessions, start_date=start, end_date=end, ecosystem=ecosystem)
    return with_statistics(logical_view(rows), stats)


def session_totals(sessions: DataFrame) -> DataFrame:
    return sessions.agg(
        F.count("*").alias("sessions"),
        F.sum(F.coalesce("total_messages", F.lit(0))).alias("total_messages"),
        F.sum(F.coalesce("total_tokens", F.lit(0))).alias("total_tokens"))


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()


def distinct_count(df: DataFrame, column: str, approximate: bool = False) -> DataFrame:
    f = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(f(column).alias("values"))
