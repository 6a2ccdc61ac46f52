"""Time functions. Instants are epoch microseconds (BIGINT) unless said otherwise."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
DAY = 86_400 * SECOND
NIGHT_START = 1 * 3_600 * SECOND
NIGHT_LENGTH = 8 * 3_600 * SECOND

# Report windows by name, in days back.
WINDOW_DAYS = {"1d": 1, "3d": 3, "7d": 7, "14d": 14, "30d": 30, "90d": 90}


def iso_micros(text: Column) -> Column:
    """Lenient ISO-8601 parse; no zone means UTC; null when it is no timestamp."""
    t = F.trim(text)
    has_zone = t.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    zoned = F.when(has_zone, t).when(F.length(t) <= 10, F.concat(t, F.lit("T00:00:00Z"))).otherwise(
        F.concat(t, F.lit("Z")))
    return F.unix_micros(F.try_to_timestamp(F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), zoned)))


def ntz_micros(ts: Column) -> Column:
    """Micros of a zone-less timestamp read as UTC, whatever the session zone."""
    at = ts.cast("timestamp_ntz")
    days = F.datediff(at.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    minutes = (F.hour(at) * 60 + F.minute(at)).cast("bigint")
    micros = (F.date_part(F.lit("SECOND"), at) * SECOND).cast("bigint")
    return days * F.lit(DAY) + minutes * F.lit(60 * SECOND) + micros


def micros_date(us: Column) -> Column:
    """UTC calendar date of an instant, whatever the session zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(us / F.lit(DAY)).cast("int"))


def iso_text(us: Column) -> Column:
    """UTC ISO text, second precision plus micros when there are any."""
    secs = F.floor(us / SECOND)
    micros = F.pmod(us, F.lit(SECOND))
    sod = F.pmod(secs, F.lit(86_400))
    clock = F.format_string(
        "%02d:%02d:%02d", F.floor(sod / 3600), F.floor(F.pmod(sod, F.lit(3600)) / 60),
        F.pmod(sod, F.lit(60)))
    frac = F.when(micros > 0, F.format_string(".%06d", micros)).otherwise(F.lit(""))
    return F.concat(micros_date(us).cast("string"), F.lit("T"), clock, frac, F.lit("+00:00"))


def zone_offset(us: Column, tz: str) -> Column:
    """Micros to add to an instant to get local clock time in `tz`."""
    if tz.upper() == "UTC":
        return F.lit(0).cast("bigint")
    instant = F.timestamp_micros(us)
    local = F.convert_timezone(F.lit("UTC"), F.lit(tz), F.convert_timezone(
        F.current_timezone(), F.lit("UTC"), instant.cast("timestamp_ntz")))
    return ntz_micros(local) - us


def _night_before(local: Column) -> Column:
    days = F.floor(local / F.lit(DAY))
    into = F.least(F.greatest(F.pmod(local, F.lit(DAY)) - NIGHT_START, F.lit(0)),
                   F.lit(NIGHT_LENGTH))
    return days * F.lit(NIGHT_LENGTH) + into


def night_micros(start_us: Column, span_us: Column, tz: str = "UTC") -> Column:
    """Micros of [start, start + span) on the local clock in [01:00, 09:00)."""
    local = start_us + zone_offset(start_us, tz)
    span = F.greatest(span_us, F.lit(0))
    return _night_before(local + span) - _night_before(local)


def period_key(day: Column, interval: str = "day") -> Column:
    """ISO date, or ISO year and week such as 2024-W01."""
    if interval == "day":
        return day.cast("string")
    if interval != "week":
        raise ValueError("interval must be one of: day, week")
    year = F.date_part(F.lit("YEAROFWEEK"), day).cast("string")
    return F.concat(year, F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def parse_day(text: str) -> date:
    return date.fromisoformat(text)


def resolve_range(start: str | None, end: str | None, *, today: date | None = None,
                  days: int = 7) -> tuple[str, str]:
    """Inclusive window; the last `days` days incl. today by default; rejects bad input."""
    today = today or datetime.now(timezone.utc).date()
    last = parse_day(end) if end else today
    first = parse_day(start) if start else last - timedelta(days=days - 1)
    if first > last:
        raise ValueError("start date must not be after end date")
    return first.isoformat(), last.isoformat()


def window_bounds(start: str, end: str, tz: str = "UTC") -> tuple[int, int]:
    """[start, end + 1 day) in micros, on the local calendar of `tz`."""
    from zoneinfo import ZoneInfo

    zone = timezone.utc if tz.upper() == "UTC" else ZoneInfo(tz)
    epoch = datetime(1970, 1, 1, tzinfo=timezone.utc)

    def micros(day: date) -> int:
        at = datetime(day.year, day.month, day.day, tzinfo=zone)
        return (at - epoch) // timedelta(microseconds=1)

    return micros(parse_day(start)), micros(parse_day(end) + timedelta(days=1))


def window_since(window: str, *, now: datetime, last_success: str | None = None,
                 days: int | None = None) -> tuple[int | None, bool]:
    """(lower bound in micros or None, is a manual window) for a named report window."""
    def micros(at: datetime) -> int:
        at = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
        return (at - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)

    name = window.strip().lower()
    if days is None and name == "auto":
        return (micros(datetime.fromisoformat(last_success)) if last_success else None), False
    if days is None and name == "all":
        return None, True
    back = days if days is not None else WINDOW_DAYS.get(name)
    if back is None:
        raise ValueError(f"unknown window: {window}")
    return micros(now - timedelta(days=back)), True
