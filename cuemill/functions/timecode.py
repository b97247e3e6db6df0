"""Times, dates, durations and sizes. Durations are BIGINT milliseconds; `as_of` is always given, never the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hms_to_ms(s: Column) -> Column:
    """HH:MM:SS[,mmm] to milliseconds; null if it is none."""
    pattern = r"^(\d+):(\d{2}):(\d{2})(?:[,.](\d{3}))?$"
    part = lambda i: F.regexp_extract(s, pattern, i)
    whole = (part(1).try_cast("bigint") * 3600 + part(2).try_cast("bigint") * 60 + part(3).try_cast("bigint")) * 1000
    return F.when(s.rlike(pattern), whole + F.coalesce(part(4).try_cast("bigint"), F.lit(0)))


def _clock(ms: Column) -> list[Column]:
    sec = F.floor(F.greatest(ms, F.lit(0)) / 1000)
    return [F.floor(sec / 3600), F.floor(sec / 60) % 60, sec % 60]


def ms_to_hms(ms: Column) -> Column:
    """HH:MM:SS, floored, never below zero."""
    return F.format_string("%02d:%02d:%02d", *_clock(ms))


def ms_to_srt(ms: Column) -> Column:
    """HH:MM:SS,mmm."""
    return F.format_string("%02d:%02d:%02d,%03d", *_clock(ms), F.greatest(ms, F.lit(0)) % 1000)


def duration_to_sec(x: Column) -> Column:
    """Seconds of S, M:SS or H:MM:SS; anything else is 0."""
    parts = F.split(F.trim(x), ":")
    n = lambda i: F.get(parts, F.lit(i)).try_cast("bigint")
    value = (
        F.when(F.size(parts) == 1, F.floor(F.get(parts, F.lit(0)).try_cast("double")))
        .when(F.size(parts) == 2, n(0) * 60 + n(1))
        .when(F.size(parts) == 3, n(0) * 3600 + n(1) * 60 + n(2))
    )
    return F.coalesce(value, F.lit(0)).cast("bigint")


def fmt_duration(sec: Column) -> Column:
    """M:SS; a dash for 0 or unknown."""
    s = F.coalesce(sec, F.lit(0)).cast("bigint")
    return F.when(s <= 0, F.lit("—")).otherwise(F.format_string("%d:%02d", F.floor(s / 60), s % 60))


def fmt_duration_page(sec: Column) -> Column:
    """MM:SS, from an hour on H:MM:SS."""
    s = F.greatest(F.coalesce(sec, F.lit(0)).cast("bigint"), F.lit(0))
    long = F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)
    return F.when(s >= 3600, long).otherwise(F.format_string("%02d:%02d", F.floor(s / 60), s % 60))


def parse_view_count(t: Column) -> Column:
    """A count such as 3.2万 (ten thousands) as a number; null if it is none."""
    number = F.regexp_replace(t, "[万,+]", "").try_cast("double")
    return F.round(number * F.when(t.contains("万"), 10000).otherwise(1)).cast("bigint")


def resolve_relative_date(t: Column, as_of: Column) -> Column:
    """Date of 今天, 昨天, MM-DD or YYYY-MM-DD; of anything else as_of."""
    month_day = F.try_to_date(F.concat(F.year(as_of).cast("string"), F.lit("-"), F.regexp_extract(t, r"^(\d{1,2}-\d{1,2})$", 1)), "yyyy-M-d")
    full = F.try_to_date(F.regexp_extract(t, r"^(\d{4}-\d{1,2}-\d{1,2})$", 1), "yyyy-M-d")
    return (
        F.when(t.contains("昨天"), F.date_sub(as_of, 1))
        .when(t.contains("今天"), as_of)
        .otherwise(F.coalesce(full, month_day, as_of))
    )


def days_until(day: Column, as_of: Column) -> Column:
    return F.datediff(day, as_of)


def is_upcoming(day: Column, as_of: Column, within: int = 30) -> Column:
    return F.coalesce(days_until(day, as_of).between(0, within), F.lit(False))


def link_expiry(url: Column) -> Column:
    """Epoch seconds of a signed link; 0 without one."""
    return F.coalesce(F.regexp_extract(url, r"[?&]Expires=(\d+)", 1).try_cast("bigint"), F.lit(0))


def human_size(n: Column) -> Column:
    """Bytes with one decimal in B, KB, MB or GB of 1024."""
    x = n.cast("double")
    one = lambda v, unit: F.concat(F.format_string("%.1f", v), F.lit(unit))
    return (
        F.when(x < 1024, one(x, " B"))
        .when(x < 1024.0**2, one(x / 1024, " KB"))
        .when(x < 1024.0**3, one(x / 1024.0**2, " MB"))
        .otherwise(one(x / 1024.0**3, " GB"))
    )
