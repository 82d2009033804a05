"""Durations and display formats."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _ts(c: Column) -> Column:
    """ISO strings (a trailing 'Z' or '+00:00' allowed) parsed as UTC wall-clock values; bad
    ones → null."""
    s = F.regexp_replace(c.cast("string"), r"(Z|[+-]00:?00)$", "")
    return F.to_timestamp_ntz(F.try_to_timestamp(s).cast("string"))


def duration_seconds(start, end, parse: bool = False) -> Column:
    """end − start in fractional seconds; null when either side is missing (or unparseable)."""
    s, e = _c(start), _c(end)
    if parse:
        s, e = _ts(s), _ts(e)
    # timestamp_diff works on wall-clock (NTZ) values without applying the session zone,
    # so a duration never shifts by an hour across a daylight-saving change
    return F.timestamp_diff("MICROSECOND", s, e) / F.lit(1e6)


def fmt_duration(secs) -> Column:
    """null → ''; truncated seconds; ≥60 → 'Xm Ys' else 'Ys'."""
    s = F.floor(_c(secs)).cast("long")
    long_form = F.concat(F.floor(s / 60).cast("long").cast("string"), F.lit("m "),
                         F.pmod(s, F.lit(60)).cast("string"), F.lit("s"))
    return (F.when(_c(secs).isNull(), F.lit(""))
            .when(s >= 60, long_form)
            .otherwise(F.concat(s.cast("string"), F.lit("s"))))


def fmt_ago(ts, now) -> Column:
    """Relative age: 'just now', 'Nm ago', 'Nh ago', 'Nd ago'; ``now`` is a parameter."""
    mins = F.floor(F.timestamp_diff("MICROSECOND", _c(ts), _c(now)) / 6e7)
    hours = F.floor(mins / 60)
    return (F.when(_c(ts).isNull(), F.lit(""))
            .when(mins < 1, F.lit("just now"))
            .when(mins < 60, F.concat(mins.cast("string"), F.lit("m ago")))
            .when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago")))
            .otherwise(F.concat(F.floor(hours / 24).cast("string"), F.lit("d ago"))))


def fmt_ago_text(text, now) -> Column:
    """Relative age of an ISO text (a trailing Z allowed); empty → '', text that is no time → its first
    10 characters."""
    t = F.try_to_timestamp(F.regexp_replace(_c(text), "Z$", "+00:00"))
    return (F.when(F.coalesce(_c(text), F.lit("")) == "", F.lit(""))
            .when(t.isNull(), F.substring(_c(text), 1, 10)).otherwise(fmt_ago(t, now)))


def fmt_size(size) -> Column:
    """Bytes → 'N B' / 'x.y KB' / 'x.y MB'; null → '—'. Halves round up (Java formatting)."""
    b = _c(size)
    return (F.when(b.isNull(), F.lit("—"))
            .when(b < 1024, F.concat(b.cast("long").cast("string"), F.lit(" B")))
            .when(b < 1024 * 1024, F.format_string("%.1f KB", b / 1024.0))
            .otherwise(F.format_string("%.1f MB", b / (1024.0 * 1024.0))))


def iso_date(ts) -> Column:
    return F.substring(F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss"), 1, 10)


def iso_minute(ts) -> Column:
    return F.replace(F.substring(F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss"), 1, 19), F.lit("T"), F.lit(" "))
