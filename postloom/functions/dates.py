"""Time formats and the fetch window."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postloom import fixed


def rfc2822(c: Column) -> Column:
    """Date as mail headers write it; times are UTC."""
    return F.concat(F.date_format(c, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000"))


def minute_text(c: Column) -> Column:
    """``yyyy-MM-dd HH:mm``."""
    return F.date_format(c, "yyyy-MM-dd HH:mm")


def ledger_time(c: Column) -> Column:
    """UTC RFC 3339 text, fraction without trailing zeros."""
    text = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.rtrim(F.rtrim(text, F.lit("0")), F.lit(".")), F.lit("Z"))


def parse_ledger_time(c: Column) -> Column:
    """Ledger text to a UTC timestamp: RFC 3339 first, then the older layouts; null when none fits."""
    text = F.regexp_replace(c, r"(?s) m=.*$", "")
    rfc = F.when(
        text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$"),
        F.try_to_timestamp(text),
    )
    tries = [rfc]
    for fmt in fixed.LEGACY_TIME_FORMATS:
        tries.append(F.try_to_timestamp(text, F.lit(fmt)))
    return F.coalesce(*tries)


def _hours(n: float) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(n) * 3600.0).cast("decimal(18,6)"))


def fetch_since(now: Column, last_completed: Column, explicit_hours: float | None = None,
                max_window_hours: float = fixed.MAX_WINDOW_HOURS) -> Column:
    """Lower bound of the fetch window.

    An explicit window is taken as given; otherwise the last completed run bounds it, with a
    24-hour default and a cap on the look-back.
    """
    if explicit_hours is not None:
        return now - _hours(explicit_hours)
    cap = max_window_hours if max_window_hours > 0 else fixed.MAX_WINDOW_HOURS
    since = F.coalesce(last_completed, now - _hours(fixed.DEFAULT_WINDOW_HOURS))
    return F.greatest(since, now - _hours(cap))
