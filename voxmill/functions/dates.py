"""Date expressions: tolerant parsing and time buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxmill.functions.text import strip

_TIME = r"(?:[01]?\d|2[0-3]):[0-5]?\d:(?:[0-5]?\d|6[01])"
_ISO_TIME = (
    r"(?:[01]\d|2[0-3])(?::[0-5]\d(?::[0-5]\d(?:[.,]\d+)?)?|[0-5]\d(?:[0-5]\d(?:[.,]\d+)?)?)?"
    r"(?:[+-]\d{2}(?::?\d{2}(?::?\d{2})?)?)?"
)

INTERVALS = ("weekly", "monthly")


def parse_date(c: Column) -> Column:
    """Calendar date of a free-form date string, or null.

    The first 19 characters are tried against year-month-day (dashes or slashes), day-month-year
    (dashes), month/day/year (slashes) and year-month-dayThour:minute:second. Anything else may still
    be ISO 8601. A zone offset never moves the date.
    """
    full = strip(c.cast("string"))
    s = F.substring(full, 1, 19)
    iso = F.replace(full, F.lit("Z"), F.lit(""))
    canonical = (
        F.when(s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), s)
        .when(s.rlike(r"^\d{4}/\d{1,2}/\d{1,2}$"), F.translate(s, "/", "-"))
        .when(
            s.rlike(r"^\d{1,2}-\d{1,2}-\d{4}$"),
            F.regexp_replace(s, r"^(\d+)-(\d+)-(\d+)$", "$3-$2-$1"),
        )
        .when(
            s.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"),
            F.regexp_replace(s, r"^(\d+)/(\d+)/(\d+)$", "$3-$1-$2"),
        )
        .when(s.rlike(rf"^\d{{4}}-\d{{1,2}}-\d{{1,2}}T{_TIME}$"), F.substring_index(s, "T", 1))
        .when(iso.rlike(rf"^\d{{4}}-\d{{2}}-\d{{2}}(?:.{_ISO_TIME})?$"), F.substring(iso, 1, 10))
        .when(
            iso.rlike(rf"^\d{{8}}(?:.{_ISO_TIME})?$"),
            F.regexp_replace(F.substring(iso, 1, 8), r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"),
        )
    )
    return F.when(~canonical.startswith("0000"), canonical.try_cast("date"))


def bucket_start(d: Column, interval: str) -> Column:
    """Monday of the ISO week, or first day of the month."""
    return F.trunc(d, "week" if interval == "weekly" else "month")


def bucket_axis(first: Column, last: Column, interval: str) -> Column:
    step = F.expr("interval 7 days" if interval == "weekly" else "interval 1 month")
    return F.sequence(first, last, step)


def bucket_label(d: Column, interval: str) -> Column:
    if interval == "monthly":
        return F.date_format(d, "yyyy-MM")
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), d), F.weekofyear(d))
