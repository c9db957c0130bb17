"""Date parsing and calendar parts on ``timestamp_ntz`` (wall-clock, zone-free)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS_RUN

# The review date layout is day.month.year hour:minute.
_DATE_RX = rf"^([0-9]{{1,2}})\.([0-9]{{1,2}})\.([0-9]{{4}}){WS_RUN}([0-9]{{1,2}}):([0-9]{{1,2}})$"
DAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_review_date(c) -> Column:
    """``DD.MM.YYYY HH:MM`` (one or two digits for day, month, hour, minute) →
    ``timestamp_ntz``; anything unparsable or impossible (31.02) → NULL.

    Built from the parts with ``try_make_timestamp_ntz``, so the result does not
    depend on the session time zone.
    """
    s = _col(c)
    # one test of the layout; its five numbers lie between dots, a colon and one run of white space
    parts = F.split(F.when(s.rlike(_DATE_RX), s), rf"[.:]|{WS_RUN}")

    def part(i):
        return F.get(parts, F.lit(i)).try_cast("int")

    return F.try_make_timestamp_ntz(part(2), part(1), part(0), part(3), part(4), F.lit(0))


def _digits(x: Column, width: int) -> Column:
    return F.lpad(x.cast("string"), width, "0")


def weekday_name(ts) -> Column:
    """English weekday from the calendar date (``date_format`` would go through the session time zone)."""
    return F.element_at(F.array(*[F.lit(d) for d in DAY_NAMES]), F.weekday(_col(ts)) + 1)


def review_date_text(ts) -> Column:
    """``DD.MM.YYYY HH:MM``, the inverse of ``parse_review_date``, from the wall-clock parts."""
    t = _col(ts)
    return F.concat(_digits(F.dayofmonth(t), 2), F.lit("."), _digits(F.month(t), 2), F.lit("."), _digits(F.year(t), 4),
                    F.lit(" "), _digits(F.hour(t), 2), F.lit(":"), _digits(F.minute(t), 2))


def trunc_month(ts) -> Column:
    return F.trunc(F.to_date(_col(ts)), "MM").cast("timestamp_ntz")


def trunc_day(ts) -> Column:
    return F.to_date(_col(ts)).cast("timestamp_ntz")


def trunc_hour(ts) -> Column:
    t = _col(ts)
    return F.make_timestamp_ntz(F.year(t), F.month(t), F.dayofmonth(t), F.hour(t), F.lit(0), F.lit(0))


def date_parts(ts) -> dict[str, Column]:
    """Month period, year, English day name and hour of a timestamp."""
    t = _col(ts)
    return {
        "month": trunc_month(t),
        "year": F.year(t),
        "day_name": weekday_name(t),
        "hour": F.hour(t),
    }


def format_datetime_local(ts) -> Column:
    """``YYYY-MM-DDTHH:MM``; NULL → ''."""
    t = _col(ts)
    text = F.concat(_digits(F.year(t), 4), F.lit("-"), _digits(F.month(t), 2), F.lit("-"), _digits(F.dayofmonth(t), 2),
                    F.lit("T"), _digits(F.hour(t), 2), F.lit(":"), _digits(F.minute(t), 2))
    return F.coalesce(text, F.lit(""))
