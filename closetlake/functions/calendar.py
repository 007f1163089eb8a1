"""Instants, local days, months and age labels.

Days are those of ``spark.sql.session.timeZone``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from closetlake.functions.values import as_date, as_instant, col


def instant(seconds, iso_text, millis=None) -> Column:
    """An instant given as epoch seconds, epoch milliseconds or ISO text, the first that is known; null if none."""
    known = [F.timestamp_seconds(col(seconds)), F.try_to_timestamp(col(iso_text))]
    if millis is not None:
        known.insert(1, F.timestamp_millis(col(millis).cast("bigint")))
    return F.coalesce(*known)


_ISO_DAY = r"^\s*(\d{4})-(\d{1,2})-(\d{1,2})\s*$"


def day(c) -> Column:
    return F.to_date(col(c))


def shift_month(selected, displayed_month, months) -> Column:
    """The selected date moved by whole months, cut to the month's last day.

    Year, month and day are read apart, so a day that its month lacks (31 February)
    still counts as day 31. Text of another form starts from day 1 of the displayed month.
    """
    parts = [F.regexp_extract(col(selected).cast("string"), _ISO_DAY, k).try_cast("int") for k in (1, 2, 3)]
    picked = F.when(parts[1].between(1, 12) & parts[2].between(1, 31), F.make_date(parts[0], parts[1], F.lit(1)))
    moved = F.add_months(F.coalesce(picked, month_start(displayed_month)), months)
    last = F.dayofmonth(F.last_day(moved))
    return F.date_add(moved, F.coalesce(F.when(picked.isNotNull(), F.least(parts[2], last)), F.lit(1)) - 1)


def shifted_display(selected, displayed_month, months) -> Column:
    """First day of the month that is shown after the move."""
    return month_start(shift_month(selected, displayed_month, months))


def month_start(c) -> Column:
    return F.trunc(col(c), "month").cast("date")


def leading_blanks(month) -> Column:
    """Empty cells before day 1 in a grid whose weeks start on Sunday."""
    return F.dayofweek(month_start(month)) - 1


def month_days(month) -> Column:
    """All days of the month as a list."""
    return F.sequence(month_start(month), F.last_day(col(month)))


def age_label(ts, now) -> Column:
    """How long ago, in the coarsest unit below a week, else the date."""
    ms = F.unix_millis(as_instant(now)) - F.unix_millis(col(ts).cast("timestamp"))

    def whole(unit: int, suffix: str) -> Column:
        return F.concat(F.floor(ms / unit).cast("string"), F.lit(suffix))

    return (
        F.when(col(ts).isNull(), "No activity")
        .when(ms < 60_000, "Just now")
        .when(ms < 3_600_000, whole(60_000, "m ago"))
        .when(ms < 86_400_000, whole(3_600_000, "h ago"))
        .when(ms < 604_800_000, whole(86_400_000, "d ago"))
        .otherwise(F.date_format(col(ts), "yyyy-MM-dd"))
    )


def day_label(ts, today) -> Column:
    """Today, Yesterday, or the ISO date."""
    gap = F.datediff(as_date(today), day(ts))
    return (
        F.when(gap == 0, "Today").when(gap == 1, "Yesterday")
        .otherwise(F.date_format(col(ts), "yyyy-MM-dd"))
    )


def within_days(ts, start, end) -> Column:
    """Inclusive range of whole local days; a bound of ``None`` is open."""
    test = F.lit(True)
    if start is not None:
        test = test & (col(ts) >= as_date(start).cast("timestamp"))
    if end is not None:
        test = test & (col(ts) < F.date_add(as_date(end), 1).cast("timestamp"))
    return test
