"""Kickoffs and weeks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def kickoff_utc(day: Column, clock: Column, zone: str = "America/New_York", default: str | None = None) -> Column:
    """Instant of a local day and "HH:mm"; null if the local time does not exist or occurs twice (change of clocks)."""
    at = F.coalesce(clock, F.lit(default).cast("string"))
    local = F.try_to_timestamp(F.concat_ws(" ", day.cast("string"), at), F.lit("yyyy-MM-dd HH:mm"))
    utc = F.to_utc_timestamp(local, zone)
    back = F.from_utc_timestamp(utc, zone)
    twin = [F.from_utc_timestamp(utc + F.expr(f"INTERVAL {h} HOURS"), zone) == local for h in (-1, 1)]
    return F.when(day.isNotNull() & at.isNotNull() & (back == local) & ~twin[0] & ~twin[1], utc)


def week_bucket(week: Column) -> Column:
    return F.when(week <= 4, "early").when(week <= 9, "mid").when(week <= 14, "late").when(week <= 18, "closing").when(week.isNotNull(), "playoffs")


def slate_phase(first: Column, last: Column, now: Column, final: Column, games: Column) -> Column:
    """Phase of a week's slate: complete, upcoming, in progress, or over but not graded."""
    return F.when(final == games, "complete").when(now < first, "upcoming").when(now <= last, "in_progress").otherwise("awaiting_results")


def snapshot_before(first: Column, weekday: str = "WED", hour: int = 16) -> Column:
    """The given weekday at the given hour before a week's first kickoff."""
    day = F.to_date(first)
    return F.make_timestamp(F.year(F.date_sub(F.next_day(day, weekday), 7)), F.month(F.date_sub(F.next_day(day, weekday), 7)), F.dayofmonth(F.date_sub(F.next_day(day, weekday), 7)), F.lit(hour), F.lit(0), F.lit(0))
