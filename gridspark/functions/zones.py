"""Clock changes of a time zone as literal arrays, one entry per year.

`convert_timezone` resolves the zone for every row, which dominates the cost of labelling intervals. Zones with one
summer period per year are a lookup by year instead; every other zone, and years out of range, use the built-in.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import lru_cache
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

FIRST_YEAR, LAST_YEAR = 1970, 2099


@dataclass(frozen=True)
class SummerCalendar:
    standard: dt.timedelta
    summer: dt.timedelta
    starts: tuple[dt.datetime, ...]
    ends: tuple[dt.datetime, ...]

    @property
    def spring_days(self) -> tuple[dt.date, ...]:
        return tuple((t + self.standard).date() for t in self.starts)

    @property
    def autumn_days(self) -> tuple[dt.date, ...]:
        return tuple((t + self.summer).date() for t in self.ends)


def _change(zone: ZoneInfo, lo: dt.datetime, hi: dt.datetime) -> dt.datetime:
    """First UTC minute in (lo, hi] with another offset than at lo."""
    def offset(t: dt.datetime) -> dt.timedelta:
        return t.replace(tzinfo=dt.timezone.utc).astimezone(zone).utcoffset()

    was = offset(lo)
    while hi - lo > dt.timedelta(minutes=1):
        mid = lo + dt.timedelta(minutes=((hi - lo) // dt.timedelta(minutes=2)))
        lo, hi = (mid, hi) if offset(mid) == was else (lo, mid)
    return hi


@lru_cache(maxsize=8)
def summer_calendar(tz: str) -> SummerCalendar | None:
    zone = ZoneInfo(tz)
    day = dt.timedelta(days=1)
    pairs, offsets = [], set()
    for year in range(FIRST_YEAR, LAST_YEAR + 1):
        t, found = dt.datetime(year, 1, 1), []
        before = t.replace(tzinfo=dt.timezone.utc).astimezone(zone).utcoffset()
        while t < dt.datetime(year + 1, 1, 1):
            after = (t + day).replace(tzinfo=dt.timezone.utc).astimezone(zone).utcoffset()
            if after != before:
                found.append((_change(zone, t, t + day), before, after))
                before = after
            t += day
        if len(found) != 2 or not found[0][1] < found[0][2]:
            return None
        pairs.append((found[0][0], found[1][0]))
        offsets.add((found[0][1], found[0][2], found[1][2]))
    if len(offsets) != 1:
        return None
    standard, summer, back = offsets.pop()
    if back != standard:
        return None
    return SummerCalendar(standard, summer, tuple(p[0] for p in pairs), tuple(p[1] for p in pairs))


def in_range(year: Column) -> Column:
    return year.between(FIRST_YEAR, LAST_YEAR)


def out_of_range(year: Column) -> Column:
    return ~in_range(year)


def _folded(values) -> Column:
    """The list travels as one text literal that the optimizer folds to an array."""
    kind = "timestamp_ntz" if isinstance(values[0], dt.datetime) else "date"
    return F.split(F.lit(",".join(str(v) for v in values)), ",").cast(f"array<{kind}>")


def by_year(values, year: Column) -> Column:
    """values[year - FIRST_YEAR]"""
    return F.get(_folded(values), year - FIRST_YEAR)


def contains(values, c: Column) -> Column:
    return F.array_contains(_folded(values), c)
