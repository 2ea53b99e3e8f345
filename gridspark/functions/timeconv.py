"""Market time as Column expressions: hour ending, repeated hours, cutoffs, holidays, blocks.

Instants are TIMESTAMP_NTZ values holding UTC wall time, so nothing here depends on the session time zone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.constants import LOCAL_TZ, SPLITS
from gridspark.functions.zones import SummerCalendar, by_year, contains, in_range, out_of_range, summer_calendar


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """body(value) with `value` evaluated once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def hours(n: Column | int | float) -> Column:
    n = n if isinstance(n, Column) else F.lit(n)
    return F.make_dt_interval(F.lit(0), F.lit(0), (n * 60).cast("int"))


def minutes(n: Column | int) -> Column:
    n = n if isinstance(n, Column) else F.lit(n)
    return F.make_dt_interval(F.lit(0), F.lit(0), n.cast("int"))


def _whole(delta: Column, unit: Column) -> Column:
    """How many whole units fit into an interval."""
    return F.call_function("div", delta, unit)


def floor_minutes(ts: Column | str, n: int) -> Column:
    """Start of the n-minute bucket of the day (n divides a day). One reference to `ts`, whole-number arithmetic."""
    origin = F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")
    width = minutes(n)
    return origin + width * _whole(col(ts) - origin, width)


def floor_hours(ts: Column | str, n: int = 1) -> Column:
    """Start of the n-hour bucket of the day (n divides 24)."""
    return floor_minutes(ts, 60 * n)


def interval_minutes(delta: Column) -> Column:
    return _whole(delta, minutes(1)).cast("int")


def interval_seconds(delta: Column) -> Column:
    return _whole(delta, F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(0.000001))).cast("double") / 1e6


# ---------------------------------------------------------------- zone conversion
# The built-in resolves the zone for every row; it serves zones and years without a lookup.
def _zone_local(ts: Column, tz: str) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), ts)


def _zone_ambiguous(local: Column, tz: str) -> Column:
    first = F.convert_timezone(F.lit(tz), F.lit("UTC"), local)
    return (_zone_local(first, tz) == local) & (_zone_local(first + hours(1), tz) == local)


def _zone_utc(local: Column, repeated: Column | None, tz: str) -> Column:
    first = F.convert_timezone(F.lit(tz), F.lit("UTC"), local)
    out = F.when(_zone_local(first, tz) != local, floor_hours(first)).otherwise(first)
    return out if repeated is None else F.when(repeated & _zone_ambiguous(local, tz), first + hours(1)).otherwise(out)


def _zone_repeated(ts: Column, tz: str) -> Column:
    before = ts - hours(1)
    now_local, before_local = _zone_local(ts, tz), _zone_local(before, tz)
    return ((now_local - ts) < (before_local - before)) & (F.hour(now_local) == F.hour(before_local))


def _zone_hours(day: Column, tz: str) -> Column:
    midnight = lambda d: F.convert_timezone(F.lit(tz), F.lit("UTC"), d.cast("timestamp_ntz"))
    return (interval_minutes(midnight(F.date_add(day, 1)) - midnight(day)) / 60).cast("int")


def utc_to_local(ts: Column | str, tz: str = LOCAL_TZ) -> Column:
    ts = col(ts)
    slow = _zone_local(ts, tz)
    cal = summer_calendar(tz)
    if cal is None:
        return slow
    y = F.year(ts)
    summer = (ts >= by_year(cal.starts, y)) & (ts < by_year(cal.ends, y))
    fast = ts + F.when(summer, F.lit(cal.summer)).otherwise(F.lit(cal.standard))
    return F.when(in_range(y), fast).otherwise(slow)


def local_to_utc(local: Column | str, repeated: Column | None = None, tz: str = LOCAL_TZ) -> Column:
    """Wall time to instant. Ambiguous times are the daylight occurrence unless `repeated`;
    times inside a spring gap move forward to the end of the gap."""
    local = col(local)
    cal = summer_calendar(tz)
    slow = _zone_utc(local, repeated, tz)
    if cal is None:
        return slow
    y = F.year(local)
    gap_start = by_year([t + cal.standard for t in cal.starts], y)
    gap_end = by_year([t + cal.summer for t in cal.starts], y)
    back = by_year([t + cal.summer for t in cal.ends], y)
    summer = (local >= gap_start) & (local < back)
    if repeated is not None:
        summer = summer & ~(F.coalesce(repeated, F.lit(False)) & _ambiguous_by_year(local, cal))
    fast = (F.when((local >= gap_start) & (local < gap_end), by_year(cal.starts, y))
            .otherwise(local - F.when(summer, F.lit(cal.summer)).otherwise(F.lit(cal.standard))))
    return F.when(in_range(y), fast).otherwise(slow)


def _ambiguous_by_year(local: Column, cal: SummerCalendar) -> Column:
    y = F.year(local)
    return F.coalesce((local >= by_year([t + cal.standard for t in cal.ends], y))
                      & (local < by_year([t + cal.summer for t in cal.ends], y)), F.lit(False))


def is_ambiguous(local: Column | str, tz: str = LOCAL_TZ) -> Column:
    """True for wall times that happen twice."""
    local = col(local)
    cal = summer_calendar(tz)
    slow = _zone_ambiguous(local, tz)
    return slow if cal is None else F.when(out_of_range(F.year(local)), slow).otherwise(_ambiguous_by_year(local, cal))


def is_repeated_hour(ts: Column | str, tz: str = LOCAL_TZ) -> Column:
    """True when the clock went back within the last hour and this wall hour already happened."""
    ts = col(ts)
    cal = summer_calendar(tz)
    slow = _zone_repeated(ts, tz)
    if cal is None:
        return slow
    y = F.year(ts)
    shift = cal.summer - cal.standard
    fast = F.coalesce((ts >= by_year(cal.ends, y)) & (ts < by_year([t + shift for t in cal.ends], y)), F.lit(False))
    return F.when(out_of_range(y), slow).otherwise(fast)


def midnight_utc(day: Column | str, tz: str = LOCAL_TZ) -> Column:
    return local_to_utc(col(day).cast("timestamp_ntz"), tz=tz)


def hours_in_day(day: Column | str, tz: str = LOCAL_TZ) -> Column:
    day = col(day)
    cal = summer_calendar(tz)
    slow = _zone_hours(day, tz)
    if cal is None:
        return slow
    shift = int((cal.summer - cal.standard).total_seconds() // 3600)
    spring, autumn = contains(cal.spring_days, day), contains(cal.autumn_days, day)
    return F.when(out_of_range(F.year(day)), slow).otherwise(24 - shift * spring.cast("int") + shift * autumn.cast("int"))


def is_change_day(day: Column | str, tz: str = LOCAL_TZ) -> Column:
    """The day is bound once: as a filter this is pushed below aggregates, where the day stands for a long expression, and a
    copy of it per use would make one method that the JVM refuses to compile."""
    cal = summer_calendar(tz)

    def judged(d: Column) -> Column:
        slow = _zone_hours(d, tz) != 24
        return F.when(in_range(F.year(d)), contains(cal.spring_days + cal.autumn_days, d)).otherwise(slow) if cal else slow

    return let(col(day), judged)


def cutoff_utc(day: Column | str, tz: str = LOCAL_TZ) -> Column:
    """10:00 local on the day before the operating day, as an instant."""
    return local_to_utc(F.date_sub(col(day), 1).cast("timestamp_ntz") + hours(10), tz=tz)


def next_cutoff_day(ts: Column | str, lead_minutes: int = 0, tz: str = LOCAL_TZ) -> Column:
    """First operating day whose cutoff (minus `lead_minutes`) lies strictly after `ts`.

    Every instant has exactly one such day, so an as-of lookup on daily cutoffs can start with a grouped
    maximum instead of a sort of the raw rows."""
    local = utc_to_local(col(ts) + minutes(lead_minutes), tz)
    return F.date_add(F.to_date(local), F.when(F.hour(local) < 10, 1).otherwise(2))


# ---------------------------------------------------------------- standard columns
def add_time_columns(df: DataFrame, start: str = "start_utc", length_minutes: int = 60,
                     tz: str = LOCAL_TZ) -> DataFrame:
    """Standard interval columns derived from one UTC start."""
    ts = F.col(start)
    local = utc_to_local(ts, tz)
    end = ts + minutes(length_minutes)
    columns = {
        "start_utc": ts,
        "end_utc": end,
        "start_local": local,
        "end_local": utc_to_local(end, tz),
        "operating_date": F.to_date(local),
        "hour_ending": (F.hour(local) + 1).cast("int"),
        "repeated_hour": is_repeated_hour(ts, tz),
    }
    if length_minutes == 15:
        columns["quarter"] = (F.floor(F.minute(local) / 15) + 1).cast("int")
    return df.withColumns(columns)


def month_key(day: Column | str) -> Column:
    return F.date_format(col(day), "yyyy-MM")


def month_label(day: Column | str) -> Column:
    return F.date_format(col(day), "MMMM yyyy")


# ---------------------------------------------------------------- calendar
def _date(y: Column, m: int, d: int) -> Column:
    return F.make_date(y, F.lit(m), F.lit(d))


def _memorial(y: Column) -> Column:
    return F.next_day(_date(y, 5, 24), "MON")


def _labor(y: Column) -> Column:
    return F.next_day(_date(y, 8, 31), "MON")


def _thanksgiving(y: Column) -> Column:
    return F.date_add(F.next_day(_date(y, 10, 31), "THU"), 21)


def is_offpeak_holiday(day: Column | str) -> Column:
    """Six reliability-council holidays; a Sunday one is observed on Monday, a Saturday one stays."""
    day = col(day)
    y = F.year(day)

    def observed(d: Column) -> Column:
        return F.when(F.weekday(d) == 6, F.date_add(d, 1)).otherwise(d)

    dates = [observed(_date(y, 1, 1)), observed(_date(y, 7, 4)), observed(_date(y, 12, 25)),
             _memorial(y), _labor(y), _thanksgiving(y)]
    return reduce(lambda a, b: a | b, [day == d for d in dates])


def block_label(day: Column | str, he: Column | str) -> Column:
    day, he = col(day), col(he)
    return (F.when((he <= 6) | (he >= 23), "7x8")
            .when((F.weekday(day) >= 5) | is_offpeak_holiday(day), "2x16").otherwise("5x16"))


def is_federal_holiday(day: Column | str) -> Column:
    """Federal holidays on their observed day (Saturday to Friday, Sunday to Monday)."""
    day = col(day)
    y = F.year(day)

    def nearest(d: Column) -> Column:
        return (F.when(F.weekday(d) == 5, F.date_sub(d, 1)).when(F.weekday(d) == 6, F.date_add(d, 1)).otherwise(d))

    dates = [
        nearest(_date(y, 1, 1)),
        nearest(_date(y + 1, 1, 1)),
        F.date_add(F.next_day(F.date_sub(_date(y, 1, 1), 1), "MON"), 14),
        F.date_add(F.next_day(_date(y, 1, 31), "MON"), 14),
        _memorial(y),
        F.when(y >= 2021, nearest(_date(y, 6, 19))),
        nearest(_date(y, 7, 4)),
        _labor(y),
        F.date_add(F.next_day(_date(y, 9, 30), "MON"), 7),
        nearest(_date(y, 11, 11)),
        _thanksgiving(y),
        nearest(_date(y, 12, 25)),
    ]
    return reduce(lambda a, b: a | b, [F.coalesce(day == d, F.lit(False)) for d in dates])


def add_calendar(df: DataFrame, day: str = "operating_date") -> DataFrame:
    d = F.col(day)
    return df.withColumns({
        "month_num": F.month(d), "dow": F.weekday(d), "is_holiday": is_federal_holiday(d),
        "dst_change_day": is_change_day(d),
    })


def split_label(day: Column | str, splits=SPLITS) -> Column:
    day = col(day)
    out = None
    for name, lo, hi in splits:
        cond = day.between(F.lit(lo), F.lit(hi))
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out


def year_split(day: Column | str, train_years: list[int]) -> Column:
    y = F.year(col(day))
    return F.when(y.isin(*train_years), "train").when(y > max(train_years), "test_in_template")


# ---------------------------------------------------------------- weather run bounds
def run_init_bound(valid: Column | str, cycle_h: int, step_h: int, lead_days: int = 2) -> Column:
    """Newest model run that can have influenced a stored value of the given lead."""
    t = col(valid)
    if step_h > 1:
        on_grid = (F.hour(t) % step_h == 0) & (F.minute(t) == 0)
        t = F.when(on_grid, t).otherwise(floor_hours(t, step_h) + hours(2 * step_h))
    return floor_hours(t - hours(24 * lead_days), cycle_h)


def issued_bound(valid: Column | str, cycle_h: int, step_h: int, latency_h: float, lead_days: int = 2) -> Column:
    return run_init_bound(valid, cycle_h, step_h, lead_days) + hours(latency_h)


# ---------------------------------------------------------------- day-hour-minute stamps
def resolve_day_stamp(day: Column, hour: Column, minute: Column, win_start: Column, win_end: Column) -> Column:
    """Full instant of a DDHHMM stamp nearest to [win_start, win_end); NULL beyond three days."""
    months = F.sequence(F.add_months(F.trunc(win_start.cast("date"), "MM"), -1), F.add_months(F.trunc(win_end.cast("date"), "MM"), 1),
                        F.expr("INTERVAL '1' MONTH"))
    stamps = F.filter(F.transform(months, lambda m: F.try_make_timestamp_ntz(
        F.year(m), F.month(m), day.cast("int"), hour.cast("int"), minute.cast("int"), F.lit(0))), lambda ts: ts.isNotNull())
    ranked = F.transform(stamps, lambda ts: F.struct(
        F.greatest(interval_seconds(win_start - ts), interval_seconds(ts - win_end), F.lit(0.0)).alias("away"), ts.alias("ts")))
    nearest = F.array_min(ranked)
    return F.when(nearest["away"] <= 3 * 86400, nearest["ts"])
