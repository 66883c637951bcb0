"""Wall clocks to instants by a table of zone offsets; nothing here depends on the session's zone.

A zone's year in UTC has at most two changes of offset, so one row for each zone and year says all:
the instants of the changes and the offsets before, between and after them. The table is made from the
system's zone rules, has a fixed number of rows, and is broadcast to an equi-join.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from functools import cache
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

YEARS = range(1970, 2050)
DAY = 86_400
#: How the offset of a wall clock is looked for: at the instant that the clock would be in UTC and then
#: anew at each result, so many times; or once, at noon UTC of the clock's day.
THRICE, TWICE, NOON = 3, 2, 0


def _offset(zone: ZoneInfo, at: int) -> int:
    return int(datetime.fromtimestamp(at, timezone.utc).astimezone(zone).utcoffset().total_seconds())


def _change(zone: ZoneInfo, low: int, high: int) -> int:
    """The first second in (low, high] with the offset of ``high``."""
    last = _offset(zone, high)
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if _offset(zone, middle) == last else (middle, high)
    return high


@cache
def year_rows(name: str) -> list[tuple[str, int, int, int, int, int, int]]:
    """Zone, year, first and second change, and the offsets before, between and after them."""
    zone, rows = ZoneInfo(name), []
    for year in YEARS:
        start, end = (int(datetime(y, 1, 1, tzinfo=timezone.utc).timestamp()) for y in (year, year + 1))
        days = list(range(start, end, 4 * DAY)) + [end - 1]
        changes = [_change(zone, a, b) for a, b in zip(days, days[1:]) if _offset(zone, a) != _offset(zone, b)]
        if len(changes) > 2:
            raise ValueError(f"{name} changed its offset more than twice in {year}")
        first, second = (changes + [end, end])[:2]
        rows.append((name, year, first, second, _offset(zone, start), _offset(zone, first), _offset(zone, second)))
    return rows


def year_table(spark: SparkSession, zones: list[str]) -> DataFrame:
    rows = [r for z in sorted(set(zones)) for r in year_rows(z)]
    return spark.createDataFrame(rows, "_zone string, _year int, _first long, _second long, _before int, _between int, _after int")


def wall_seconds(year: Column, month: Column, day: Column, seconds: Column) -> Column:
    """Seconds from 1970 of a wall clock, as if in UTC; null for days that no calendar has."""
    written = F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-"), month.cast("string"), F.lit("-"), day.cast("string"))
    return F.unix_date(written.try_cast("date")).cast("long") * DAY + seconds


def clock(seconds: Column) -> Column:
    """The clock in UTC, without a zone, at so many seconds from 1970."""
    return F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=seconds)


def iso(seconds: Column) -> Column:
    return F.date_format(clock(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _year(at: Column) -> Column:
    return F.year(F.date_from_unix_date(F.floor(at / DAY).cast("int")))


def _with_offset(rows: DataFrame, table: DataFrame, at: str, zone: str, out: str) -> DataFrame:
    known = F.when(F.col(at) < F.col("_first"), F.col("_before")).when(F.col(at) < F.col("_second"), F.col("_between")).otherwise(F.col("_after"))
    keyed = rows.withColumn("_key_year", _year(F.col(at)))
    match = (F.col(zone) == F.col("_zone")) & (F.col("_key_year") == F.col("_year"))
    return keyed.join(F.broadcast(table), match, "left").withColumn(out, known).drop("_key_year", *table.columns)


def resolved(rows: DataFrame, wall: str, zone: str, steps: str, out: str, zones: list[str]) -> DataFrame:
    """``rows`` with ``out``, the seconds from 1970 of wall clocks (``wall``, seconds as if in UTC) of the zones named in column
    ``zone``, looked for as column ``steps`` says; null where the zone or the clock is."""
    table = year_table(rows.sparkSession, zones)
    probe = F.when(F.col(steps) == NOON, F.floor(F.col(wall) / DAY) * DAY + DAY // 2).otherwise(F.col(wall))
    now = rows.withColumn("_probe", probe)
    for turn in range(1, THRICE + 1):
        now = _with_offset(now, table, "_probe", zone, "_offset")
        found = F.col(wall) - F.col("_offset")
        last = F.col(out) if turn > 1 else found
        now = now.withColumn(out, F.when(F.col(steps) >= turn, found).otherwise(last)).withColumn("_probe", found).drop("_offset")
    return now.drop("_probe")
