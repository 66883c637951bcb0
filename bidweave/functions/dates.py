"""Due dates of the sources: one rule for each way of writing them. What cannot be read is null."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Zone tokens and their offsets in hours.
TOKEN_HOURS = {"EDT": -4, "EST": -5, "CDT": -5, "CST": -6, "MDT": -6, "MST": -7, "PDT": -7, "PST": -8, "CT": -5, "HST": -10}

FORMATS = ("M/d/yyyy h:mm a", "M/d/yyyy h:mm:ss a", "M/d/yyyy H:mm", "M/d/yy h:mm a", "MMM d, yyyy h:mm a", "MMMM d, yyyy h:mm a", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd HH:mm:ss")
DAY_FORMATS = ("M/d/yyyy", "M/d/yy", "MMM d, yyyy", "MMMM d, yyyy", "yyyy-MM-dd")


def parsed(c: Column, formats: tuple[str, ...]) -> Column:
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(f)) for f in formats))


def zone_token(c: Column) -> Column:
    return F.upper(F.regexp_extract(c, r"(?i)\b(EDT|EST|CDT|CST|MDT|MST|PDT|PST|HST|CT)\b", 1))


def with_token(c: Column) -> Column:
    """Wall clock with a zone token; without one, null."""
    hours = F.create_map(*(F.lit(x) for pair in TOKEN_HOURS.items() for x in pair))
    wall = parsed(F.trim(F.regexp_replace(c, r"(?i)\s*\(?\b(EDT|EST|CDT|CST|MDT|MST|PDT|PST|HST|CT)\b\)?", "")), FORMATS)
    offset = F.try_element_at(hours, zone_token(c))
    return F.timestamp_seconds(F.unix_seconds(wall) - offset * 3600)


@dataclass(frozen=True)
class DateRule:
    """How a source writes due dates: an IANA zone, or an offset in hours that may depend on the
    month, and the time that a bare day stands for (seconds after local midnight)."""

    zone: str | None = None
    hours: int = 0
    summer: tuple[int, int, int] | None = None  # first month, last month, offset in hours
    day_seconds: int = 0

    def read(self, c: Column) -> Column:
        whole, day = parsed(c, FORMATS), parsed(c, DAY_FORMATS)
        wall = F.coalesce(whole, F.timestamp_seconds(F.unix_seconds(day) + self.day_seconds))
        wall = F.when(F.year(wall) > 1, wall)  # 1/1/0001 stands for "none"
        if self.zone:
            return F.to_utc_timestamp(wall, self.zone)
        offset = F.lit(self.hours)
        if self.summer:
            offset = F.when(F.month(wall).between(*self.summer[:2]), self.summer[2]).otherwise(self.hours)
        return F.timestamp_seconds(F.unix_seconds(wall) - offset * 3600)


END_OF_DAY = 86_399

#: The rule of each family of sources.
DATE_RULES = {
    "chicago": DateRule(zone="America/Chicago"),
    "new_york": DateRule(zone="America/New_York"),
    "texas": DateRule(hours=-6, summer=(3, 11, -5)),
    "k12_portals": DateRule(hours=-6, summer=(4, 10, -5)),
    "south_carolina": DateRule(hours=-5, summer=(3, 11, -4), day_seconds=43_200),
    "arizona": DateRule(hours=-7),
    "arkansas": DateRule(hours=-5, day_seconds=END_OF_DAY),
    "hawaii": DateRule(hours=-10, day_seconds=86_340),
    "nebraska": DateRule(hours=-5, day_seconds=END_OF_DAY),
    "washington": DateRule(hours=-7),
    "south_dakota": DateRule(hours=-5, day_seconds=36_000),
    "wyoming": DateRule(hours=0, day_seconds=21_599),
    "utc": DateRule(),
}


def shown(c: Column) -> Column:
    return F.coalesce(F.date_format(c, "MMM d, yyyy"), F.lit("Not stated"))


SLASHED = r"^(\d{1,2})/(\d{1,2})/(\d{4})"


def slashed_parts(c: Column, pattern: str) -> tuple[Column, Column, Column]:
    """Month, day and year as text; empty where the text is not of this form."""
    return tuple(F.regexp_extract(c, pattern, i) for i in (1, 2, 3))


def utc_day(c: Column, end_of_day: Column) -> Column:
    """A bare month/day/year as midnight UTC, or the last second of that day; months and days beyond
    the calendar run on into the next ones. Another text is null."""
    month, day, year = (F.nullif(x, F.lit("")).cast("int") for x in slashed_parts(c, SLASHED + "$"))
    first = F.add_months(F.make_date(year, F.lit(1), F.lit(1)), month - 1)
    days = F.unix_date(F.date_add(first, day - 1)).cast("long")
    return F.timestamp_seconds(days * 86_400 + F.when(end_of_day, END_OF_DAY).otherwise(0))


def iso_day(c: Column) -> Column:
    """``yyyy-MM-dd`` of a text that starts with month/day/year, whatever follows."""
    month, day, year = slashed_parts(F.trim(F.regexp_replace(c, r"\s+", " ")), SLASHED)
    return F.when(year != "", F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")))
