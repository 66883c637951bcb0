"""Dates as the sources write them, by one table of rules: a source's zone or offset, and what a bare day means.

All ways of writing are read by the same expressions; the rules are a small table that is joined by
the source's name. An offset written in the text itself comes before the rule, as does a zone token
where the source's rule knows tokens. What cannot be read is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import END_OF_DAY, TOKEN_HOURS
from ..functions.zones import NOON, THRICE, TWICE, resolved, wall_seconds

NEW_YORK, CHICAGO = "America/New_York", "America/Chicago"

# For each source its zone or offset in hours, how the offset is found, the second of the day that a bare
# day stands for, and whether zone tokens are read (with a token only, or with the rule where there is none).
RULES: dict[str, tuple[str | None, float | None, int, int, str]] = {
    "sam_gov": (None, 0, THRICE, 0, "no"),
    "sam_gov_adapter": (None, 0, THRICE, 0, "no"),
    "opengov_public": (None, 0, THRICE, 0, "no"),
    "periscope": (None, 0, THRICE, 0, "no"),
    "eva_vbo_va": (None, 0, THRICE, 0, "no"),
    "mfmp_vip_fl": (None, 0, THRICE, 0, "no"),
    "cgi_advantage": (None, 0, THRICE, 0, "no"),
    "delaware_open_bids_de": (NEW_YORK, None, TWICE, 0, "no"),
    "cgi_advantage_legacy_al": (CHICAGO, None, THRICE, 0, "no"),
    "cgi_advantage_legacy_me": (NEW_YORK, None, THRICE, 0, "no"),
    "nyscr_ny": (NEW_YORK, None, THRICE, 0, "no"),
    "powerpages_nc": (NEW_YORK, None, THRICE, 0, "no"),
    "peoplesoft_mn": (CHICAGO, None, THRICE, 0, "no"),
    "magic_public_ms": (CHICAGO, None, NOON, 0, "no"),
    "esm_posting_board_sd": (CHICAGO, None, NOON, 0, "no"),
    "hands_hi": (None, -10, THRICE, 86_340, "no"),
    "ivalua_app_az": (None, -7, THRICE, 0, "no"),
    "sap_ariba_index_ar": (None, -5, THRICE, END_OF_DAY, "no"),
    "nebraska_das_ne": (None, -5, THRICE, END_OF_DAY, "no"),
    "webs_wa": (None, -7, THRICE, END_OF_DAY, "no"),
    "wyoming_ai_released_bids_wy": (None, 0, THRICE, 21_599, "no"),
    "peoplesoft_ca": (None, None, THRICE, 0, "only"),
    "jaggaer": (None, 0, THRICE, 0, "also"),
    "peoplesoft_ks": (None, 0, THRICE, 0, "also"),
    "official_state_pages": (None, 0, THRICE, 0, "also"),
}
#: Seconds of the day that a bare day of issue stands for, where they differ from those of a due day.
ISSUE_SECONDS = {"hands_hi": 0, "sap_ariba_index_ar": 0, "nebraska_das_ne": 43_200, "webs_wa": 43_200, "wyoming_ai_released_bids_wy": 64_800}

_CLOCK = r"(?:[T,\s]+(?:at\s+)?(\d{1,2}):(\d{2})(?::(\d{2})(?:\.\d+)?)?\s*([AaPp]\.?[Mm]\.?)?)?"
_REST = r"\s*\(?\s*(Z|[+-]\d{2}:?\d{2}|[A-Za-z]{2,4})?\s*\)?\s*$"
SLASHED = r"^\s*(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})" + _CLOCK + _REST
DASHED = r"^\s*(\d{4})-(\d{1,2})-(\d{1,2})" + _CLOCK + _REST
NAMED = r"^\s*(?:[A-Za-z]+day,?\s+)?([A-Za-z]{3})[A-Za-z]*\.?\s+(\d{1,2}),?\s+(\d{4})" + _CLOCK + _REST
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def rule_table(spark: SparkSession) -> DataFrame:
    rows = [(k, zone, None if hours is None else int(hours * 3600), steps, seconds, ISSUE_SECONDS.get(k, seconds), tokens) for k, (zone, hours, steps, seconds, tokens) in RULES.items()]
    return spark.createDataFrame(rows, "_source string, _zone_name string, _fixed int, _steps int, _due_seconds int, _issue_seconds int, _tokens string")


def _groups(c: Column, pattern: str, order: tuple[int, int, int]) -> list[Column]:
    """Year, month, day, hour, minute, second, half of the day and what follows, as text; empty where absent."""
    return [F.regexp_extract(c, pattern, i) for i in (*order, 4, 5, 6, 7, 8)]


def _written(c: Column) -> Column:
    """The parts of whichever way of writing fits."""
    names = ("year", "month", "day", "hour", "minute", "second", "half", "rest")
    slashed, dashed, named = _groups(c, SLASHED, (3, 1, 2)), _groups(c, DASHED, (1, 2, 3)), _groups(c, NAMED, (3, 1, 2))
    months = F.create_map(*(F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m, str(i))))
    named[1] = F.try_element_at(months, F.lower(named[1]))
    made = lambda parts: F.struct(*(p.alias(n) for p, n in zip(parts, names)))
    return F.when(c.rlike(SLASHED), made(slashed)).when(c.rlike(DASHED), made(dashed)).when(c.rlike(NAMED), made(named))


def _seconds_of_day(hour: Column, minute: Column, second: Column, half: Column, bare: Column) -> Column:
    """Null for clocks that no watch shows."""
    number = lambda x: F.coalesce(x.try_cast("int"), F.lit(0))
    h, m, s, half = number(hour), number(minute), number(second), F.lower(F.substring(half, 1, 1))
    full = F.when((half == "p") & (h < 12), h + 12).when((half == "a") & (h == 12), F.lit(0)).otherwise(h)
    able = (full < 24) & (m < 60) & (s < 60) & ((half == "") | h.between(1, 12))
    return F.when(hour == "", bare.cast("long")).when(able, (full * 3600 + m * 60 + s).cast("long"))


def _offset_written(rest: Column) -> Column:
    """Seconds of an offset like +05:30, of Z, or null."""
    digits = F.regexp_replace(rest, r"[^0-9]", "")
    size = F.substring(digits, 1, 2).try_cast("int") * 3600 + F.substring(digits, 3, 2).try_cast("int") * 60
    return F.when(rest == "Z", 0).when(rest.rlike(r"^\+\d"), size).when(rest.rlike(r"^-\d"), -size)


def _apart(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``rows`` with a column whose expression is evaluated once, however often the plan names it."""
    return rows.withColumn(name, F.explode(F.array(value)))


def with_instants(rows: DataFrame, source: str, texts: dict[str, str], issue: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with a timestamp column for each of ``texts`` (new name to text column), read as the rule
    of the row's ``source`` says; those in ``issue`` are days of issue. A source without a rule has nulls."""
    hours = F.create_map(*(F.lit(x) for t, h in TOKEN_HOURS.items() for x in (t, h * 3600)))
    zones = [z for z, *_ in RULES.values() if z]
    now = rows.join(F.broadcast(rule_table(rows.sparkSession)), F.col(source) == F.col("_source"), "left")
    for out, text in texts.items():
        bare = F.col("_issue_seconds" if out in issue else "_due_seconds")
        now = _apart(now, "_w", _written(F.col(text)))
        year = F.col("_w.year").try_cast("int")
        year = F.when(F.length("_w.year") == 2, year + 2000).otherwise(year)
        year = F.when(year > 1, year)  # 1/1/0001 stands for "none"
        seconds = _seconds_of_day(F.col("_w.hour"), F.col("_w.minute"), F.col("_w.second"), F.col("_w.half"), bare)
        rest = F.upper(F.col("_w.rest"))
        own = F.coalesce(_offset_written(rest), F.when(F.col("_tokens") != "no", F.try_element_at(hours, rest)))
        wall = wall_seconds(year, F.col("_w.month").try_cast("int"), F.col("_w.day").try_cast("int"), seconds)
        now = _apart(now, "_p", F.struct(wall.alias("wall"), own.alias("own"), rest.alias("rest")))
        foreign = (F.col("_p.rest") != "") & F.col("_p.own").isNull() & ~F.col("_p.rest").isin("UTC", "GMT")  # words that mean nothing here
        now = resolved(now.withColumn("_wall", F.col("_p.wall")), "_wall", "_zone_name", "_steps", "_at", zones)
        plain = F.when(F.col("_tokens") == "only", None).when(F.col("_zone_name").isNotNull(), F.col("_at")).otherwise(F.col("_wall") - F.col("_fixed"))
        at = F.when(F.col("_p.own").isNotNull(), F.col("_wall") - F.col("_p.own")).otherwise(plain)
        now = now.withColumn(out, F.when(~foreign, F.timestamp_seconds(at))).drop("_w", "_p", "_wall", "_at")
    return now.drop("_source", "_zone_name", "_fixed", "_steps", "_due_seconds", "_issue_seconds", "_tokens")
