"""Profile match: possible and earned points, score, reasons, threshold and order.

Kept as they are: a PSC match earns points that are not possible, and a value without bounds does
too, so a score may exceed 100; terms are LIKE patterns.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINTS = {"code": 40, "term": 25, "territory": 15, "set_aside": 10, "value": 10}


@dataclass(frozen=True)
class Profile:
    naics: tuple[str, ...] = ()
    psc: tuple[str, ...] = ()
    terms: tuple[str, ...] = ()
    territories: tuple[str, ...] = ()
    certifications: tuple[str, ...] = ()
    statuses: tuple[str, ...] = ()
    least_value: float | None = None
    most_value: float | None = None

    @property
    def credentials(self) -> tuple[str, ...]:
        return self.certifications + self.statuses


def like_any(c: Column, terms: tuple[str, ...]) -> Column:
    hits = [F.like(c, F.lit(f"%{t.lower()}%")) for t in terms]
    return F.coalesce(reduce(Column.__or__, hits), F.lit(False)) if hits else F.lit(False)


def _either(flag: Column, points: int) -> Column:
    return F.when(flag, points).otherwise(0)


def score(records: DataFrame, profile: Profile) -> DataFrame:
    """``records`` with ``possible_points``, ``earned_points``, ``match_score``, ``match_reasons``."""
    text = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("description", F.lit(""))))
    sure = lambda c: F.coalesce(c, F.lit(False))
    value = F.col("estimated_value")
    bounded = profile.least_value is not None or profile.most_value is not None
    inside = value.isNotNull()
    if profile.least_value is not None:
        inside = inside & (value >= profile.least_value)
    if profile.most_value is not None:
        inside = inside & (value <= profile.most_value)
    national = "NATIONAL" in profile.territories
    here = F.lit(True) if national else sure(F.col("state_code").isin(*profile.territories)) if profile.territories else F.lit(False)
    flags = records.withColumns({
        "_naics": sure(F.arrays_overlap("naics_codes", F.array(*map(F.lit, profile.naics)))) if profile.naics else F.lit(False),
        "_psc": sure(F.col("psc_code").isin(*profile.psc)) if profile.psc else F.lit(False),
        "_term": like_any(text, profile.terms),
        "_here": here,
        "_aside": F.col("set_aside").isNotNull() & like_any(F.lower("set_aside"), profile.credentials),
        "_value": inside,
    })
    possible = F.lit(POINTS["code"] * bool(profile.naics) + POINTS["term"] * bool(profile.terms) + POINTS["territory"] * bool(profile.territories))
    if profile.credentials:
        possible = possible + _either(F.col("set_aside").isNotNull(), POINTS["set_aside"])
    if bounded:
        possible = possible + _either(value.isNotNull(), POINTS["value"])
    earned = (
        _either(F.col("_naics") | F.col("_psc"), POINTS["code"]) + _either(F.col("_term"), POINTS["term"]) + _either(F.col("_here"), POINTS["territory"])
        + _either(F.col("_aside"), POINTS["set_aside"]) + _either(F.col("_value"), POINTS["value"])
    )
    reasons = F.array_compact(F.array(
        F.when(F.col("_naics"), "NAICS match").when(F.col("_psc"), "PSC match"),
        F.when(F.col("_term"), "Capability match"),
        F.when(F.col("_here"), F.concat(F.coalesce("state_code", F.lit("National")), F.lit(" territory"))),
        F.when(F.col("_aside"), "Set-aside fit"),
        F.when(F.col("_value") & F.lit(bounded), "Target contract range"),
    ))
    scored = flags.withColumns({"possible_points": possible, "earned_points": earned, "match_reasons": reasons})
    points = F.when(F.col("possible_points") > 0, F.round(100 * F.col("earned_points") / F.col("possible_points"))).otherwise(0)
    return scored.withColumn("match_score", points.cast("int")).drop("_naics", "_psc", "_term", "_here", "_aside", "_value")


def ranked(scored: DataFrame, threshold: int = 45, limit: int = 50) -> DataFrame:
    """Best matches first; a top-k, never a full sort."""
    able = scored.where(F.col("match_score") >= max(0, min(threshold, 100)))
    return able.orderBy(F.desc("match_score"), F.asc_nulls_last("due_at"), "id").limit(max(1, min(limit, 500)))


def headline(matches: DataFrame) -> DataFrame:
    return matches.agg(
        F.max("match_score").alias("best"),
        F.count_if(F.col("match_score") >= 80).alias("strong"),
        F.round(F.avg("confidence")).cast("int").alias("mean_confidence"),
    )
