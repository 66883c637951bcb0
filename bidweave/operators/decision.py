"""Go / no-go: a record's requirements held to a profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import money, plain


def go_no_go(requirements: DataFrame, terms: tuple[str, ...], bonding_limit: float | None, key: str = "opportunity_id") -> DataFrame:
    """Verdict and score of every ``key`` from its rows of ``category`` and ``requirement``."""
    text, category = plain(F.col("requirement")), F.col("category")
    known = F.filter(F.transform(F.array(*map(F.lit, terms)).cast("array<string>"), plain), lambda t: F.length(t) >= 3)
    credential = F.exists(known, lambda t: F.contains(text, t) | F.contains(t, text))
    capability = F.exists(known, lambda t: (F.length(t) >= 4) & F.contains(text, t))
    required = money(F.col("requirement"))
    enough = required <= F.lit(bonding_limit).cast("double")
    outcome = (
        F.when(category == "bonding", F.when(enough, "confirmed").when(~enough, "exceeds").otherwise("unknown"))
        .when(category == "certification", F.when(credential, "confirmed").otherwise("risk"))
        .when(category.isin("insurance", "site_visit"), "unknown")
        .when(category == "technical", F.when(capability, "confirmed").otherwise("unknown"))
    )
    counted = requirements.withColumn("outcome", outcome).groupBy(key).agg(
        F.count_if(F.col("outcome") == "confirmed").alias("confirmed"),
        F.count_if(F.col("outcome").isin("exceeds", "risk")).alias("risks"),
        F.count_if(F.col("outcome") == "unknown").alias("unknown"),
        F.coalesce(F.bool_or(F.col("outcome") == "exceeds"), F.lit(False)).alias("exceeds"),
    )
    verdict = F.when(F.col("exceeds"), "NO-GO").when(F.col("risks") > 0, "REVIEW").when(F.col("confirmed") > 0, "GO").otherwise("REVIEW")
    assessed = F.col("confirmed") + F.col("risks")
    score = F.when(assessed > 0, F.round(100 * F.col("confirmed") / assessed).cast("int"))
    return counted.select(key, "confirmed", "risks", "unknown", verdict.alias("verdict"), score.alias("score"))
