"""Agencies and profiles: resolution by name, by identifier inside an address, and the latest of several versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PSC_PREFIX = "PSC:"
ID_LETTERS = 7  # of a district's identifier


def latest(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in ``order``."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_place = 1").drop("_place")


def latest_profiles(organizations: DataFrame, profiles: DataFrame) -> DataFrame:
    """Organizations with the profile that was updated last."""
    return organizations.join(latest(profiles, "organization_id", F.desc("updated_at"), F.desc("profile_id")), "organization_id")


def decoded_terms(terms: Column) -> tuple[Column, Column]:
    """Capability terms and, of those with the prefix, product codes without it."""
    coded = F.filter(terms, lambda t: t.startswith(PSC_PREFIX))
    return F.filter(terms, lambda t: ~t.startswith(PSC_PREFIX)), F.transform(coded, lambda t: F.substr(t, F.lit(len(PSC_PREFIX) + 1)))


def encoded_terms(terms: Column, codes: Column) -> Column:
    return F.concat(terms, F.transform(codes, lambda c: F.concat(F.lit(PSC_PREFIX), c)))


def new_agencies(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming agencies that no stored one equals in name (in any case), state and level."""
    key = lambda t: [F.lower("name").alias("_name"), F.coalesce("state_code", F.lit("")).alias("_state"), F.col("level").alias("_level")]
    known = stored.select(*key(stored)).distinct()
    return incoming.select("*", *key(incoming)).join(known, ["_name", "_state", "_level"], "left_anti").drop("_name", "_state", "_level")


def resolved(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """``agency_key`` and ``agency_id``; the name must be equal in its very letters here, so variants in case find nothing."""
    known = stored.select("name", F.coalesce("state_code", F.lit("")).alias("_state"), "level", "agency_id").groupBy("name", "_state", "level").agg(F.min("agency_id").alias("agency_id"))
    return incoming.withColumn("_state", F.coalesce("state_code", F.lit(""))).join(known, ["name", "_state", "level"]).select("agency_key", "agency_id")


def identifiers_in(address: Column, letters: int = ID_LETTERS) -> Column:
    """All runs of ``letters`` digits in an address, so that containment becomes an equi-join."""
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(address) - letters + 1))
    return F.array_distinct(F.filter(F.transform(places, lambda i: F.substr(address, i, F.lit(letters))), lambda x: x.rlike(f"^[0-9]{{{letters}}}$")))


def contained(incoming: DataFrame, agencies: DataFrame, key: str = "nces_id") -> DataFrame:
    """``key`` and ``agency_id`` of the agencies whose website holds the identifier."""
    held = agencies.where("website is not null").select("agency_id", F.explode(identifiers_in(F.col("website"))).alias(key))
    return incoming.select(key).distinct().join(held, key)
