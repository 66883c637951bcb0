"""The canonical record that every source is mapped to.

A mapping names the columns it has; the others are null. The payload kept with a record is JSON, and its
SHA-256 tells whether the source has changed what it says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import squeezed, state_code

RECORD = (
    "external_id string, agency_key string, agency string, agency_type string, jurisdiction_level string, title string, description string, solicitation_type string,"
    " procurement_mechanism string, status string, issue_date date, due_at timestamp, prebid_at timestamp, estimated_value double, state_code string, city string,"
    " naics_codes array<string>, set_aside string, source_url string, raw_payload string, content_hash string"
)
COLUMNS = [part.rsplit(" ", 1) for part in (p.strip() for p in RECORD.split(","))]


def payload(**fields: Column) -> Column:
    """A record's own payload, absent values as null."""
    return F.to_json(F.struct(*(c.alias(n) for n, c in fields.items())), {"ignoreNullFields": "false"})


def canonical(rows: DataFrame, mapped: dict[str, Column], keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` and the canonical columns; a state's code is two letters or null, lists are never null."""
    given = dict(mapped)
    given["state_code"] = state_code(given.get("state_code", F.lit(None).cast("string")))
    given["naics_codes"] = F.coalesce(given.get("naics_codes", F.lit(None).cast("array<string>")), F.array().cast("array<string>"))
    given["content_hash"] = F.sha2(given["raw_payload"], 256)
    return rows.select(*keep, *(given.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in COLUMNS))


def text(c: Column) -> Column:
    """White space squeezed; null if nothing is left."""
    return F.nullif(squeezed(c), F.lit(""))


def absolute(base: str, href: Column) -> Column:
    """A link beside the page ``base``; the page itself where there is none or it is a script's."""
    scheme, rest = base.split("://", 1)
    host = f"{scheme}://{rest.split('/', 1)[0]}"
    folder = base.rsplit("/", 1)[0] if "/" in rest else base
    own = F.trim(href)
    return (
        F.when(own.isNull() | (own == "") | own.rlike("(?i)^javascript:"), base)
        .when(own.rlike("(?i)^[a-z][a-z0-9+.-]*:"), own)
        .when(own.startswith("//"), F.concat(F.lit(f"{scheme}:"), own))
        .when(own.startswith("/"), F.concat(F.lit(host), own))
        .when(own.startswith("?"), F.concat(F.lit(base.split("?", 1)[0]), own))
        .otherwise(F.concat(F.lit(f"{folder}/"), own))
    )
