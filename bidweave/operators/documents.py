"""Document catalog: links found on pages and in payloads, inserted once, refreshed and revived."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evidence import ANCHOR

# Endings of file names, and words of links that lead to documents.
FILE_NAME = r"(?i)\.(pdf|docx?|xlsx?|csv|zip|txt|dotx?)(?:$|[?#])"
URL_HINT = "(?i)download|attachment|document|file|resource|solicitation|specification|addendum|amendment|bid[-_ ]?package|rfp|rfq|ifb"
TEXT_HINT = "(?i)download|attachment|document|specification|scope of work|statement of work|solicitation|addendum|amendment|bid package|pricing|bid form|rfp|rfq|ifb"


def absolute(base: Column, href: Column) -> Column:
    """``href`` as seen from ``base``; other schemes than http are null."""
    root = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    folder = F.regexp_extract(base, r"^(https?://[^/?#]+(?:/[^?#]*/)?)", 1)
    return (
        F.when(href.rlike("(?i)^https?://"), href)
        .when(href.rlike("^//"), F.concat(F.regexp_extract(base, r"^(https?:)", 1), href))
        .when(href.rlike("(?i)^[a-z][a-z0-9+.-]*:"), None)
        .when(href.rlike("^/"), F.concat(root, href))
        .when(href.rlike("^[?#]"), F.concat(F.regexp_replace(base, r"[?#].*$", ""), href))
        .otherwise(F.concat(F.regexp_replace(folder, "/+$", ""), F.lit("/"), href))
    )


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^https?://([^/:?#]+)", 1))


def is_public(url: Column) -> Column:
    """Hosts that may be fetched; private ranges are left out."""
    return url.rlike("(?i)^https?://") & ~host(url).rlike(r"^localhost$|\.local$|^127\.|^10\.|^192\.168\.|^169\.254\.")


def page_documents(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", most: int = 60) -> DataFrame:
    """Links of each page that look like documents, in page order, each target once."""
    pairs = F.arrays_zip(F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(1)).alias("href"), F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(2)).alias("label"))
    each = pages.select(key, url, F.posexplode(pairs).alias("pos", "link"))
    target = absolute(F.col(url), F.col("link.href"))
    able = each.select(key, "pos", target.alias("target"), F.regexp_replace("link.label", "<[^>]+>", " ").alias("label")).where("target is not null")
    able = able.where(F.col("target").rlike(FILE_NAME) | F.col("target").rlike(URL_HINT) | F.col("label").rlike(TEXT_HINT))
    first = able.groupBy(key, "target").agg(F.min("pos").alias("pos"))
    return first.groupBy(key).agg(F.slice(F.sort_array(F.collect_list(F.struct("pos", "target"))), 1, most).alias("d")).select(key, F.explode("d").alias("d")).select(key, "d.pos", "d.target")


def second_hop(pages: DataFrame, found: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Documents of the pages that a page's links lead to on its own host."""
    start = pages.select(F.col(key).alias("start"), host(F.col(url)).alias("_host"))
    steps = found.select(F.col(key).alias("start"), F.col("target").alias(url)).join(start, "start").where(host(F.col(url)) == F.col("_host"))
    linked = steps.select("start", url).distinct().join(pages.select(url, html), url)
    return page_documents(linked, "start", url, html)


def payload_links(records: DataFrame, links: str = "resource_links", key: str = "id") -> DataFrame:
    """Distinct http links of a payload's list."""
    each = records.select(key, F.explode(F.array_distinct(links)).alias("target"))
    return each.where(F.col("target").rlike("(?i)^https?://"))


def insert_absent(stored: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``found`` whose keys are not stored yet, each once."""
    return found.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")


def refresh(stored: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Stored documents with the new address of those found again; failed ones among them are revived."""
    new = found.groupBy(*keys).agg(F.max("source_url").alias("_url"))
    joined = stored.join(new, keys, "left")
    again = F.col("_url").isNotNull()
    revived = again & F.col("extraction_status").isin("fetch_failed", "fetch_invalid", "dead")
    return joined.withColumns({
        "extraction_status": F.when(revived, "cataloged").otherwise(F.col("extraction_status")),
        "source_url": F.coalesce("_url", "source_url"),
    }).drop("_url")


def fetched_kind(head: Column, size: Column, most: int = 32 << 20) -> Column:
    """What a fetched body is, by its first bytes and size."""
    start = F.substring(head, 1, 4)
    return (
        F.when(size > most, "fetch_too_large")
        .when(start.isin("%PDF") | start.startswith("PK"), "fetched")
        .when(F.lower(F.ltrim(head)).rlike("^<(!doctype )?html"), "fetch_invalid")
        .otherwise("fetched")
    )
