"""Documents within two steps of an opportunity's pages, with the caps of a polite crawl.

Pages are a table; links are taken out of it once. From at most SEEDS pages of an opportunity, links that
look like the way to a package are followed on the seeds' own origins: a first step costs itself and all second
steps from it, first steps go on while fewer than FIRST are spent, second ones while fewer than ALL are. The
order is that of the pages, so the caps are sums over windows, not loops; all opportunities are crawled together by two joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .documents import FILE_NAME, TEXT_HINT, URL_HINT, absolute
from .evidence import ANCHOR

SEEDS, FIRST, ALL, DOCUMENTS = 4, 12, 16, 60


def origin(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^(https?://[^/?#]+)", 1))


def page_links(pages: DataFrame) -> DataFrame:
    """For each page of ``url``, ``html`` its links in order, each target once: ``pos``, ``target``, whether it is a
    document and whether it is worth following."""
    pairs = F.arrays_zip(F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(2)).alias("label"))
    each = pages.select("url", F.posexplode(pairs).alias("pos", "link"))
    target = F.regexp_replace(absolute(F.col("url"), F.replace("link.href", F.lit("&amp;"), F.lit("&"))), "#.*$", "")
    told = each.select("url", "pos", target.alias("target"), F.regexp_replace("link.label", "<[^>]+>", " ").alias("label")).where("target is not null")
    is_document = F.col("target").rlike(FILE_NAME)
    hinted = F.col("label").rlike(TEXT_HINT) | (F.col("target").rlike(URL_HINT) & F.col("target").rlike(TEXT_HINT))
    kinds = told.select("url", "target", "pos", is_document.alias("is_document"), (~is_document & hinted).alias("follow"))
    return kinds.groupBy("url", "target").agg(F.min("pos").alias("pos"), F.max("is_document").alias("is_document"), F.max("follow").alias("follow"))


def _rank(*by: str | Column, within: list[str]) -> Column:
    return F.row_number().over(Window.partitionBy(*within).orderBy(*by))


def _steps(frontier: DataFrame, links: DataFrame, origins: DataFrame, keep: list[str]) -> DataFrame:
    """Links worth following from the ``page`` of each row, on an origin of the opportunity."""
    out = frontier.join(links.where("follow"), frontier["page"] == links["url"]).select(*keep, "pos", "target")
    return out.withColumn("origin", origin(F.col("target"))).join(origins, ["id", "origin"], "left_semi").drop("origin")


def documents(seeds: DataFrame, pages: DataFrame) -> DataFrame:
    """``id``, ``target``, ``rank``: of each opportunity (``id``, ``n``: the place of the seed, ``url``) at most DOCUMENTS documents."""
    links = page_links(pages)
    kept = seeds.where(F.col("n") < SEEDS).select("id", "n", F.col("url").alias("page"))
    origins = kept.select("id", origin(F.col("page")).alias("origin")).distinct()
    first = _steps(kept, links, origins, ["id", "n"]).groupBy("id", "target").agg(F.min(F.struct("n", "pos")).alias("at"))
    first = first.withColumn("i", _rank("at", "target", within=["id"])).select("id", "i", F.col("target").alias("page"))
    second = _steps(first, links, origins, ["id", "i"]).withColumn("j", _rank("pos", "target", within=["id", "i"]))
    cost = second.groupBy("id", "i").agg(F.count("*").alias("deep"))
    spent = F.coalesce(F.sum(1 + F.coalesce("deep", F.lit(0))).over(Window.partitionBy("id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    followed = first.join(cost, ["id", "i"], "left").withColumn("spent", spent).where(F.col("spent") < FIRST).select("id", "i", "page", "spent")
    deeper = second.join(followed.select("id", "i", "spent"), ["id", "i"]).where(F.col("spent") + F.col("j") < ALL).select("id", "i", "j", F.col("target").alias("page"))
    read = kept.select("id", F.lit(-1).alias("i"), F.col("n").alias("j"), "page").union(followed.select("id", "i", F.lit(0), "page")).union(deeper)
    found = read.join(links.where("is_document"), read["page"] == links["url"]).groupBy("id", "target").agg(F.min(F.struct("i", "j", "pos")).alias("at"))
    return found.withColumn("rank", _rank("at", "target", within=["id"])).where(F.col("rank") <= DOCUMENTS).select("id", "target", "rank")
