"""Evidence lines: facts, requirements, contacts and links mined from texts and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import CATEGORIES_V1, CATEGORIES_V2, ROLE_RULES, first_match
from ..functions.text import squeezed, title_case, visible_text, worded

# What e-mail addresses, phone numbers, links to people and words of duty look like.
EMAIL = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
PHONE = r"(?:\+?1[\s.-]?)?\(?\d{3}\)?[\s.-]\d{3}[\s.-]\d{4}"
LINK_TERMS = "(?i)staff|directory|administration|leadership|technology|information.?technology|security|safety|facilities|operations|procurement|purchasing|board"
ANCHOR = r"""(?is)<a\b[^>]*href=["']([^"']+)["'][^>]*>(.*?)</a>"""
MODAL = worded("shall|must|required to|are required to|is required to")

# Facts by type: what to find, the group that holds the value (0: the whole line), and what else must hold.
FACTS = (
    ("solicitation_number", worded(r"(?:solicitation|contract)\s+(?:no\.?|number|#)\s*[:#-]?\s*([A-Z0-9][A-Z0-9-]{6,39})"), 1, ("[0-9]", "(?i)[A-Z]")),
    ("amendment_number", worded(r"amendment\s+(?:no\.?|number|#)\s*[:#-]?\s*([A-Z0-9][A-Z0-9-]{0,12})"), 1, (r"\d",)),
    ("naics_code", worded(r"NAICS(?![A-Za-z0-9_])[^0-9]{0,24}(\d{6})"), 1, ()),
    ("set_aside", r"(?i)(?<![A-Za-z0-9_])(8\(a\)(?=\w)|HUBZone(?!\w)|SDVOSB(?!\w)|WOSB(?!\w)|service[- ]disabled veteran[- ]owned small business(?!\w)|women[- ]owned small business(?!\w)|small business set[- ]aside(?!\w)|total small business set[- ]aside(?!\w))", 1, ()),
    ("response_deadline", "(?s)^.*$", 0, (worded("(?:response|offer|proposal|quote|quotation|bid)s?"), worded("due|deadline|closing|close date"))),
    ("submission_instruction", "(?s)^.*$", 0, (worded("offerors? shall submit|quotes? shall be submitted|proposals? shall be submitted|submit (?:offers?|quotes?|proposals?)"),)),
    ("evaluation_criteria", "(?s)^.*$", 0, (worded("evaluation criteria|basis for award|award will be made|lowest price technically acceptable|best value"),)),
)
# How many facts a text has at most, lines that are no requirements, names of forms that are none.
MOST_FACTS = 30
EXCLUDED_V1 = (worded("if required"), worded(r"not\s+(?:is\s+)?required"))
EXCLUDED_V2 = (
    worded("if required|not required|not is required"),
    worded("internal revenue service|taxpayer identification|social security number|tax return"),
)
BOILERPLATE_NAME = "(^| )(w 9|w9|form 1295|1295 form|certificate of interested parties)( |$)"


def _spread(rows: DataFrame) -> DataFrame:
    """Rows of a few files of one row group each would be read, split and searched by as few tasks: dealt to more."""
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(tasks) if len(rows.inputFiles()) < tasks else rows


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``line`` (from 1) and the squeezed ``content`` of every line with content."""
    split = _spread(docs.select(key, text)).select(key, F.posexplode(F.split(text, r"\r?\n")).alias("pos", "raw")).where(F.col("raw").rlike(r"(?U)\S"))
    return split.select(key, (F.col("pos") + 1).alias("line"), squeezed(F.col("raw")).alias("content")).where("content <> ''")


def facts(numbered: DataFrame, key: str = "doc_id", rules: tuple = FACTS, most: int = MOST_FACTS) -> DataFrame:
    """Facts of numbered lines: the first of each type and value, ``most`` of a document in line order."""
    found = []
    for rank, (kind, pattern, group, also) in enumerate(rules):
        value = F.regexp_extract("content", pattern, group)
        tested = value if group else F.col("content")
        holds = F.col("content").rlike(pattern)
        for extra in also:
            holds = holds & tested.rlike(extra)
        found.append(F.when(holds, F.struct(F.lit(kind).alias("fact_type"), F.lit(rank).alias("rank"), squeezed(value).alias("value"))))
    each = numbered.select(key, "line", "content", F.explode(F.array_compact(F.array(*found))).alias("f")).select(key, "line", "content", "f.*")
    first = F.row_number().over(Window.partitionBy(key, "fact_type", F.lower("value")).orderBy("line", "rank"))
    distinct = each.withColumn("_first", first).where("_first = 1")
    place = F.row_number().over(Window.partitionBy(key).orderBy("line", "rank"))
    return distinct.withColumn("_place", place).where(F.col("_place") <= most).select(key, "line", "fact_type", "value")


def requirements(numbered: DataFrame, key: str = "doc_id", version: int = 2, modal: str = MODAL) -> DataFrame:
    """Mandatory lines with their category; the two rule sets differ and are kept apart."""
    categories, excluded, longest, most = (CATEGORIES_V1, EXCLUDED_V1, 500, 25) if version == 1 else (CATEGORIES_V2, EXCLUDED_V2, 600, 40)
    able = numbered.where(F.length("content").between(25, longest) & F.col("content").rlike(modal))
    for pattern in excluded:
        able = able.where(~F.col("content").rlike(pattern))
    first = F.row_number().over(Window.partitionBy(key, F.lower("content")).orderBy("line"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("line"))
    kept = able.withColumn("_first", first).where("_first = 1").withColumn("_place", place).where(F.col("_place") <= most)
    return kept.select(key, "line", first_match(F.col("content"), categories, "submission_requirement").alias("category"), F.col("content").alias("requirement"))


def is_boilerplate(filename: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(filename), "[^a-z0-9]+", " ")).rlike(BOILERPLATE_NAME)


def plausible_name(c: Column) -> Column:
    """A person's name in title case, or null where the text cannot be one."""
    s = F.trim(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z.' -]", " "), r"\s+", " "))
    parts = F.size(F.split(s, " "))
    fine = F.length(s).between(5, 60) & parts.between(2, 5) & ~s.rlike("(?i)director|superintendent|technology|security|facilities|board|department|school|district|office")
    return F.when(fine, title_case(s))


def page_lines(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Trimmed lines of each page's visible text, numbered without the empty ones."""
    rows = F.filter(F.transform(F.split(visible_text(F.col(html)), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return _spread(pages.select(key, html)).select(key, F.posexplode_outer(rows).alias("line", "content")).where("content is not null")


def contacts(numbered: DataFrame, key: str = "page_id", rules: tuple = ROLE_RULES, most: int = 20) -> DataFrame:
    """People near lines that name a role: two lines before to three after are searched.

    What a line says by itself (its role, name and address) is found once, before the windows; no address holds white space, so
    the first of the lines around is the first of their joined text. A number may stand across two lines.
    """
    w = Window.partitionBy(key).orderBy("line")
    bare = plausible_name(F.regexp_replace(F.regexp_replace("content", EMAIL, ""), PHONE, ""))
    told = numbered.select(key, "line", "content", F.struct(first_match(F.col("content"), rules, None).alias("role"), bare.alias("name"), F.nullif(F.regexp_extract("content", EMAIL, 0), F.lit("")).alias("email")).alias("own"))
    around = F.coalesce(F.lag("own.name", 1).over(w), F.lead("own.name", 1).over(w), F.lag("own.name", 2).over(w), F.lead("own.name", 2).over(w))
    near = w.rowsBetween(-2, 3)
    wide = told.select(key, "line", "content", F.col("own.role").alias("role_family"), around.alias("around"), F.first("own.email", ignorenulls=True).over(near).alias("email"), F.collect_list("content").over(near).alias("near"))
    hits = wide.where("role_family is not null and (around is not null or email is not null)")
    local = plausible_name(F.regexp_replace(F.substring_index("email", "@", 1), "[._-]+", " "))
    found = F.struct(F.when(F.col("around").isNotNull(), F.col("around")).otherwise(local).alias("name"), F.nullif(F.regexp_extract(F.array_join("near", " "), PHONE, 0), F.lit("")).alias("phone"))
    named = hits.select("*", F.explode(F.array(found)).alias("found")).select(key, "line", "content", "role_family", "email", "found.*").where("name is not null")
    named = named.withColumn("confidence", F.when(F.col("email").isNotNull(), 88).when(F.col("phone").isNotNull(), 82).otherwise(72)).withColumn("title", F.substring("content", 1, 120))
    best = F.row_number().over(Window.partitionBy(key, F.lower("name"), F.lower("title")).orderBy(F.desc("confidence"), "line"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("line"))
    kept = named.withColumn("_best", best).where("_best = 1").withColumn("_place", place).where(F.col("_place") <= most)
    return kept.select(key, "line", "name", "title", "role_family", "email", "phone", "confidence")


def links(pages: DataFrame, key: str = "page_id", html: str = "html", terms: str = LINK_TERMS, most: int = 6) -> DataFrame:
    """The first ``most`` distinct hrefs of a page whose target or label names a term."""
    pairs = F.arrays_zip(F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(1)).alias("href"), F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(2)).alias("label"))
    each = pages.select(key, F.posexplode(pairs).alias("pos", "link")).select(key, "pos", "link.href", "link.label")
    able = each.where(F.concat(visible_text(F.col("label")), F.lit(" "), F.col("href")).rlike(terms))
    first = able.groupBy(key, "href").agg(F.min("pos").alias("pos"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("pos"))
    return first.withColumn("place", place).where(F.col("place") <= most).select(key, "place", "href")
