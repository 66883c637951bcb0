"""A project's nested detail: attachments, requirements and evaluation facts, each once.

A detail is one JSON document for each opportunity. Its lists are read by one schema and exploded; an attachment that
is listed twice, by the project and by one of its questionnaires, is known by its path, else its id, its
link or its name, and the later one counts. What is stored already is not inserted again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import first_match
from ..functions.text import squeezed, worded

_FILE = "struct<path:string,id:long,url:string,filename:string,name:string,title:string,fileExtension:string>"
DETAIL = (
    f"id long, title string, attachments array<{_FILE}>, criteria array<struct<id:long,title:string,description:string,isHiddenByLogic:boolean>>,"
    f" questionnaires array<struct<id:long,title:string,prompt:string,isRequired:boolean,type:string,attachments:array<{_FILE}>>>,"
    " evaluationPhases array<struct<scoringCriteria:array<struct<id:long,title:string,description:string,weight:double>>>>"
)
#: What ``requirements`` reads of a detail.
ASKED = "criteria array<struct<title:string,description:string,isHiddenByLogic:boolean>>, questionnaires array<struct<title:string,prompt:string,isRequired:boolean>>"

# Categories of requirements by words, in order, and words that make a text one.
CATEGORIES = (
    ("insurance", "(?i)insurance|insured|liability|workers.? compensation"),
    ("bonding", "(?i)bond|bonding"),
    ("certification", "(?i)certif|affidavit|registration|disclosure|questionnaire"),
    ("pricing", "(?i)price|pricing|fee|cost"),
    ("evaluation", "(?i)evaluation|award|score|weight"),
    ("technical", "(?i)scope|technical|training|specification|service"),
    ("submission_requirement", "(?i)submit|submission|proposal|bid package|return with"),
)
OTHER_CATEGORY = "other_requirement"
REQUIRED = worded("shall|must|required|submit|failure to|will be cause|shall provide|shall include")


def read(details: DataFrame, key: str = "id", body: str = "detail", schema: str = DETAIL) -> DataFrame:
    """``key`` and ``d``, the parsed detail, or what ``schema`` names of it; of a text that is no such JSON it is null or has no lists.

    A filter would be pushed under the parse and have every text made and parsed twice.
    """
    return details.select(key, F.from_json(body, schema).alias("d"))


def shown(html: Column) -> Column:
    """Text of a fragment of markup; empty for none."""
    plain = F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]*>", " ")
    for reference, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(reference), F.lit(sign))
    return squeezed(plain)


def _named(*parts: Column) -> Column:
    """Parts that are not empty, told by a colon."""
    return F.array_join(F.filter(F.array(*parts), lambda x: F.coalesce(x, F.lit("")) != ""), ": ")


def attachments(parsed: DataFrame, key: str = "id") -> DataFrame:
    """``filename`` and ``source_url`` of every attachment with a link: one row for each of its keys, the last of the list, and of
    attachments of one name the first."""
    own = F.coalesce("d.attachments", F.array())
    asked = F.flatten(F.transform(F.coalesce("d.questionnaires", F.array()), lambda q: F.coalesce(q["attachments"], F.array())))
    each = parsed.select(key, F.posexplode(F.concat(own, asked)).alias("pos", "a"))
    known = F.coalesce(F.nullif("a.path", F.lit("")), F.concat(F.lit("attachment:"), F.nullif("a.id", F.lit(0)).cast("string")), F.nullif("a.url", F.lit("")), F.nullif("a.filename", F.lit("")))
    one = each.withColumn("known", known).where("known is not null").groupBy(key, "known").agg(F.max_by("a", "pos").alias("a"), F.min("pos").alias("pos"))
    stated = [F.nullif(F.col(f"a.{c}"), F.lit("")) for c in ("filename", "name", "title")]
    made = F.concat(F.lit("opengov-"), F.coalesce(F.col("a.id").cast("string"), F.lit("attachment")), F.coalesce("a.fileExtension", F.lit("")))
    named = one.where(F.coalesce("a.url", F.lit("")) != "").select(key, "pos", F.coalesce(*stated, made).alias("filename"), F.col("a.url").alias("source_url"))
    first = F.row_number().over(Window.partitionBy(key, "filename").orderBy("pos"))
    return named.withColumn("_r", first).where("_r = 1").select(key, "filename", "source_url")


def requirements(parsed: DataFrame, key: str = "id") -> DataFrame:
    """Criteria that are shown and ask for something, and required questionnaires: ``category``, ``requirement_text``, each text once.

    Both lists of a detail become texts before they are exploded, so that a detail is parsed once and a text made once; the plain
    explode would be given a filter that makes the texts again.
    """
    seen = F.filter(F.coalesce("d.criteria", F.array()), lambda c: ~F.coalesce(c["isHiddenByLogic"], F.lit(False)))
    asked = F.filter(F.transform(seen, lambda c: _named(shown(c["title"]), shown(c["description"]))), lambda t: t.rlike(REQUIRED))
    wanted = F.filter(F.coalesce("d.questionnaires", F.array()), lambda q: F.coalesce(q["isRequired"], F.lit(False)))
    answers = F.transform(wanted, lambda q: _named(F.coalesce(F.nullif(q["title"], F.lit("")), F.lit("Required response item")), shown(q["prompt"])))
    both = parsed.select(key, F.explode_outer(F.array_distinct(F.concat(asked, answers))).alias("requirement_text")).where("requirement_text is not null")
    return both.distinct().select(key, first_match(F.col("requirement_text"), CATEGORIES, OTHER_CATEGORY).alias("category"), "requirement_text")


def evaluation_facts(parsed: DataFrame, key: str = "id") -> DataFrame:
    """Scoring criteria of all phases: ``source_text`` and ``weight``, each text once, of several weights the greatest."""
    each = parsed.select(key, F.explode("d.evaluationPhases").alias("p")).select(key, F.explode("p.scoringCriteria").alias("s"))
    weight = F.regexp_replace(F.col("s.weight").cast("decimal(18,6)").cast("string"), r"\.?0+$", "")
    told = F.concat(F.coalesce(F.nullif("s.title", F.lit("")), F.lit("Evaluation criterion")), F.coalesce(F.concat(F.lit(" — "), weight, F.lit("%")), F.lit("")))
    text = F.concat(told, F.coalesce(F.concat(F.lit(": "), F.nullif(shown(F.col("s.description")), F.lit(""))), F.lit("")))
    return each.select(key, text.alias("source_text"), F.col("s.weight").alias("weight")).groupBy(key, "source_text").agg(F.max("weight").alias("weight"))


def absent(found: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """What is not stored yet."""
    return found.join(stored.select(*keys), keys, "left_anti")


def refreshed(found: DataFrame, stored: DataFrame, key: str = "id") -> DataFrame:
    """Stored attachments without a stored file whose link has changed, with the new link."""
    old = stored.select(key, "filename", F.col("source_url").alias("old_url"), "storage_key")
    return found.join(old, [key, "filename"]).where("storage_key is null and source_url <> old_url").select(key, "filename", "source_url")
