"""Text functions as Column expressions; all of them stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII word edges; Java's own would also see accented letters as word characters.
LEFT, RIGHT = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def worded(pattern: str) -> str:
    """Case-blind regex for ``pattern`` between ASCII word edges."""
    return f"(?i){LEFT}(?:{pattern}){RIGHT}"


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def trimmed(c: Column) -> Column:
    """Trimmed, or null if nothing is left."""
    return blank_to_null(F.trim(c))


def squeezed(c: Column) -> Column:
    """White space of any kind, no-break spaces included, turned into single spaces; trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def plain(c: Column) -> Column:
    """Lower case, everything but ASCII letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def state_code(c: Column) -> Column:
    up = F.upper(F.trim(c))
    return F.when(F.length(up) == 2, up)


def location(city: Column, state: Column, country: Column | None = None) -> Column:
    city, state = blank_to_null(city), blank_to_null(state)
    parts = [F.when(city.isNotNull() & state.isNotNull(), F.concat(city, F.lit(", "), state)), city, state]
    return F.coalesce(*parts, *([] if country is None else [blank_to_null(country)]), F.lit("Location not stated"))


def agency_name(path: Column, office: Column, subtier: Column, department: Column) -> Column:
    """Last step of a dotted path, else the narrowest unit that has a name."""
    steps = F.filter(F.transform(F.split(path, r"\."), lambda x: F.trim(x)), lambda s: s != "")
    return F.coalesce(F.get(F.reverse(steps), F.lit(0)), trimmed(office), trimmed(subtier), trimmed(department), F.lit("Federal agency"))


def without_doubling(c: Column) -> Column:
    """A text that is one part written twice in a row, once."""
    half = F.length(c).cast("int") / 2
    front = F.substring(c, F.lit(1), half.cast("int"))
    even = (F.length(c) % 2 == 0) & (F.length(c) > 0)
    return F.when(even & (front == F.substring(c, half.cast("int") + 1, half.cast("int"))), F.trim(front)).otherwise(c)


def title_case(c: Column) -> Column:
    """Capital first letters of ASCII words; other letters stay as they are."""
    words = F.split(F.regexp_replace(F.trim(c), r"\s+", " "), " ")
    up = F.transform(words, lambda w: F.when(w.rlike("^[a-z]"), F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))).otherwise(w))
    return F.array_join(up, " ")


def money(c: Column) -> Column:
    """First dollar amount, with its million or thousand unit."""
    pattern = r"(?i)\$\s*([\d,.]+)\s*(million|m|thousand|k)?"
    number = F.regexp_extract(c, pattern, 1)
    unit = F.lower(F.regexp_extract(c, pattern, 2))
    scale = F.when(unit.isin("million", "m"), 1_000_000).when(unit.isin("thousand", "k"), 1_000).otherwise(1)
    return F.regexp_replace(number, ",", "").try_cast("double") * scale


def shown_money(c: Column) -> Column:
    """Whole dollars with thousands apart, halves away from zero; the sign before the dollar."""
    whole = F.round(F.abs(c)).cast("decimal(38,0)")
    return F.concat(F.when((c < 0) & (whole > 0), "-").otherwise(""), F.lit("$"), F.format_number(whole, 0))


def visible_text(html: Column) -> Column:
    """Lines of text of simple markup: references are decoded first, so that written-out tags go too."""
    steps = [
        ("(?i)&nbsp;", " "), ("(?i)&amp;", "&"), ("&#39;", "'"), ("(?i)&quot;", '"'), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"),
        (r"(?is)<script.*?</script>", " "), (r"(?is)<style.*?</style>", " "), (r"(?i)<br\s*/?\s*>", "\n"),
        (r"(?i)</(p|div|li|tr|h[1-6]|section|article)>", "\n"), ("<[^>]+>", " "), (r"[ \t]+", " "), (r"\n{2,}", "\n"),
    ]
    for pattern, by in steps:
        html = F.regexp_replace(html, pattern, by)
    return html


def stable_uuid(c: Column) -> Column:
    """UUID-shaped id from a SHA-256: version digit 5, variant bits as the standard has them."""
    h = F.sha2(c, 256)
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("long").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def content_hash(*columns: str) -> Column:
    """SHA-256 of the named columns as JSON, in the order of their names."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def comma_list(c: Column, upper: bool = True) -> Column:
    """Items between commas or line ends, trimmed, blanks dropped."""
    items = F.filter(F.transform(F.split(c, "[\n,]"), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(items, F.upper) if upper else items


def plural(n: Column, one: str, many: str) -> Column:
    return F.when(n == 1, one).otherwise(many)
