"""Agency kinds, solicitation types, status and host classes: ordered rules, the first hit decides.

Precedence differs between the families on purpose: most look for schools first, some for
universities.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import confidence, filled, first_match
from .text import worded

# Agency kinds by words of the name, for each family of sources, in order.
_AUTHORITY = ("authority", "authority|commission|district")
AGENCY_RULES: dict[str, tuple[tuple[tuple[str, str], ...], str]] = {
    "open_portals": (
        (
            ("k12", "school district|public schools|unified school|school system|schools(?![a-z0-9_])|isd(?![a-z0-9_])"),
            ("higher_ed", "university|community college|(?<![a-z0-9_])college(?![a-z0-9_])|higher education"),
            ("state_agency", "state of |state government|department of .*state"),
            ("county", "(?<![a-z0-9_])county(?![a-z0-9_])"),
            ("municipal", "(?<![a-z0-9_])city of(?![a-z0-9_])|(?<![a-z0-9_])town of(?![a-z0-9_])|(?<![a-z0-9_])village of(?![a-z0-9_])|(?<![a-z0-9_])borough of(?![a-z0-9_])"),
            ("authority", "airport|transit|transportation authority|port authority|water|utility|authority|district"),
        ),
        "local_agency",
    ),
    "periscope": (
        (
            ("k12", "school district|public schools|school department|board of education|elementary|secondary education"),
            ("higher_ed", "university|college|community college|higher education"),
            ("county", "county"),
            ("municipality", "city of|town of|village of|borough of|municipal"),
            _AUTHORITY,
        ),
        "state_agency",
    ),
    "alabama": ((("k12", "school|education|academy"), ("higher_ed", "university|college"), ("county", "county"), ("municipality", "city|town|municipal"), _AUTHORITY), "state_agency"),
    "arizona": (
        (
            ("k12", "school|academy|school district|(?<![a-z0-9_])isd(?![a-z0-9_])"),
            ("higher_ed", "university|college|community college|board of regents"),
            ("county", "county"),
            ("municipality", "city|town|municipal|tribe|tribal|indian community"),
            ("authority", "authority|commission|district|airport"),
        ),
        "state_agency",
    ),
    "california": ((("higher_ed", "university|college|cal state|state university"), ("k12", "school|education"), _AUTHORITY), "state_agency"),
    "advantage": (
        (
            ("k12", "school|public schools|academy|intermediate school district|(?<![a-z0-9_])isd(?![a-z0-9_])"),
            ("higher_ed", "university|college|community college|higher education"),
            ("county", "county"),
            ("municipality", "city|township|village|borough|municipal"),
            ("authority", "authority|commission|district|airport"),
        ),
        "state_agency",
    ),
    "florida": ((("education", "university|college|school"), ("local_agency", "county|city|town|municip|district")), "state_agency"),
    "hawaii": ((("education", "university|education|school"), ("local_agency", "county|city|water supply|rapid transit|municip")), "state_agency"),
    "louisiana": (
        (
            ("k12", "school board|school district|schools|education"),
            ("higher_ed", "university|college"),
            ("county", "parish"),
            ("municipality", "city of|town of|municipal"),
            ("authority", "authority|commission|district|port|transit"),
        ),
        "state_agency",
    ),
    "new_york": (
        (
            ("k12", "school district|public schools|board of education|(?<![a-z0-9_])schools(?![a-z0-9_])|(?<![a-z0-9_])academy(?![a-z0-9_])"),
            ("higher_ed", "state university|(?<![a-z0-9_])suny(?![a-z0-9_])|city university|(?<![a-z0-9_])cuny(?![a-z0-9_])|university|college"),
            ("county", "(?<![a-z0-9_])county(?![a-z0-9_])"),
            ("municipality", "(?<![a-z0-9_])town of(?![a-z0-9_])|(?<![a-z0-9_])city of(?![a-z0-9_])|(?<![a-z0-9_])village of(?![a-z0-9_])|municipal"),
            ("authority", "authority|commission|district|corporation|public benefit"),
        ),
        "state_agency",
    ),
    "oklahoma": ((("higher_ed", "university|college|higher education|career and tech"), ("k12", "school|education")), "state_agency"),
    "virginia": (
        (
            ("higher_ed", "university|college|community college"),
            ("k12", "school|public schools|school board"),
            ("local_government", "^city of |^town of |^county of | county$"),
            _AUTHORITY,
        ),
        "state_agency",
    ),
    "mississippi": ((("education", "university|college|school|education"), ("local_agency", "county|city|town|village|municip|utility|water|airport|authority|district")), "state_agency"),
    "north_carolina": (
        (
            ("k12", "school|board of education|public schools|academy"),
            ("higher_ed", "university|college|community college"),
            ("county", "(?<![a-z0-9_])county(?![a-z0-9_])"),
            ("municipality", "(?<![a-z0-9_])city(?![a-z0-9_])|(?<![a-z0-9_])town(?![a-z0-9_])|(?<![a-z0-9_])village(?![a-z0-9_])|municipal"),
            _AUTHORITY,
        ),
        "state_agency",
    ),
    "nebraska": ((("k12", "school|education"), ("higher_ed", "university|college"), ("county", "county"), ("municipality", "city|town|village|municipal")), "state_agency"),
    "washington": ((("k12", "school|school district|public instruction"), ("higher_ed", "university|college|community college"), ("county", "county"), ("municipality", "city|town|municipal")), "state_agency"),
    "wyoming": ((("k12", "education|school"), ("higher_ed", "university|college")), "state_agency"),
    "none": ((), "state_agency"),
}
#: The level of government of each kind of agency, where it is not "local".
STATE_LEVEL: dict[str, tuple[str, ...]] = {
    "florida": ("state_agency",), "mississippi": ("state_agency",), "hawaii": ("education", "state_agency"), "virginia": ("higher_ed", "state_agency"), "periscope": ("higher_ed", "state_agency"),
    "arizona": ("higher_ed", "state_agency"), "advantage": ("higher_ed", "state_agency"), "california": ("higher_ed", "k12", "authority", "state_agency"), "north_carolina": ("higher_ed", "authority", "state_agency"),
    "nebraska": ("k12", "higher_ed", "state_agency"), "washington": ("k12", "higher_ed", "state_agency"), "wyoming": ("k12", "higher_ed", "state_agency"), "none": ("state_agency",),
}

# Solicitation types by words of the title or number, in order, with what stands where none hits.
SOLICITATION_RULES: dict[str, tuple[tuple[tuple[str, str], ...], str]] = {
    "louisiana": (
        (("RFP", f"{worded('RFP')}|request for proposal"), ("RFQ", f"{worded('RFQ')}|request for quotation"), ("RFI", f"{worded('RFI')}|request for information"), ("IFB", f"{worded('IFB')}|invitation for bid")),
        "State/local solicitation",
    ),
    "delaware": (
        (("RFP", f"{worded('RFP')}|request for proposals?"), ("RFQ", f"{worded('RFQ')}|request for quotations?|request for qualifications?"), ("RFI", f"{worded('RFI')}|request for information"), ("ITB", f"{worded('ITB')}|invitation to bid")),
        "State solicitation",
    ),
    "texas": ((("RFI", worded("RFI")), ("RFQ", worded("RFQ")), ("RFP", f"{worded('RFP')}|RFPCSP"), ("IFB", worded("IFB|ITB"))), "Public solicitation"),
    "arkansas": ((("Request for Information", "(?i)-RFI$"), ("Request for Qualifications", "(?i)-RFQ$"), ("Request for Proposals", "(?i)-RFP$"), ("Invitation for Bids", "(?i)-IFB$")), "Solicitation"),
    "new_york": (
        (("RFI", f"(?i)request for information|{worded('rfei|rfi')}"), ("RFQ", f"(?i)request for qualifications|{worded('rfq')}"), ("RFP", f"(?i)request for proposal|{worded('rfp')}"), ("IFB", f"(?i)invitation (?:for|to) bid|{worded('ifb|itb')}"), ("Sole Source Notice", "(?i)sole source|single source")),
        "Public procurement notice",
    ),
    "north_carolina": (
        (("RFI", f"(?i)request for information|{worded('rfi')}"), ("RFQ", f"(?i)request for qualifications|{worded('rfq')}"), ("RFP", f"(?i)request for proposal|{worded('rfp')}"), ("IFB", f"(?i)invitation for bid|invitation to bid|{worded('ifb')}|{worded('itb')}")),
        "Public procurement notice",
    ),
    "hawaii": ((("Request for Information", worded("RFI")), ("Request for Proposals", worded("RFP")), ("Request for Qualifications", worded("RFQ|SOQ")), ("Invitation for Bids", f"{worded('IFB')}|(?i)^B[0-9]")), "Solicitation"),
    "south_dakota": ((("RFP", "(?i)RFP"), ("IFB", "(?i)IFB"), ("RFQ", "(?i)RFQ"), ("SOI", "(?i)SOI"), ("Prospectus", "(?i)PRO")), "Solicitation"),
    "california": ((("RFI", worded("RFI")), ("RFQ", worded("RFQ")), ("RFP", worded("RFP")), ("IFB", f"{worded('IFB')}|(?i)INVITATION FOR BID")), "Sell RFx"),
    "washington": ((("RFP", "(?i)RFP"), ("RFQ", "(?i)RFQ"), ("RFI", "(?i)RFI"), ("Bid", "(?i)IFB|ITB")), "State solicitation"),
}

#: Statuses of a project that end it when it has no deadline.
ENDED = ("closed", "evaluation", "awarded", "cancelled", "canceled")


def agency_type(name: Column, family: str) -> Column:
    rules, otherwise = AGENCY_RULES[family]
    return first_match(F.lower(name), rules, otherwise)


def jurisdiction(kind: Column) -> Column:
    return F.when(kind == "state_agency", "state").when(kind.isin("k12", "higher_ed"), "education").otherwise("local")


def level(kind: Column, family: str) -> Column:
    return F.when(kind.isin(*STATE_LEVEL[family]), "state").otherwise("local")


def solicitation_type(c: Column, family: str) -> Column:
    rules, otherwise = SOLICITATION_RULES[family]
    return first_match(c, rules, otherwise)


def project_status(deadline: Column, coming_soon: Column, status: Column, now: datetime) -> Column:
    """A deadline decides; then an announcement; then the status word."""
    return (
        F.when(deadline.isNotNull(), F.when(deadline >= F.lit(now), "open").otherwise("closed"))
        .when(F.coalesce(coming_soon, F.lit(False)), "open")
        .when(F.lower(status).isin(*ENDED), "closed")
        .otherwise("open")
    )


def host_class(adapter: Column, family: Column) -> Column:
    """Kind of host that a record's documents are fetched from."""
    return (
        F.when(adapter == "sam_gov", "sam").when(adapter.contains("opengov"), "opengov").when(adapter.contains("ionwave"), "ionwave")
        .when(family == "sled", "sled").otherwise("other")
    )


def live_confidence() -> Column:
    """Confidence of a record of the federal interface before it is stored."""
    return confidence(
        F.lit(38), (filled("response_deadline"), 8), (filled("solicitation_number"), 6), (filled("naics_code"), 6), (filled("set_aside"), 6),
        (F.col("place").isNotNull(), 5), (F.coalesce(F.size("resource_links"), F.lit(0)) > 0, 7), (filled("description"), 4),
    )


def stored_confidence() -> Column:
    """Confidence of a stored record in its detail view."""
    return confidence(
        F.when(F.col("source_family") == "federal", 38).otherwise(42), (F.col("due_at").isNotNull(), 10), (filled("solicitation_number"), 7),
        (F.size("naics_codes") > 0, 5), (filled("set_aside"), 5), (filled("city") | filled("state_code"), 5), (F.coalesce(F.size("resource_links"), F.lit(0)) > 0, 7),
        (filled("description"), 4), (F.col("pre_proposal_at").isNotNull(), 4), (F.col("questions_due_at").isNotNull(), 3),
    )


# What a card says where there is nothing of the record's own to say.
CARD_MATCHED = "Profile criteria matched this opportunity."
CARD_VERIFIED = "Source record verified; document intelligence is available on demand."


def card_insight() -> Column:
    """What a card shows: match reasons if it was ranked, doubts if confidence is low, else a fact."""
    reasons = F.array_join(F.slice("match_reasons", 1, 3), " \u00b7 ")
    ranked = F.coalesce(F.nullif(reasons, F.lit("")), F.lit(CARD_MATCHED))
    doubt, fact = F.get("uncertainty", F.lit(0)), F.get("verified", F.lit(0))
    shown = F.when(F.col("match_score").isNotNull(), ranked).when(F.col("confidence") < 75, doubt).otherwise(fact)
    return F.coalesce(F.nullif(shown, F.lit("")), F.lit(CARD_VERIFIED))
