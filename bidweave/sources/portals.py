"""Landed pages of the portals to canonical records.

A landed page is a row (source, page, reported, body): ``reported`` is the total where a portal tells it by
itself, otherwise it stands in the body. Each portal says how its rows are found (JSON array, embedded JSON,
table, delimited text), which value a row is known by, and what each column of a record is; reading,
dates, stale rows, repeated keys and gates are the same for all. JSON is read as VARIANT, so only the values that a mapping
names are ever taken out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.classify import agency_type, level, project_status, solicitation_type
from ..functions.text import agency_name
from ..functions.zones import clock, iso
from ..operators.duedates import with_instants
from ..operators.sweeps import EXACT, NONE, PARSED, SOME
from .embedded import embedded_object, named_object
from .grids import delimited, table_rows
from .landed import dotnet_date
from .records import COLUMNS, absolute, canonical, payload, text

Field = Callable[[str], Column]
SLASHED_DAY = r"\d{1,2}/\d{1,2}/\d{2,4}"


@dataclass(frozen=True)
class Portal:
    """``dates`` names the rule of the date table; ``by_deadline`` says that the deadline, where there is one, decides the
    status; ``grace`` is how many seconds after its due date a row still counts."""

    state: str | None
    read: str  # json, embedded, table, csv
    items: str  # path of the array, or name of the embedded object
    labels: tuple[str, ...]  # headers that a table must have
    total: tuple[str, ...]  # paths of the total that a page reports
    key: Callable[[Field], Column]
    record: Callable[[Field], dict[str, Column]]
    dates: str
    gate: str = NONE
    closing: bool = False
    by_deadline: bool = False
    grace: int = 0


def _kind(name: Column, family: str) -> dict[str, Column]:
    kind = agency_type(name, family)
    return {"agency": name, "agency_type": kind, "jurisdiction_level": level(kind, family)}


def _or(c: Column, other: str) -> Column:
    return F.coalesce(c, F.lit(other))


def _florida(f: Field) -> dict[str, Column]:
    board = "https://vendor.myfloridamarketplace.com/search/bids"
    name = F.coalesce(text(f("agency")), text(f("organization.name")), F.lit("State of Florida"))
    return {
        "wanted": F.upper(_or(f("status"), "")) == "OPEN", "agency_key": F.concat(F.lit("florida-vip:"), F.coalesce(f("organization.organizationId"), name)), **_kind(name, "florida"),
        "title": f("title"), "solicitation_type": _or(f("type"), "Solicitation"), "procurement_mechanism": F.lit("public competitive advertisement"),
        "issue": f("publishDate"), "due": f("closeDate"), "source_url": F.concat(F.lit(f"{board}/detail/"), f("advertisementId")),
        "raw_payload": payload(id=f("advertisementId"), number=f("agencyAdNumber"), type=f("type"), version=f("version"), published=f("publishDate"), closes=f("closeDate"), status=f("status"), agency=name),
    }


def _hawaii(f: Field) -> dict[str, Column]:
    place = F.concat_ws(" / ", F.nullif(f("jurisdiction"), F.lit("")), F.nullif(f("department"), F.lit("")))
    name = F.when(place != "", place).otherwise("State of Hawaii")
    kind = agency_type(F.concat_ws(" ", _or(f("jurisdiction"), ""), _or(f("department"), "")), "hawaii")
    number = F.upper(_or(f("solicitionNo"), ""))
    by_number = solicitation_type(number, "hawaii")
    return {
        "wanted": ~F.coalesce(f("closed").try_cast("boolean"), F.lit(False)), "agency_key": F.concat_ws(":", F.lit("hawaii-hands"), _or(f("jurisdiction"), "state"), _or(f("department"), "unknown")),
        "agency": name, "agency_type": kind, "jurisdiction_level": level(kind, "hawaii"), "title": f("title"),
        "solicitation_type": F.when(by_number != "Solicitation", by_number).otherwise(_or(f("category"), "Solicitation")), "procurement_mechanism": F.concat(F.lit("aggregated public solicitation ("), _or(f("system"), "HANDS"), F.lit(")")),
        "issue": f("publishDate"), "due": f("dueDate"), "source_url": F.coalesce(F.nullif(f("detailsUrl"), F.lit("")), F.concat(F.lit("https://hands.ehawaii.gov/hands/opportunities/opportunity-details/"), f("id"))),
        "raw_payload": payload(system=f("system"), id=f("id"), number=f("solicitionNo"), category=f("category"), island=f("island"), published=f("publishDate"), due=f("dueDate"), status=f("status")),
    }


def _hawaii_key(f: Field) -> Column:
    """The id, the number, or what a row without both is told by, under its system."""
    system, told = _or(F.nullif(f("system"), F.lit("")), "HANDS"), F.concat(F.trim(f("title")), F.lit("|"), F.trim(f("dueDate")), F.lit("|"), _or(f("department"), ""))
    return F.coalesce(*(F.concat(system, F.lit(f":{kind}:"), F.nullif(F.trim(c), F.lit(""))) for kind, c in (("id", f("id")), ("sol", f("solicitionNo")), ("fallback", told))))


def _delaware(f: Field) -> dict[str, Column]:
    code, title = text(f("agencycode")), text(f("contracttitle"))
    return {
        "agency_key": F.concat(F.lit("delaware:"), _or(code, "state")), **_kind(F.coalesce(F.concat(F.lit("State of Delaware - "), code), F.lit("State of Delaware")), "none"), "title": title,
        "solicitation_type": solicitation_type(title, "delaware"), "procurement_mechanism": F.lit("public solicitation"), "issue": f("opendate"), "due": f("deadlinedate"),
        "source_url": F.coalesce(F.nullif(f("bidurl.url"), F.lit("")), F.when(f("bidurl").startswith("http"), f("bidurl")), F.lit("https://mmp.delaware.gov/Bids")),
        "raw_payload": payload(number=text(f("contractnumber")), title=title, opens=f("opendate"), deadline=f("deadlinedate"), agency=code, unspsc=text(f("unspsc"))),
    }


def _clock(day: Column, time: Column) -> Column:
    """The day of a millisecond stamp in Chicago, with the time beside it; without a time the stamp itself."""
    at = F.unix_seconds(dotnet_date(day))
    local = F.convert_timezone(F.lit("UTC"), F.lit("America/Chicago"), clock(at))
    return F.when(F.coalesce(time, F.lit("")) == "", iso(at)).otherwise(F.concat(F.date_format(local, "yyyy-MM-dd'T'"), time))


def _mississippi(f: Field) -> dict[str, Column]:
    name, kind = _or(F.nullif(F.trim(f("Agency")), F.lit("")), "State of Mississippi"), _or(f("BidType"), "Procurement Opportunity")
    return {
        "wanted": (F.lower(_or(f("BidStatus"), "")) == "open") & F.coalesce(f("BidNumber") != "", F.lit(False)), "agency_key": F.concat(F.lit("mississippi-procurement:"), F.coalesce(f("AgencyNumber"), name)), **_kind(name, "mississippi"),
        "title": F.coalesce(F.nullif(F.trim(f("BidDescription")), F.lit("")), F.concat_ws(" ", kind, f("BidNumber"))), "description": F.nullif(F.trim(f("AdditionalInfo")), F.lit("")), "solicitation_type": _or(f("BidType"), "Solicitation"),
        "procurement_mechanism": F.lit("public opportunity search"), "issue": _clock(f("AdvertiseDate"), f("AdvertiseTime")), "due": F.coalesce(_clock(f("SubmissionDate"), f("SubmissionTime")), _clock(f("OpeningDate"), f("OpeningTime"))),
        "source_url": F.lit("https://www.ms.gov/dfa/contract_bid_search/Bid?autoloadGrid=true"), "raw_payload": payload(id=f("BidID"), number=f("BidNumber"), status=f("BidStatus"), type=f("BidType"), agency=f("Agency"), buyer=f("BuyerName"), category=f("ProcurementCategoryDescription"), due=f("SubmissionDate")),
    }


def _south_dakota(f: Field) -> dict[str, Column]:
    event = F.trim(f("eventId"))
    number = F.coalesce(F.nullif(F.trim(f("id")), F.lit("")), event)
    return {
        "agency_key": F.lit("south-dakota-central-bid-exchange"), **_kind(F.lit("State of South Dakota"), "none"), "title": F.coalesce(F.nullif(F.trim(f("eventName")), F.lit("")), number),
        "solicitation_type": solicitation_type(F.upper(_or(f("id"), "")), "south_dakota"), "procurement_mechanism": F.lit("public posting board"), "issue": f("publishedDate"), "due": f("eventDueDate"),
        "source_url": F.concat(F.lit("https://postingboard.esmsolutions.com/3444a404-3818-494f-84c5-2a850acd7779/eventDetail/"), F.url_encode(event)), "raw_payload": payload(event=event, number=number, status=f("status.description"), invitation=f("invitationType.description"), zone=f("timezoneName")),
    }


def _virginia(f: Field) -> dict[str, Column]:
    name, title = text(f("agencyname")), F.coalesce(text(f("shortdesc")), text(f("longdesc")))
    code, lot = F.coalesce(text(f("agency")), text(f("docdeptcd")), name), F.coalesce(text(f("internalid")), text(f("externalid")), text(f("id")))
    return {
        "wanted": name.isNotNull(), "agency_key": F.concat_ws(":", F.lit("virginia"), code, name), **_kind(name, "virginia"), "title": title, "description": text(f("longdesc")),
        "solicitation_type": F.coalesce(text(f("doccd")), text(f("doccddesc"))), "procurement_mechanism": _or(text(f("doccddesc")), "public solicitation"), "issue": f("pubdate"), "due": f("closedate"),
        "source_url": F.concat(F.lit("https://mvendor.cgieva.com/Vendor/public/IVDetails.jsp?PageTitle=SO+Details&rfp_id_lot="), F.url_encode(lot), F.lit("&rfp_id_round=0")),
        "raw_payload": payload(app=text(f("app")), internal=text(f("internalid")), external=text(f("externalid")), agency=code, buyer=text(f("buyername")), category=text(f("category")), closes=text(f("closedate"))),
    }


def bag_value(attributes: Column, name: str) -> Column:
    """The first stated form of a named attribute in a bag of (Name, DisplayValue, FormattedValue, Value)."""
    held = F.get(F.filter(attributes, lambda a: F.try_variant_get(a, "$.Name", "string") == name), F.lit(0))
    forms = []
    for form in ("DisplayValue", "FormattedValue", "Value"):
        forms += [F.try_variant_get(held, f"$.{form}.{part}", "string") for part in ("Name", "name", "Value", "value")]
        plain = F.try_variant_get(held, f"$.{form}", "string")
        forms.append(F.when(~plain.startswith("{"), plain))
    return F.coalesce(*(text(x) for x in forms))


def _north_carolina(f: Field) -> dict[str, Column]:
    name = _or(f("Attributes#owningbusinessunit"), "North Carolina Public Agency")
    title, about = f("Attributes#evp_name"), text(F.regexp_replace(_or(f("Attributes#evp_description"), ""), "<[^>]*>", " "))
    number = F.coalesce(f("Attributes#evp_solicitationnbr"), f("Attributes#evp_solicitationid"))
    return {
        "wanted": F.coalesce(F.lower(f("Attributes#statuscode")) == "open", F.lit(False)), "agency_key": F.concat(F.lit("north-carolina:"), name), **_kind(name, "north_carolina"), "title": title, "description": about,
        "solicitation_type": solicitation_type(F.concat_ws(" ", title, about), "north_carolina"), "procurement_mechanism": F.lit("public solicitation"), "issue": f("Attributes#evp_posteddate"), "due": f("Attributes#evp_opendate"),
        "source_url": F.concat(F.lit("https://evp.nc.gov/solicitations/details/?id="), F.url_encode(text(f("Id")))), "raw_payload": payload(id=text(f("Id")), number=number, title=title, agency=name, due=f("Attributes#evp_opendate"), description=about),
    }


def _open_portal(now: datetime) -> Callable[[Field], dict[str, Column]]:
    def record(f: Field) -> dict[str, Column]:
        code = F.coalesce(f("government.government.code"), f("government.id"))
        kind = agency_type(f("government.name"), "open_portals")
        flags = [~F.coalesce(f(c).try_cast("boolean"), F.lit(False)) for c in ("isPrivate", "isLibrary", "isTemplate", "isIntake")]
        return {
            "wanted": flags[0] & flags[1] & flags[2] & flags[3] & F.coalesce(F.trim(f("title")) != "", F.lit(False)) & F.coalesce(f("id") != "0", F.lit(False)), "agency_key": F.concat(F.lit("opengov:"), code), "agency": f("government.name"), "agency_type": kind,
            "jurisdiction_level": F.when(kind == "state_agency", "state").when(kind.isin("k12", "higher_ed"), "education").otherwise("local"), "title": F.trim(f("title")), "description": F.concat(F.lit("Department: "), F.nullif(f("departmentName"), F.lit(""))),
            "solicitation_type": F.coalesce(f("template.title"), f("type")), "procurement_mechanism": f("type"), "issue": F.coalesce(f("postedAt"), f("releaseProjectDate"), f("created_at")), "due": f("proposalDeadline"), "prebid": f("preProposalDate"),
            "status": project_status(F.lit(None).cast("timestamp"), F.coalesce(f("comingSoon").try_cast("boolean"), F.lit(False)), f("status"), now), "state_code": f("government.state"), "city": f("government.city"),
            "source_url": F.concat(F.lit("https://procurement.opengov.com/portal/"), code, F.lit("/projects/"), f("id"), F.lit("/document")),
            "raw_payload": payload(government=code, id=f("id"), number=f("financialId"), title=f("title"), status=f("status"), type=f("type"), posted=f("postedAt"), deadline=f("proposalDeadline"), department=f("departmentName")),
        }

    return record


def _federal(f: Field) -> dict[str, Column]:
    name = agency_name(f("fullParentPathName"), f("office"), f("subTier"), f("department"))
    kind, title = F.coalesce(F.nullif(f("type"), F.lit("")), F.nullif(f("baseType"), F.lit(""))), _or(F.nullif(F.trim(f("title")), F.lit("")), "Untitled federal opportunity")
    gone = F.coalesce(f("active") == "No", F.lit(False)) | F.lower(title).rlike("cancelled|canceled")
    code, notice = F.nullif(f("naicsCode"), F.lit("")), F.nullif(f("noticeId"), F.lit(""))
    return {
        "agency_key": name, "agency": name, "agency_type": F.lit("federal"), "jurisdiction_level": F.lit("federal"), "title": title, "description": F.nullif(f("description"), F.lit("")), "solicitation_type": kind, "procurement_mechanism": kind,
        "status": F.when(gone, "closed").otherwise("open"), "issue": f("postedDate"), "due": f("responseDeadLine"), "state_code": f("placeOfPerformance.state.code"), "city": f("placeOfPerformance.city.name"), "naics_codes": F.when(code.isNotNull(), F.array(code)),
        "set_aside": F.coalesce(F.nullif(f("typeOfSetAsideDescription"), F.lit("")), F.nullif(f("typeOfSetAside"), F.lit(""))),
        "source_url": F.coalesce(F.nullif(f("uiLink"), F.lit("")), F.concat(F.lit("https://sam.gov/workspace/contract/opp/"), notice, F.lit("/view")), F.lit("https://sam.gov/content/opportunities")),
        "raw_payload": payload(noticeId=notice, solicitationNumber=f("solicitationNumber"), title=f("title"), responseDeadLine=f("responseDeadLine"), active=f("active"), type=kind, naicsCode=code, resourceLinks=f("resourceLinks")),
    }


def _advantage(state: str, name: str, portal: str) -> Callable[[Field], dict[str, Column]]:
    def record(f: Field) -> dict[str, Column]:
        agency = _or(F.nullif(F.trim(f("DEPT_NM")), F.lit("")), name)
        closes = F.coalesce(F.nullif(f("SO_CLSNG_DT_TM"), F.lit("")), F.nullif(f("PUB_BID_OP_DT"), F.lit("")))
        return {
            "agency_key": F.concat(F.lit(f"cgi_advantage:{state}:"), agency), **_kind(agency, "advantage"), "title": F.nullif(F.trim(f("DOC_DSCR")), F.lit("")), "solicitation_type": F.trim(F.coalesce(f("DOC_CD"), f("SO_CAT_CD"), F.lit("Solicitation"))),
            "procurement_mechanism": F.lit("public solicitation"), "issue": _milliseconds(f("PUB_DT")), "due": _milliseconds(closes), "source_url": F.concat(F.lit(f"{portal}?solicitation_number="), F.url_encode(_advantage_key(f))),
            "raw_payload": payload(number=_advantage_key(f), category=f("SO_CAT_CD"), status=f("SO_STA"), code=f("DOC_CD"), title=f("DOC_DSCR"), department=agency, buyer=f("BUYR_NM"), closes=closes),
        }

    return record


def _milliseconds(c: Column) -> Column:
    """Milliseconds since 1970 as a text in UTC; other texts as they are."""
    at = F.floor(c.try_cast("double") / 1000).cast("long")
    return F.when(at.isNotNull(), iso(at)).otherwise(c)


def _advantage_key(f: Field) -> Column:
    shown = F.trim(_or(f("DOC_REF"), ""))
    bracketed = F.nullif(F.regexp_extract(shown, r"\[([^\]]+)\]\s*$", 1), F.lit(""))
    return F.trim(F.coalesce(bracketed, F.nullif(f("DOC_CD_CONCAT"), F.lit("")), F.nullif(f("ADV_ROW_ID"), F.lit("")), F.nullif(shown, F.lit(""))))


def _periscope(state: str, base: str) -> Callable[[Field], dict[str, Column]]:
    def record(f: Field) -> dict[str, Column]:
        name = text(f("[2]"))
        return {
            "wanted": name.isNotNull() & text(f("[7]")).isNotNull(), "agency_key": F.concat(F.lit(f"periscope:{state}:"), name), **_kind(name, "periscope"), "title": text(f("[6]")), "solicitation_type": F.lit("Bid solicitation"), "procurement_mechanism": F.lit("public solicitation"),
            "due": f("[7]"), "source_url": absolute(base, f("href[0]")), "raw_payload": payload(number=_first(f, 1, 0), organization=name, buyer=text(f("[5]")), opening=f("[7]"), status=text(f("[10]")), alternate=text(f("[11]"))),
        }

    return record


def _first(f: Field, *places: int) -> Column:
    return F.coalesce(*(text(f(f"[{i}]")) for i in places))


def _arizona(f: Field) -> dict[str, Column]:
    name = _or(text(f("[5]")), "State of Arizona")
    return {
        "wanted": F.coalesce(f("href[1]"), f("href[2]"), f("href[0]")).rlike(r"/bpm/process_manage_extranet/\d+"), "agency_key": F.concat(F.lit("arizona:"), name), **_kind(name, "arizona"), "title": text(f("[2]")), "description": text(f("[4]")),
        "solicitation_type": F.lit("Solicitation"), "procurement_mechanism": F.lit("public solicitation"), "issue": f("[3]"), "due": f("[11]"), "source_url": absolute("https://app.az.gov/page.aspx/en/rfp/request_browse_public", F.coalesce(f("href[1]"), f("href[2]"), f("href[0]"))),
        "raw_payload": payload(code=text(f("[1]")), title=text(f("[2]")), agency=name, status=text(f("[7]")), begins=f("[10]"), ends=f("[11]")),
    }


def _arkansas(f: Field) -> dict[str, Column]:
    name, code = _or(text(f("[6]")), "State of Arkansas"), text(f("[1]"))
    return {
        "wanted": F.coalesce(f("href[1]"), f("href[2]")).rlike("RfxEvent/preview/"), "agency_key": F.concat(F.lit("arkansas-sas:"), name), **_kind(name, "none"), "agency": name, "title": text(f("[2]")), "description": text(f("[3]")), "solicitation_type": solicitation_type(code, "arkansas"),
        "procurement_mechanism": F.lit("public solicitation index"), "issue": f("[4]"), "due": f("[5]"), "source_url": F.coalesce(f("href[1]"), f("href[2]")), "raw_payload": payload(code=code, title=text(f("[2]")), posted=f("[4]"), deadline=f("[5]"), department=name),
    }


def _california(f: Field) -> dict[str, Column]:
    name, title, by_title = text(f("[1]")), text(f("[3]")), solicitation_type(F.upper(text(f("[3]"))), "california")
    return {
        "wanted": name.isNotNull() & F.coalesce(f("[7]").rlike("(?i)posted"), F.lit(False)) & F.regexp_replace(f("[2]"), r"\s", "").rlike("(?i)^[A-Z0-9-]+$"), "must_be_due": F.lit(True), "agency_key": F.concat_ws(":", F.lit("california"), text(f("[0]")), name), **_kind(name, "california"), "title": title,
        "solicitation_type": F.when(by_title != "Sell RFx", by_title).otherwise(_or(text(f("[5]")), "Sell RFx")), "procurement_mechanism": F.lit("public sourcing event"), "due": f("[6]"), "source_url": F.lit("https://caleprocure.ca.gov/psp/psfpd1_3/SUPPLIER/ERP/c/AUC_MANAGE_BIDS.AUC_RESP_INQ_AUC.GBL"),
        "raw_payload": payload(department=text(f("[0]")), event=text(f("[2]")), title=title, format=text(f("[4]")), type=text(f("[5]")), ends=f("[6]"), status=f("[7]"), buyer=text(f("[8]"))),
    }


def _nebraska(f: Field) -> dict[str, Column]:
    name, page = text(f("[7]")), "https://das.nebraska.gov/materiel/bid-opportunities.html"
    return {
        "wanted": name.isNotNull(), "agency_key": F.concat(F.lit("nebraska:"), name), **_kind(name, "nebraska"), "title": text(f("[1]")), "description": text(f("[2]")), "solicitation_type": _or(text(f("[4]")), "State solicitation"), "procurement_mechanism": F.lit("public solicitation"),
        "issue": f("[0]"), "due": f("[3]"), "source_url": absolute(page, F.coalesce(f("href[1]"), f("href[6]"))), "raw_payload": payload(posted=f("[0]"), title=text(f("[1]")), category=text(f("[2]")), opening=f("[3]"), type=text(f("[4]")), buyer=text(f("[5]")), number=text(f("[6]")), agency=name),
    }


def _washington_key(f: Field) -> Column:
    """What follows "Ref#:", up to the remarks that a listing ends with."""
    listed = text(f("[1]"))
    ends = r"\s+(?:see specifications|Includes an Inclusion Plan|Pre-Bid Conference|Deadline for Submitting Questions|Additional Data)"
    shorter = F.regexp_extract(listed, rf"(?is)Ref#:\s*(.+?)(?={ends})", 1)
    return F.when(F.regexp_extract(f("[0]"), SLASHED_DAY, 0) != "", text(F.coalesce(F.nullif(shorter, F.lit("")), F.regexp_extract(listed, r"(?i)Ref#:\s*(.+)", 1))))


def _washington(f: Field) -> dict[str, Column]:
    listed, name, key = text(f("[1]")), _or(text(f("[-1]")), "State of Washington"), _washington_key(f)
    head = text(F.split(listed, "(?i)Ref#:", 2)[0])
    days = F.regexp_extract_all(f("[0]"), F.lit(f"({SLASHED_DAY})"), F.lit(1))
    page = "https://pr-webs-vendor.des.wa.gov/BidCalendar.aspx"
    return {
        "agency_key": F.concat(F.lit("washington:"), name), **_kind(name, "washington"), "title": F.coalesce(head, key), "solicitation_type": solicitation_type(key, "washington"), "procurement_mechanism": F.lit("public solicitation"),
        "issue": F.get(days, F.lit(1)), "due": F.get(days, F.lit(0)), "source_url": absolute(page, f("href[1]")), "raw_payload": payload(number=key, closes=F.get(days, F.lit(0)), amended=F.get(days, F.lit(1)), contact=text(f("[-1]")), listing=listed),
    }


def _wyoming(f: Field) -> dict[str, Column]:
    name, awarded = text(f("AGENCY NAME")), text(f("AWARDED TO (Vendor)"))
    return {
        "wanted": name.isNotNull() & (awarded.isNull() | (F.lower(awarded) == "pending")), "must_be_due": F.lit(True), "agency_key": F.concat(F.lit("wyoming:"), name), **_kind(name, "wyoming"), "title": text(f("DESCRIPTION")), "solicitation_type": F.lit("State solicitation"),
        "procurement_mechanism": F.lit("formal bid process"), "issue": f("DATE BID SENT OUT"), "due": f("OPENING DATE"), "source_url": F.lit("https://ai.wyo.gov/divisions/general-services/purchasing/non-construction-bids"),
        "raw_payload": payload(number=text(f("Bid Number")), agency=name, description=text(f("DESCRIPTION")), sent=text(f("DATE BID SENT OUT")), opening=text(f("OPENING DATE")), awarded=awarded, contact=text(f("AGENGY CONTACT EMAIL"))),
    }


# The states of two families of portals and where these stand.
ADVANTAGE = (
    ("AK", "Alaska", "https://iris-vss.alaska.gov/PRDVSS1X1/Advantage4"),
    ("CO", "Colorado", "https://prd.co.cgiadvantage.com/PRDVSS1X1/Advantage4"),
    ("KY", "Kentucky", "https://vss.ky.gov/vssprod-ext/Advantage4"),
    ("ME", "Maine", "https://mevss.hostams.com/PRDVSS1X1/AltSelfService"),
    ("MI", "Michigan", "https://sigma.michigan.gov/PRDVSS1X1/Advantage4"),
    ("WV", "West Virginia", "https://prd311.wvoasis.gov/PRDVSS1X1ERP/Advantage4"),
)
PERISCOPE = (
    ("IL", "https://www.bidbuy.illinois.gov/bso/"),
    ("MA", "https://www.commbuys.com/bso/"),
    ("NV", "https://nevadaepro.com/bso/"),
    ("NJ", "https://www.njstart.gov/bso/"),
    ("OR", "https://oregonbuys.gov/bso/"),
)


def portals(now: datetime) -> dict[str, Portal]:
    """All portals that have a mapping, by their source's key."""
    field = lambda path: lambda f: text(f(path))
    out = {
        "mfmp_vip_fl": Portal("FL", "json", "", (), (), field("advertisementId"), _florida, "mfmp_vip_fl", EXACT, True),
        "hands_hi": Portal("HI", "json", "data.searchResult.content", (), ("data.total",), _hawaii_key, _hawaii, "hands_hi", EXACT, True),
        "delaware_open_bids_de": Portal("DE", "json", "", (), (), field("contractnumber"), _delaware, "delaware_open_bids_de"),
        "magic_public_ms": Portal("MS", "json", "aaData", (), ("iTotalDisplayRecords", "iTotalRecords"), field("BidID"), _mississippi, "magic_public_ms", EXACT, True),
        "esm_posting_board_sd": Portal("SD", "json", "data", (), ("totalCount",), field("eventId"), _south_dakota, "esm_posting_board_sd", EXACT, True),
        "eva_vbo_va": Portal("VA", "json", "response.docs", (), ("response.numFound",), lambda f: F.coalesce(text(f("id")), F.concat_ws(":", text(f("app")), text(f("internalid")))), _virginia, "eva_vbo_va", EXACT, True),
        "powerpages_nc": Portal("NC", "json", "Records", (), ("ItemCount",), field("Id"), _north_carolina, "powerpages_nc", PARSED, True),
        "opengov_public": Portal(None, "json", "projects", (), (), lambda f: F.concat_ws(":", F.coalesce(f("government.government.code"), f("government.id")), f("id")), _open_portal(now), "opengov_public", SOME, True, True),
        "sam_gov": Portal(None, "json", "opportunitiesData", (), ("totalRecords",), lambda f: F.coalesce(text(f("noticeId")), text(f("solicitationNumber"))), _federal, "sam_gov"),
        "ivalua_app_az": Portal("AZ", "table", "", ("Code", "Label"), (), field("[1]"), _arizona, "ivalua_app_az", EXACT, True),
        "sap_ariba_index_ar": Portal("AR", "table", "", ("Solicitation", "Deadline"), (), field("[1]"), _arkansas, "sap_ariba_index_ar", SOME, True),
        "peoplesoft_ca": Portal("CA", "table", "", ("Event ID", "End Date"), (), lambda f: F.concat_ws(":", text(f("[0]")), text(f("[2]"))), _california, "peoplesoft_ca", EXACT, True),
        "nebraska_das_ne": Portal("NE", "table", "", ("Solicitation Number",), (), field("[6]"), _nebraska, "nebraska_das_ne", SOME, True),
        "webs_wa": Portal("WA", "table", "", (), (), _washington_key, _washington, "webs_wa", SOME, True, False, 6 * 3600),
        "wyoming_ai_released_bids_wy": Portal("WY", "csv", "", ("Bid Number", "AGENCY NAME", "DESCRIPTION", "OPENING DATE"), (), field("Bid Number"), _wyoming, "wyoming_ai_released_bids_wy", SOME, True),
    }
    for state, name, base in ADVANTAGE:
        out[f"cgi_advantage_{state.lower()}"] = Portal(state, "embedded", "solicitations", (), ("total",), _advantage_key, _advantage(state, name, base), "cgi_advantage", EXACT, True)
    for state, base in PERISCOPE:
        headers = ("Bid Solicitation #", "Description", "Bid Opening Date")
        out[f"periscope_{state.lower()}"] = Portal(state, "table", "", headers, (), lambda f: _first(f, 1, 0), _periscope(state, base), "periscope", EXACT, True)
    return out


def _variant_value(item: str) -> Field:
    """A value by its path; ``bag#name`` is an attribute of a bag."""

    def at(path: str) -> Column:
        bag, _, name = path.partition("#")
        if name:
            return bag_value(F.try_variant_get(item, f"$.{bag}", "array<variant>"), name)
        return F.try_variant_get(item, f"$.{path}", "string")

    return at


def _cell(path: str) -> Column:
    """Cells by place (``[3]``), links by place (``href[3]``), or cells by header."""
    if path == "[-1]":
        return F.try_element_at("cells", F.lit(-1))
    if path.startswith("href["):
        return F.get("hrefs", F.lit(int(path[5:-1])))
    return F.get("cells", F.lit(int(path[1:-1]))) if path.startswith("[") else F.try_element_at("named", F.lit(path))


def items_of(pages: DataFrame, portal: Portal) -> tuple[DataFrame, DataFrame, Field]:
    """Pages with what they report, rows of all pages, and how their values are reached."""
    body = F.col("body")
    if portal.read in ("table", "csv"):
        rows = (table_rows if portal.read == "table" else delimited)(pages.select("source", "page", "body"), list(portal.labels))
        return pages.select("source", "page", "reported"), rows, _cell
    if portal.read == "embedded":
        body = named_object(embedded_object(body, r"var\s+moInitialResponse\s*=\s*"), portal.items)
    parsed = pages.select("source", "page", "reported", F.try_parse_json(body).alias("v"))
    totals = [F.try_variant_get("v", f"$.{p}", "long") for p in portal.total]
    told = parsed.select("source", "page", F.coalesce("reported", *totals).alias("reported"))
    path = "$.rows" if portal.read == "embedded" else f"$.{portal.items}" if portal.items else "$"
    rows = parsed.select("source", "page", F.posexplode(F.try_variant_get("v", path, "array<variant>")).alias("position", "item"))
    return told, rows, _variant_value("item")


#: Columns of a mapped row before its dates are read.
_PLAIN = tuple((n, k) for n, k in COLUMNS if n not in ("external_id", "issue_date", "due_at", "prebid_at", "status", "content_hash"))


def mapped_rows(pages: DataFrame, key: str, portal: Portal) -> tuple[DataFrame, DataFrame]:
    """Of a portal's landed pages: what they report, and every row with its key and values, dates as written."""
    told, rows, value = items_of(pages.where(F.col("source") == key), portal)
    paths: dict[str, int] = {}

    def named(path: str) -> Column:
        return F.col(f"v.v{paths.setdefault(path, len(paths))}")

    own = F.nullif(portal.key(named), F.lit(""))
    given = {"state_code": F.lit(portal.state).cast("string"), **portal.record(named)}
    # the values that the mapping has asked for are taken out once, however often it names them
    taken = F.struct(*(value(path).alias(f"v{i}") for path, i in paths.items()))
    rows = rows.select("source", "page", "position", F.explode(F.array(taken)).alias("v"))
    wanted = F.coalesce(given.get("wanted", F.lit(True)), F.lit(False)) & own.isNotNull() & given["title"].isNotNull()
    return told, rows.select(
        "source", "page", "position", own.alias("external_id"), wanted.alias("wanted"), given.get("must_be_due", F.lit(False)).alias("must_be_due"), F.lit(portal.dates).alias("rule"),
        given.get("status", F.lit(None).cast("string")).alias("own_status"), F.lit(portal.by_deadline).alias("by_deadline"), F.lit(portal.grace).alias("grace"),
        *(given.get(n, F.lit(None)).cast("string").alias(f"{n}_text") for n in ("issue", "due", "prebid")), *(given.get(n, F.lit(None)).cast(k).alias(n) for n, k in _PLAIN),
    )


def parse(pages: DataFrame, folder: str, now: datetime, wanted: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Parse the landed pages of each portal (or of those ``wanted``) into ``folder``, one job for each; returned are what
    every page reports and every row, so that counts, gates and records read one parsing."""
    spark, known = pages.sparkSession, portals(now)
    for key in wanted or list(known):
        told, rows = mapped_rows(pages, key, known[key])
        told.drop("source").write.mode("overwrite").parquet(f"{folder}/told/source={key}")
        rows.drop("source").write.mode("overwrite").parquet(f"{folder}/rows/source={key}")
    with_source = lambda df: T.StructType([f for f in df.schema if f.name != "source"] + [T.StructField("source", T.StringType())])
    return spark.read.schema(with_source(told)).parquet(f"{folder}/told"), spark.read.schema(with_source(rows)).parquet(f"{folder}/rows")


def item_keys(rows: DataFrame) -> DataFrame:
    return rows.select("source", F.col("external_id").alias("item_key"))


def records(rows: DataFrame, now: datetime) -> DataFrame:
    """Canonical records of parsed rows: wanted ones with a key and a title, the last of each key. Without a status of its own
    a record must not be past due; one that goes by the deadline is open until then. Dates are read once, for all portals."""
    dated = with_instants(rows.where("wanted"), "rule", {f"{n}_at": f"{n}_text" for n in ("issue", "due", "prebid")}, ("issue_at",))
    at = int(now.replace(tzinfo=now.tzinfo or timezone.utc).timestamp())
    passed = F.unix_seconds("due_at") < at - F.col("grace")
    listed = F.col("own_status").isNotNull() | (~F.coalesce(passed, F.lit(False)) & (~F.col("must_be_due") | F.col("due_at").isNotNull()))
    last = F.row_number().over(Window.partitionBy("source", "external_id").orderBy(F.desc("page"), F.desc("position")))
    one = dated.where(listed).withColumn("_last", last).where("_last = 1")
    deadline = F.col("by_deadline") & F.col("due_at").isNotNull()
    columns = {n: F.col(n) for n, _ in _PLAIN}
    columns |= {"external_id": F.col("external_id"), "due_at": F.col("due_at"), "prebid_at": F.col("prebid_at"), "issue_date": F.date_from_unix_date(F.floor(F.unix_seconds("issue_at") / 86_400).cast("int"))}
    columns["status"] = F.when(deadline, F.when(passed, "closed").otherwise("open")).otherwise(F.coalesce("own_status", F.lit("open")))
    return canonical(one, columns, ("source",))
