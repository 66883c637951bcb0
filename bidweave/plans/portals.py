"""Registered queries: landed pages of the portals, rendered from orders, and what is read back from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import sweeps
from ..sources import landing, portals
from .catalog import query
from .views import AS_OF, table

PAGE_ROWS = 200

#: The portals in the order in which orders are dealt to them.
DEALT = (
    "mfmp_vip_fl", "hands_hi", "delaware_open_bids_de", "magic_public_ms", "esm_posting_board_sd", "eva_vbo_va", "powerpages_nc", "opengov_public",
    "sam_gov", "cgi_advantage_mi", "periscope_nv", "ivalua_app_az", "sap_ariba_index_ar", "peoplesoft_ca", "nebraska_das_ne", "wyoming_ai_released_bids_wy",
)


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with what the pages say of them, all written out as text."""
    endings = F.array(*map(F.lit, ("", " County", " University", " School District", " Port Authority")))
    day, hour = F.to_date("o_orderdate"), (8 + F.col("o_orderkey") % 9).cast("int")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    slashed = F.concat_ws("/", F.month(day), F.dayofmonth(day), F.year(day))
    half = F.concat(F.when(hour > 12, hour - 12).otherwise(hour).cast("string"), F.lit(":30"))
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    rows = joined.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderkey").cast("string").alias("key"), F.get(F.array(*map(F.lit, DEALT)), (F.col("o_orderkey") % len(DEALT)).cast("int")).alias("source"),
        F.concat("c_name", F.get(endings, (F.col("o_custkey") % 5).cast("int"))).alias("agency"), F.concat(F.lit("RFP & <supply> "), F.col("o_orderkey").cast("string")).alias("title"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("code"), (F.col("o_orderkey") % 7 == 0).alias("shut"), slashed.alias("day"),
        F.concat(day.cast("string"), F.lit("T"), two(hour), F.lit(":30:00")).alias("iso"), F.concat(slashed, F.lit(" "), half).alias("clock"), F.when(hour < 12, "AM").otherwise("PM").alias("half"),
        (F.unix_date(day).cast("long") * 86_400).alias("midnight"), (hour * 3600 + 1800).alias("second"), F.concat(two(hour), F.lit(":30:00")).alias("time"), (F.col("o_orderkey") % 2 == 0).alias("even"),
    )
    return rows.withColumn("page", ((F.row_number().over(Window.partitionBy("source").orderBy("id")) - 1) / PAGE_ROWS).cast("int"))


def _escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _grid(*cells: Column | None) -> Column:
    """One row of a table, end tags left out."""
    return F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), F.lit("") if c is None else c) for c in cells))


def _link(href: Column, shown: Column) -> Column:
    return F.concat(F.lit('<a href="'), href, F.lit('">'), shown, F.lit("</a>"))


def _items() -> dict[str, Column]:
    """An order as a row of each portal: a struct for JSON, a line or a row of markup otherwise."""
    c, no = F.col, F.lit(None).cast("string")
    named = lambda **fields: F.struct(*(v.alias(k) for k, v in fields.items()))
    z, word = F.concat("iso", F.lit("Z")), lambda a, b: F.when(c("shut"), a).otherwise(b)
    told = (("evp_name", "Value", c("title")), ("owningbusinessunit", "DisplayValue", c("agency")), ("statuscode", "FormattedValue", word("Closed", "Open")), ("evp_opendate", "DisplayValue", F.concat_ws(" ", "clock", "half")))
    bag = F.array(*(named(Name=F.lit(n), **{form: v if form == own else no for form in ("DisplayValue", "FormattedValue", "Value")}) for n, own, v in told))
    title, agency = _escaped(c("title")), c("agency")
    return {
        "mfmp_vip_fl": named(advertisementId=c("id"), title=c("title"), status=word("CLOSED", "open"), closeDate=z, agency=c("agency"), type=no),
        "hands_hi": named(id=c("id"), title=c("title"), closed=c("shut"), dueDate=F.when(c("even"), c("day")).otherwise(F.concat_ws(" ", "clock", "half")), jurisdiction=c("agency")),
        "delaware_open_bids_de": named(contractnumber=c("key"), contracttitle=c("title"), deadlinedate=F.concat("iso", F.lit(".000")), agencycode=c("code"), bidurl=named(url=F.lit("https://bids.example/1"))),
        "magic_public_ms": named(BidID=c("id"), BidNumber=c("code"), BidStatus=word("Closed", "Open"), BidDescription=c("title"), Agency=c("agency"), SubmissionDate=F.concat(F.lit("/Date("), ((c("midnight") + 21_600) * 1000).cast("string"), F.lit(")/")), SubmissionTime=c("time")),
        "esm_posting_board_sd": named(eventId=c("key"), eventName=c("title"), eventDueDate=c("iso")),
        "eva_vbo_va": named(id=c("key"), agencyname=c("agency"), agency=c("code"), shortdesc=c("title"), closedate=z),
        "powerpages_nc": named(Id=c("key"), Attributes=bag),
        "opengov_public": named(id=c("id"), title=c("title"), isPrivate=c("shut"), proposalDeadline=z, government=named(name=c("agency"), state=F.lit("oh"), government=named(code=c("code")))),
        "sam_gov": named(noticeId=c("key"), title=c("title"), active=word("No", "Yes"), responseDeadLine=F.concat("iso", F.lit("-05:00")), fullParentPathName=F.concat(F.lit("TOP.MIDDLE."), c("agency")), placeOfPerformance=named(state=named(code=F.lit("OH")))),
        "cgi_advantage_mi": named(DOC_REF=F.concat(F.lit("shown ["), "key", F.lit("]")), DOC_DSCR=F.concat("title", F.lit(' {"}')), DEPT_NM=c("agency"), SO_CLSNG_DT_TM=((c("midnight") + c("second")) * 1000)),
        "periscope_nv": _grid(_link(F.lit("view/1"), F.lit("open")), c("key"), agency, None, None, F.lit("Buyer"), title, F.concat_ws(" ", "clock", "half")),
        "ivalua_app_az": _grid(None, _link(F.concat(F.lit("/bpm/process_manage_extranet/"), "key"), c("key")), title, None, None, agency, None, F.lit("Open for Bidding"), None, None, None, F.concat(F.replace("clock", F.lit(":30"), F.lit(":30:00")), F.lit(" "), "half")),
        "sap_ariba_index_ar": _grid(None, _link(F.lit("https://ariba.example/RfxEvent/preview/1"), c("key")), title, None, None, c("day"), agency),
        "peoplesoft_ca": _grid(c("code"), agency, c("key"), title, None, F.lit("RFx"), F.concat("clock", "half", F.lit(" PST")), word("Withdrawn", "Posted"), None, None),
        "nebraska_das_ne": _grid(None, title, None, c("day"), None, None, c("key"), agency),
        "wyoming_ai_released_bids_wy": F.concat(F.col("key"), F.lit(',"'), "agency", F.lit('","'), "title", F.lit('",'), "day", F.lit(","), word("A vendor", "pending")),
    }


#: What stands before and after the rows of a page, and between them; of JSON portals the path of the array.
_ENVELOPES = {
    "mfmp_vip_fl": ("", ""), "delaware_open_bids_de": ("", ""), "hands_hi": ('{"data":{"total":%d,"searchResult":{"content":', "}}}"), "magic_public_ms": ('{"iTotalRecords":%d,"aaData":', "}"), "esm_posting_board_sd": ('{"totalCount":%d,"data":', "}"),
    "eva_vbo_va": ('{"response":{"numFound":%d,"docs":', "}}"), "powerpages_nc": ('{"ItemCount":%d,"Records":', "}"), "opengov_public": ('{"projects":', "}"), "sam_gov": ('{"totalRecords":%d,"opportunitiesData":', "}"),
    "cgi_advantage_mi": ('<html><script>var moInitialResponse = {"note":"}{\\"","layers":[{"name":"menu"},{"deep":{"name":"solicitations","total":%d,"rows":', "}}]}; go();</script>"),
    "periscope_nv": ("<h1>Bids</h1><table><tr><th>x</table><table><thead><tr><th>A<th>Bid Solicitation #<th>C<th>D<th>E<th>F<th>Description<th>Bid Opening Date</thead>", "</table>"),
    "ivalua_app_az": ("<table><tr><th>-<th>Code<th>Label", "</table>"), "sap_ariba_index_ar": ("<table><tr><th>-<th>Solicitation<th>T<th>D<th>P<th>Deadline<th>A", "</table>"), "peoplesoft_ca": ("<table><tr><th>Dept<th>Name<th>Event ID<th>N<th>F<th>T<th>End Date", "</table>"),
    "nebraska_das_ne": ("<table><tr><th>P<th>D<th>C<th>O<th>T<th>B<th>Solicitation Number<th>Agency", "</table>"), "wyoming_ai_released_bids_wy": ("﻿Bid Number,AGENCY NAME,DESCRIPTION,OPENING DATE,AWARDED TO (Vendor)\n", ""),
}
#: Portals whose total comes from a page of its own.
_TOLD_APART = ("mfmp_vip_fl", "periscope_nv", "ivalua_app_az", "peoplesoft_ca")


def _rendered(orders: DataFrame, source: str) -> DataFrame:
    """source, page, reported, body: a portal's pages of at most PAGE_ROWS rows."""
    item, json = _items()[source], portals.portals(AS_OF)[source].read in ("json", "embedded")
    own = orders.where(F.col("source") == source)
    before, after = _ENVELOPES[source]
    listed = F.collect_list(F.struct("id", (F.to_json(item) if json else item).alias("x")))
    rows = own.groupBy("page").agg(F.sort_array(listed).alias("rows")).crossJoin(F.broadcast(own.agg(F.count("*").alias("total"))))  # one row
    joined = F.array_join(F.transform("rows", lambda r: r["x"]), "," if json else "\n")
    head, tail = (before.split("%d") + [""])[:2]
    start = F.concat(F.lit(head), F.col("total").cast("string"), F.lit(tail)) if "%d" in before else F.lit(before)
    body = F.concat(start, F.lit("["), joined, F.lit("]"), F.lit(after)) if json else F.concat(start, joined, F.lit(after))
    return rows.select(F.lit(source).alias("source"), "page", F.when(F.lit(source in _TOLD_APART), F.col("total")).alias("reported"), body.alias("body"))


def landed_pages(spark: SparkSession, sf_dir: str, wanted: tuple[str, ...] = DEALT) -> tuple[DataFrame, str]:
    """The rendered pages, landed and read back, and the folder that goes with the application.

    The orders are joined and numbered once and put down by portal, so that no portal's rendering sends the customers out again.
    """
    path, made = landing.folder(spark, "landed"), _orders(spark, sf_dir).where(F.col("source").isin(*wanted))
    made.write.partitionBy("source").parquet(f"{path}/orders")
    orders = spark.read.schema(made.schema).parquet(f"{path}/orders")
    for source in wanted:
        landing.land(_rendered(orders, source), f"{path}/pages")
    landing.drop_at_end(spark, path)
    return landing.landed(spark, f"{path}/pages"), path


_KINDS = {
    "mfmp_vip_fl": ("state_agency local_agency education education state_agency", "state local local local state"), "hands_hi": ("state_agency local_agency education education state_agency", "state local state state state"),
    "delaware_open_bids_de": (" ".join(["state_agency"] * 5), " ".join(["state"] * 5)), "magic_public_ms": ("state_agency local_agency education education local_agency", "state local local local local"),
    "esm_posting_board_sd": (" ".join(["state_agency"] * 5), " ".join(["state"] * 5)), "eva_vbo_va": ("state_agency local_government higher_ed k12 authority", "state local state local local"),
    "powerpages_nc": ("state_agency county higher_ed k12 authority", "state local state local state"), "opengov_public": ("local_agency county higher_ed k12 authority", "local local education education local"),
    "sam_gov": (" ".join(["federal"] * 5), " ".join(["federal"] * 5)), "cgi_advantage_mi": ("state_agency county higher_ed k12 authority", "state local state local local"),
    "periscope_nv": ("state_agency county higher_ed k12 authority", "state local state local local"), "ivalua_app_az": ("state_agency county higher_ed k12 authority", "state local state local local"),
    "sap_ariba_index_ar": (" ".join(["state_agency"] * 5), " ".join(["state"] * 5)), "peoplesoft_ca": ("state_agency state_agency higher_ed k12 authority", "state state state state state"),
    "nebraska_das_ne": ("state_agency county higher_ed k12 state_agency", "state local state state state"), "wyoming_ai_released_bids_wy": ("state_agency state_agency higher_ed k12 state_agency", "state state state state state"),
}
_ZONED = "(wall at time zone '{}') at time zone 'UTC'"
_DUE = {
    "hands_hi": "case when id % 2 = 0 then day + interval 23 hour + interval 59 minute else wall end + interval 10 hour", "delaware_open_bids_de": _ZONED.format("America/New_York"), "powerpages_nc": _ZONED.format("America/New_York"),
    "magic_public_ms": _ZONED.format("America/Chicago"), "esm_posting_board_sd": _ZONED.format("America/Chicago"), "sam_gov": "wall + interval 5 hour", "ivalua_app_az": "wall + interval 7 hour", "peoplesoft_ca": "wall + interval 8 hour",
    "sap_ariba_index_ar": "day + interval 29 hour - interval 1 second", "nebraska_das_ne": "day + interval 29 hour - interval 1 second", "wyoming_ai_released_bids_wy": "day + interval 6 hour - interval 1 second",
}
_STATES = {"mfmp_vip_fl": "FL", "hands_hi": "HI", "delaware_open_bids_de": "DE", "magic_public_ms": "MS", "esm_posting_board_sd": "SD", "eva_vbo_va": "VA", "powerpages_nc": "NC", "opengov_public": "OH", "sam_gov": "OH", "cgi_advantage_mi": "MI", "periscope_nv": "NV", "ivalua_app_az": "AZ", "sap_ariba_index_ar": "AR", "peoplesoft_ca": "CA", "nebraska_das_ne": "NE", "wyoming_ai_released_bids_wy": "WY"}
_NOT_SHUT = ("mfmp_vip_fl", "hands_hi", "magic_public_ms", "powerpages_nc", "opengov_public", "peoplesoft_ca", "wyoming_ai_released_bids_wy")
_KEPT_PAST_DUE = ("opengov_public", "sam_gov")


def _case(values: dict[str, str], otherwise: str) -> str:
    return "case source " + " ".join(f"when '{k}' then {v}" for k, v in values.items()) + f" else {otherwise} end"


_ROWS_SQL = f""", dealt as (select o_orderkey id, [{", ".join(f"'{s}'" for s in DEALT)}][(o_orderkey % {len(DEALT)})::int + 1] source, o_custkey, c_name || ['', ' County', ' University', ' School District', ' Port Authority'][(o_custkey % 5)::int + 1] agency,
 o_orderdate::date::timestamp as day, o_orderdate::date::timestamp + to_minutes((510 + 60 * (o_orderkey % 9))::int) wall, o_orderkey % 7 = 0 shut from orders join customer on o_custkey = c_custkey)
, mapped as (select *, {_case(_DUE, "wall")} due_at from dealt where not (shut and source in ({", ".join(f"'{s}'" for s in _NOT_SHUT)})))
, rec as (select source, case source when 'opengov_public' then 'C' || o_custkey || ':' || id when 'peoplesoft_ca' then 'C' || o_custkey || ':' || id when 'hands_hi' then 'HANDS:id:' || id else id::varchar end external_id,
 case source when 'delaware_open_bids_de' then 'State of Delaware - C' || o_custkey when 'esm_posting_board_sd' then 'State of South Dakota' else agency end agency,
 string_split({_case({k: f"'{v[0]}'" for k, v in _KINDS.items()}, "''")}, ' ')[(o_custkey % 5)::int + 1] agency_type, string_split({_case({k: f"'{v[1]}'" for k, v in _KINDS.items()}, "''")}, ' ')[(o_custkey % 5)::int + 1] jurisdiction_level,
 'RFP & <supply> ' || id || case source when 'cgi_advantage_mi' then ' {{"}}' else '' end title, case when source = 'opengov_public' and due_at < timestamp '1998-01-01' then 'closed' when source = 'sam_gov' and shut then 'closed' else 'open' end status,
 due_at, {_case({k: f"'{v}'" for k, v in _STATES.items()}, "null")} state_code from mapped where due_at >= timestamp '1998-01-01' or source in ({", ".join(f"'{s}'" for s in _KEPT_PAST_DUE)}))"""


@query("s_portal_records", f"{_ROWS_SQL} select * from rec")
def s_portal_records(spark, sf_dir):
    pages, path = landed_pages(spark, sf_dir)
    _, rows = portals.parse(pages, path, AS_OF)
    return portals.records(rows, AS_OF).select("source", "external_id", "agency", "agency_type", "jurisdiction_level", "title", "status", "due_at", "state_code")


#: A gate of each kind, one sweep with a page lost, one that reports a row too many.
SWEPT = ("mfmp_vip_fl", "delaware_open_bids_de", "esm_posting_board_sd", "powerpages_nc", "ivalua_app_az", "nebraska_das_ne")


def _broken(pages: DataFrame) -> DataFrame:
    """The pages with the second one of a portal lost, and a portal that reports a row too many."""
    lost = (F.col("source") == "esm_posting_board_sd") & (F.col("page") == 1)
    return pages.where(~lost).withColumn("reported", F.col("reported") + F.when(F.col("source") == "ivalua_app_az", 1).otherwise(0))


_GATES = {"mfmp_vip_fl": "exact", "hands_hi": "exact", "magic_public_ms": "exact", "esm_posting_board_sd": "exact", "eva_vbo_va": "exact", "powerpages_nc": "parsed", "opengov_public": "some", "cgi_advantage_mi": "exact", "periscope_nv": "exact", "ivalua_app_az": "exact", "sap_ariba_index_ar": "some", "peoplesoft_ca": "exact", "nebraska_das_ne": "some", "wyoming_ai_released_bids_wy": "some"}
#: A portal of one page loses none; the parsed gate wants every reported row as a record, so closed or past rows fail it.
_COMPLETE_SQL = f""", n as (select source, count(*) total, count(*) filter (where rn > {PAGE_ROWS} and rn <= {2 * PAGE_ROWS}) later from (select source, row_number() over (partition by source order by id) rn from dealt) group by 1)
, r as (select source, count(*) records from rec group by 1)
, sw as (select source, {_case({k: f"'{v}'" for k, v in _GATES.items()}, "'none'")} gate, total, later, coalesce(records, 0) records, (case source when 'esm_posting_board_sd' then later = 0 when 'ivalua_app_az' then false when 'powerpages_nc' then coalesce(records, 0) = total else true end) complete from n left join r using (source))"""


def _swept(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Records and counts of the broken sweeps."""
    pages, path = landed_pages(spark, sf_dir, SWEPT)
    told, rows = portals.parse(_broken(pages), path, AS_OF, list(SWEPT))
    made = portals.records(rows, AS_OF)
    return made, sweeps.counted(told, portals.item_keys(rows), made, {k: p.gate for k, p in portals.portals(AS_OF).items()})


_SWEPT_SQL = f"source in ({', '.join(repr(s) for s in SWEPT)})"


@query("u6_portal_sweeps", f"{_ROWS_SQL}{_COMPLETE_SQL} select source, gate, total - case when source = 'esm_posting_board_sd' then later else 0 end as rows, complete from sw where {_SWEPT_SQL}")
def u6_portal_sweeps(spark, sf_dir):
    return _swept(spark, sf_dir)[1].select("source", "gate", "rows", "complete")


_STORED_SQL = ", stored as (select source, external_id, 'open' status from rec where (length(external_id) + ascii(right(external_id, 1))) % 3 > 0 union all select source, 'gone-' || source || x, 'open' from n, range(3) t(x) union all select source, 'shut-' || source, 'closed' from n)"


@query("m6_closed_after_sweeps", f"{_ROWS_SQL}{_COMPLETE_SQL}{_STORED_SQL} select source, external_id from stored join sw using (source) where complete and {_SWEPT_SQL} and source <> 'delaware_open_bids_de' and external_id like 'gone-%'")
def m6_closed_after_sweeps(spark, sf_dir):
    made, state = _swept(spark, sf_dir)
    was = made.where((F.length("external_id") + F.ascii(F.right("external_id", F.lit(1)))) % 3 > 0).select("source", "external_id", F.lit("open").alias("status"))
    names = state.select("source")
    gone = names.select("source", F.explode(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda x: F.concat(F.lit("gone-"), "source", x.cast("string")))).alias("external_id"), F.lit("open").alias("status"))
    shut = names.select("source", F.concat(F.lit("shut-"), "source").alias("external_id"), F.lit("closed").alias("status"))
    closing = [k for k, p in portals.portals(AS_OF).items() if p.closing]
    return sweeps.closable(was.union(gone).union(shut), made, state, closing).select("source", "external_id")
