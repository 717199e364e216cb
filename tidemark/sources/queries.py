"""Named queries over the source parsers, on payloads made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query
from . import payloads


@query("parse_greenhouse", "S-23 adapters:greenhouse J-1", "SELECT concat('greenhouse_', CAST(p_partkey AS VARCHAR)) AS external_id, p_name AS title, p_brand AS location, p_type AS department FROM part")
def _greenhouse(t):
    job = F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.struct(F.col("p_brand").alias("name")).alias("location"), F.array(F.struct(F.col("p_type").alias("name"))).alias("departments"))
    payload = t.part.select(F.to_json(F.struct(F.array(job).alias("jobs"))).alias("payload"))
    return payloads.parse_json(payload, "greenhouse").select("external_id", "title", "location", "department")


@query("parse_lever", "adapters:lever D-2", "SELECT concat('lever_', CAST(o_orderkey AS VARCHAR)) AS external_id, o_orderpriority AS title, CAST(epoch(o_orderdate) AS BIGINT) AS posted_ts FROM orders")
def _lever(t):
    job = F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("text"), (F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) * 1000).alias("createdAt"))
    payload = t.orders.select(F.to_json(F.array(job)).alias("payload"))
    return payloads.parse_json(payload, "lever").select("external_id", "title", F.unix_timestamp("posted_at").alias("posted_ts"))


@query("parse_feed", "adapters:teamtailor,varbi,successfactors,personio", "SELECT concat('teamtailor_', CAST(p_partkey AS VARCHAR)) AS external_id, p_name AS title FROM part")
def _feed(t):
    k = F.col("p_partkey").cast("string")
    xml = F.concat(F.lit("<rss><channel><item><title>"), "p_name", F.lit("</title><link>https://x.org/jobs/"), k, F.lit("</link><guid>"), k, F.lit("</guid></item></channel></rss>"))
    return payloads.parse_feed(t.part.select(xml.alias("payload")), "teamtailor").select("external_id", "title")


@query("parse_json_ld", "S-23 M-6 adapters:careerplug,jazzhr,jobvite,avature", "SELECT concat('careerplug_', CAST(p_partkey AS VARCHAR)) AS external_id, p_name AS title, CAST(p_size AS VARCHAR) AS salary_min, 'USD' AS salary_currency FROM part")
def _ld(t):
    ld = F.to_json(F.struct(F.lit("JobPosting").alias("@type"), F.col("p_name").alias("title"), F.struct(F.lit("USD").alias("currency"), F.struct(F.col("p_size").alias("minValue"), F.lit("YEAR").alias("unitText")).alias("value")).alias("baseSalary")))
    page = t.part.select(F.concat(F.lit("https://x.org/jobs/"), F.col("p_partkey").cast("string"), F.lit("?a=1")).alias("url"), F.concat(F.lit('<html><script type="application/ld+json">'), ld, F.lit("</script></html>")).alias("html"))
    return payloads.parse_page(page, "careerplug").select("external_id", "title", "salary_min", "salary_currency")


@query("grouped_listings", "A-21 adapters:rippling", "SELECT l_partkey AS uuid, count(DISTINCT l_suppkey) AS places FROM lineitem GROUP BY 1")
def _grouped(t):
    return t.lineitem.groupBy(F.col("l_partkey").alias("uuid")).agg(F.count_distinct("l_suppkey").alias("places"))


@query("first_site_wins", "O-5 adapters:workday", "SELECT l_partkey, min(l_suppkey) AS site FROM lineitem GROUP BY 1")
def _sites(t):
    return t.lineitem.groupBy("l_partkey").agg(F.min("l_suppkey").alias("site"))


@query("parse_positions", "adapters:personio", "SELECT concat('personio_', CAST(p_partkey AS VARCHAR)) AS external_id, p_name AS title, 'Remote' AS location FROM part")
def _positions(t):
    xml = F.concat(F.lit("<workzag-jobs><position><id>"), F.col("p_partkey").cast("string"), F.lit("</id><name>"), "p_name", F.lit("</name></position></workzag-jobs>"))
    return payloads.parse_positions(t.part.select(xml.alias("payload"))).select("external_id", "title", "location")


#: Payloads as the sources send them, with what surrounds the fields that are read: source, payload; the first posting's id, title and place.
PAYLOADS = [
    ("workday", '{"total": 2, "jobPostings": [{"title": "Cook", "externalPath": "/job/Graz/Cook_JR-77", "locationsText": "Graz", "bulletFields": ["JR-77"]}]}', "workday_JR-77", "Cook", "Graz"),
    ("workday", '{"jobPostings": [{"title": "Cook", "externalPath": "/job/Graz/Cook_JR101829", "bulletFields": ["Graz, Austria"]}]}', "workday_JR101829", "Cook", None),
    ("workday", '{"jobPostings": [{"title": "Cook", "externalPath": "/job/Cook", "bulletFields": []}]}', "workday_/job/Cook", "Cook", None),
    ("ukg", '{"opportunities": [{"Id": "AB-12-Cd", "Title": " Cook ", "RequisitionNumber": "R1", "Locations": [{"LocalizedName": "Graz"}], "FullTime": true}]}', "ukg_ab-12-cd", "Cook", "Graz"),
    ("adp", '{"jobRequisitions": [{"reqId": "500", "publishedJobTitle": "Cook", "workLevelCode": "Full Time"}]}', "adp_board_500", "Cook", None),
    ("adpwfn", '{"jobRequisitions": [{"itemID": "9_1", "requisitionTitle": "Cook", "requisitionLocations": [{"nameCode": {"shortName": "Graz"}}]}]}', "adpwfn_board_9_1", "Cook", "Graz"),
    ("breezy", '[{"friendly_id": "ab12-cook", "name": "Cook", "location": {"name": "Graz", "is_remote": false}}]', "breezy_ab12-cook", "Cook", "Graz"),
    ("greenhouse", '{"jobs": [{"id": 12, "title": "Cook", "location": {"name": "Graz"}, "departments": [{"name": "Kitchen"}], "absolute_url": "https://x.org"}], "meta": {"total": 1}}', "greenhouse_12", "Cook", "Graz"),
    ("ashby", '{"jobs": [{"id": "u-1", "title": "Cook", "location": "Graz", "isListed": true}], "apiVersion": "1"}', "ashby_u-1", "Cook", "Graz"),
    ("smartrecruiters", '{"offset": 0, "content": [{"id": "7440", "name": "Cook", "location": {"city": "Graz", "country": "at"}}]}', "smartrecruiters_7440", "Cook", "Graz"),
    ("workable", '{"results": [{"shortcode": "AB12", "title": "Cook", "location": {"city": "Graz"}, "remote": false}]}', "workable_AB12", "Cook", "Graz"),
    ("recruitee", '{"offers": [{"id": 5, "title": "Cook", "location": "Graz", "department": "Kitchen"}]}', "recruitee_5", "Cook", "Graz"),
    ("bamboohr", '{"meta": {"totalCount": 1}, "result": [{"id": "33", "jobOpeningName": "Cook", "location": {"city": "Graz", "state": null}}]}', "bamboohr_33", "Cook", "Graz"),
    ("rippling", '{"items": [{"uuid": "u-9", "name": "Cook", "workLocation": {"label": "Graz"}}]}', "rippling_u-9", "Cook", "Graz"),
    ("oracle", '{"items": [{"TotalJobsCount": 1, "requisitionList": [{"Id": "300", "Title": "Cook", "PrimaryLocation": "Graz"}]}]}', "oracle_300", "Cook", "Graz"),
    ("icims", '{"jobs": [{"data": {"slug": "44", "title": "Cook", "short_location": "Graz"}}]}', "icims_44", "Cook", "Graz"),
    ("recman", '{"posts": [{"AdID": 3, "JobTitle": "Cook", "Place": "Graz"}]}', "recman_3", "Cook", "Graz"),
    ("zoho", '[{"id": "z1", "Job_Opening_Name": "Cook", "City": "Graz"}]', "zoho_z1", "Cook", "Graz"),
    ("paylocity", '{"Jobs": [{"JobId": 8, "JobTitle": "Cook", "LocationName": "Graz"}]}', "paylocity_8", "Cook", "Graz"),
    ("visma", '{"total": {"value": 1}, "hits": [{"id": "v1", "headline": "Cook", "workplace_address": {"municipality": "Graz"}}]}', "visma_v1", "Cook", "Graz"),
    ("comeet", '[{"uid": "C.1", "name": "Cook", "location": {"name": "Graz"}}]', "comeet_C.1", "Cook", "Graz"),
    ("dayforce", '{"jobPostings": [{"jobPostingId": 71, "jobTitle": "Cook", "postingLocations": [{"formattedAddress": "Graz"}]}]}', "dayforce_71", "Cook", "Graz"),
    ("lever", '{"ok": false, "error": "Document not found"}', None, None, None),
    ("ashby", "<html>blocked</html>", None, None, None),
]
LIST_PAGES = [
    ("silkroad", '<h2 id="Jobs_PagedJobList_Category__1">Kitchen</h2><a id="Jobs_PagedJobList_Job-12" class="p" href="/Acme/Main/jobs/12?x=1&amp;y=2"><div class="sr-panel__title">Head &amp; Cook</div><div class="sr-panel__location"> Graz </div></a>', "silkroad_board_12", "Head & Cook", "Graz"),
    ("reachmee", '<ul><li class="at-jobs-list-item"><div class="at-jobs-list-cell-1"><a href="https://x.org/jobs/55-cook?rmlang=SE">Kock</a></div><div class="at-jobs-list-cell-2">Graz</div></li></ul>', "reachmee_55", "Kock", "Graz"),
    ("google", '<a class="z" href="./jobs/results/1234-cook?q=x" aria-label="Learn more about Cook">x</a>', "google_1234", "Cook", None),
    ("taleo", '<a href="/careersection/2/jobdetail.ftl?job=TA1&amp;lang=en">Cook</a>', "taleo_TA1", "Cook", None),
    ("silkroad", "<p>No openings</p>", None, None, None),
]


def _expected(rows) -> str:
    cell = lambda v: "NULL" if v is None else f"'{v}'"
    return "SELECT * FROM (VALUES " + ", ".join(f"({cell(s)}, {cell(i)}, {cell(x)}, {cell(w)})" for s, _, i, x, w in rows if i) + ") v(source, external_id, title, location)"


def _parsed(t, rows, parse):
    from functools import reduce

    parts = []
    for source in dict.fromkeys(r[0] for r in rows):
        own = t.spark.createDataFrame([(p, "Board") for s, p, *_ in rows if s == source], "payload string, board string")
        parts.append(parse(own, source).select(F.lit(source).alias("source"), "external_id", "title", "location"))
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("parse_payloads", "U-13 adapters:workday,ukg,adp,adp_workforcenow,breezy,greenhouse,ashby,smartrecruiters,workable,recruitee,bamboohr,rippling,oracle,icims,recman,zoho,paylocity,visma,comeet,dayforce", _expected(PAYLOADS))
def _payloads(t):
    return _parsed(t, PAYLOADS, lambda df, source: payloads.parse_json(df.withColumn("board", F.lower("board")), source, board="board"))


@query("parse_list_pages", "adapters:silkroad,reachmee,google,taleo", _expected(LIST_PAGES))
def _list_pages(t):
    return _parsed(t, LIST_PAGES, lambda df, source: payloads.parse_list_page(df, source, html="payload"))


@query("parse_every_layout", "adapters:json", "SELECT s AS source, count(*) AS n FROM (SELECT unnest([" + ", ".join(f"'{k}'" for k in payloads.LAYOUTS) + "]) AS s) GROUP BY 1")
def _layouts(t):
    """A payload of one posting for each source, built from its layout, through its parser."""
    from functools import reduce

    def nest(path, value):
        for step in reversed(path.split(".")):
            name, _, index = step.partition("[")
            value = {name: [value] if index else value}
        return value

    def merged(a, b):
        for k, v in b.items():
            a[k] = merged(a[k], v) if isinstance(v, dict) and isinstance(a.get(k), dict) else [merged(a[k][0], v[0])] if isinstance(v, list) and isinstance(a.get(k), list) and isinstance(v[0], dict) else v
        return a

    import json

    out = []
    for source, at in payloads.LAYOUTS.items():
        job = reduce(merged, (nest(at[k].split("|")[0], "x7") for k in at if k != "list"), {})
        whole = nest(at["list"], [job]) if at["list"] else [job]
        df = t.spark.range(1).select(F.lit(json.dumps(whole)).alias("payload"))
        out.append(payloads.parse_json(df, source).filter(F.lower("external_id").endswith("x7") & (F.col("title") == "x7")).select(F.lit(source).alias("source")))
    return reduce(lambda a, b: a.unionByName(b), out).groupBy("source").agg(F.count("*").alias("n"))
