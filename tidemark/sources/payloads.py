"""Source parsers: captured payloads to postings of one shape. JSON by schema, feeds by XML, pages by JSON-LD."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import decode_entities, json_ld, strip_html

POSTING = "external_id string, title string, location string, url string, department string, employment_type string, description string, posted_at timestamp, raw_data string"


#: By source: where the list of postings lies in the payload, and where their fields lie in each; a|b: the first there is.
LAYOUTS: dict[str, dict] = {
    "greenhouse": {"list": "jobs", "id": "id", "title": "title", "location": "location.name", "url": "absolute_url", "department": "departments[0].name", "description": "content", "posted": "updated_at"},
    "lever": {"list": "", "id": "id", "title": "text", "location": "categories.location", "url": "hostedUrl", "department": "categories.team", "employment": "categories.commitment", "description": "descriptionPlain", "posted": "createdAt"},
    "ashby": {"list": "jobs", "id": "id", "title": "title", "location": "location", "url": "jobUrl", "department": "department", "employment": "employmentType", "description": "descriptionPlain", "posted": "publishedAt"},
    "smartrecruiters": {"list": "content", "id": "id", "title": "name", "location": "location.city", "url": "ref", "department": "department.label", "employment": "typeOfEmployment.label", "posted": "releasedDate"},
    "workable": {"list": "results", "id": "shortcode", "title": "title", "location": "location.city", "url": "url", "department": "department[0]", "employment": "type", "posted": "published"},
    "recruitee": {"list": "offers", "id": "id", "title": "title", "location": "location", "url": "careers_url", "department": "department", "employment": "employment_type_code", "description": "description", "posted": "published_at"},
    "pinpoint": {"list": "data", "id": "id", "title": "title", "location": "location.city", "url": "url", "department": "job.department.name", "employment": "employment_type_text", "description": "description"},
    "bamboohr": {"list": "result", "id": "id", "title": "jobOpeningName", "location": "location.city", "department": "departmentLabel", "employment": "employmentStatusLabel"},
    "rippling": {"list": "items", "id": "uuid", "title": "name", "location": "workLocation.label", "url": "url", "department": "department.label"},
    "gem": {"list": "", "id": "id", "title": "title", "location": "location.name", "url": "absolute_url", "department": "departments[0].name", "description": "content", "posted": "first_published_at"},
    "kula": {"list": "jobs", "id": "id", "title": "title", "location": "location", "url": "url", "department": "department"},
    "manatal": {"list": "results", "id": "id", "title": "position_name", "location": "location_display", "department": "department", "employment": "contract_details", "description": "description"},
    "comeet": {"list": "", "id": "uid", "title": "name", "location": "location.name", "url": "url_active_page", "department": "department", "employment": "employment_type", "posted": "time_updated"},
    "eightfold": {"list": "positions", "id": "id", "title": "name", "location": "location", "url": "canonicalPositionUrl", "department": "department", "posted": "t_create"},
    "workday": {"list": "jobPostings", "id": "bulletFields[0]|externalPath", "title": "title", "location": "locationsText", "url": "externalPath"},
    "oracle": {"list": "items[0].requisitionList", "id": "Id", "title": "Title", "location": "PrimaryLocation", "posted": "PostedDate"},
    "amazon": {"list": "jobs", "id": "id_icims", "title": "title", "location": "normalized_location", "url": "job_path", "department": "business_category", "employment": "job_schedule_type", "description": "description", "posted": "posted_date"},
    "adp": {"list": "jobRequisitions", "id": "reqId", "title": "publishedJobTitle|jobTitle", "employment": "workLevelCode", "description": "jobDescription", "posted": "postingDate"},
    "adpwfn": {"list": "jobRequisitions", "id": "itemID", "title": "requisitionTitle", "location": "requisitionLocations[0].nameCode.shortName", "employment": "workLevelCode.shortName", "description": "requisitionDescription", "posted": "postDate"},
    "dayforce": {"list": "jobPostings", "id": "jobPostingId", "title": "jobTitle", "location": "postingLocations[0].formattedAddress", "description": "jobDescription", "posted": "postingStartTimestampUTC"},
    "paycom": {"list": "jobs", "id": "jobId", "title": "jobTitle", "location": "locations", "department": "jobCategory", "employment": "positionType", "description": "description"},
    "paylocity": {"list": "Jobs", "id": "JobId", "title": "JobTitle", "location": "LocationName", "department": "HiringDepartment", "posted": "PublishedDate"},
    "recman": {"list": "posts", "id": "AdID", "title": "Name|JobTitle", "location": "Place", "posted": "Created"},
    "talentadore": {"list": "jobs", "id": "job_token", "title": "name", "location": "location", "url": "link", "employment": "employment_type", "description": "description_html"},
    "ukg": {"list": "opportunities", "id": "Id", "title": "Title", "location": "Locations[0].LocalizedName", "department": "JobCategoryName", "posted": "PostedDate"},
    "visma": {"list": "hits", "id": "id", "title": "headline", "location": "workplace_address.municipality", "url": "webpage_url", "employment": "working_hours_type.label", "description": "description.text_formatted|description.text", "posted": "publication_date"},
    "zoho": {"list": "", "id": "id", "title": "Posting_Title|Job_Opening_Name", "location": "City", "department": "Department|Industry", "employment": "Job_Type", "description": "Job_Description", "posted": "Date_Opened"},
    "icims": {"list": "jobs", "id": "data.req_id|data.slug", "title": "data.title", "location": "data.full_location|data.short_location|data.location_name", "url": "data.apply_url", "department": "data.categories[0].name", "employment": "data.employment_type", "description": "data.description", "posted": "data.posted_date|data.create_date"},
    "hrmanager": {"list": "Items", "id": "Id", "title": "Name", "location": "PositionLocation.Name", "url": "AdvertisementUrlSecure|AdvertisementUrl", "department": "Department.Name", "posted": "Published|Created"},
    "jobylon": {"list": "", "id": "id", "title": "title", "location": "town", "url": "url", "department": "department"},
    "brassring": {"list": "Jobs.Job", "id": "Questions.reqid", "title": "Questions.jobtitle", "location": "Questions.location", "url": "Link", "department": "Questions.department", "description": "Questions.jobdescription", "posted": "Questions.lastupdated"},
    "breezy": {"list": "", "id": "id|friendly_id", "title": "name", "location": "location.name", "url": "url", "department": "department", "employment": "type.name", "posted": "published_date"},
    "netflix": {"list": "positions", "id": "id", "title": "name", "location": "location", "url": "canonicalPositionUrl", "department": "department", "posted": "t_create"},
}


#: List pages: a row, and what in it is what; whether ids are unique within a board only.
LISTS = {
    "silkroad": {"row": r'<a id="Jobs_PagedJobList_Job-\d+".*?</a>', "id": r"Jobs_PagedJobList_Job-(\d+)", "title": r'class="sr-panel__title"[^>]*>(.*?)</div>', "location": r'class="sr-panel__location"[^>]*>(.*?)</div>', "url": r'href="([^"]+)"', "by_board": True},
    "reachmee": {"row": r'<li class="at-jobs-list-item">.*?</li>', "id": r'href="[^"]*/jobs/(\d+)-', "title": r'href="[^"]*/jobs/\d+-[^"]*"[^>]*>(.*?)</a>', "location": r'<div class="at-jobs-list-cell-2">(.*?)</div>', "url": r'href="([^"]*/jobs/\d+-[^"?#]*)', "by_board": False},
    "google": {"row": r'<a [^>]*href="[^"]*jobs/results/\d+-[^"]*".*?</a>', "id": r"jobs/results/(\d+)-", "title": r'aria-label="Learn more about ([^"]*)"', "url": r'href="([^"]*jobs/results/\d+-[^"?]*)', "by_board": False},
    "taleo": {"row": r'<a [^>]*href="[^"]*jobdetail\.ftl\?job=\w+[^"]*".*?</a>', "id": r"jobdetail\.ftl\?job=(\w+)", "title": r">([^<]+)</a>", "url": r'href="([^"]*jobdetail\.ftl\?job=\w+)', "by_board": False},
}


def when_posted(c: Column) -> Column:
    """Epochs in seconds or milliseconds, or ISO dates."""
    n = c.try_cast("long")
    return F.coalesce(F.timestamp_seconds(F.when(n >= 100_000_000_000, n / 1000).otherwise(n)), F.try_to_timestamp(c))


# Fixed value: what a requisition number looks like; it has a digit.
REQUISITION = r"^(?=.*[0-9])[A-Za-z0-9][A-Za-z0-9_.-]{1,39}$"


def workday_id(bullet: Column, path: Column) -> Column:
    """The first bullet if it is a requisition number, else the end of the posting's path, else the path."""
    end = F.regexp_extract(F.coalesce(path, F.lit("")), r"_([A-Za-z0-9][A-Za-z0-9-]*)/?$", 1)
    return F.when(bullet.rlike(REQUISITION), bullet).when(end != "", end).otherwise(F.nullif(path, F.lit("")))


def parse_json(df: DataFrame, source: str, payload: str = "payload", board: str | None = None) -> DataFrame:
    """Rows of payloads to rows of POSTING; payloads that are no JSON, or lack the list, give none.

    board: the column with the tenant of each payload; sources whose ids are unique within a tenant only need it.
    """
    at = LAYOUTS[source]
    listed = F.get_json_object(payload, f"$.{at['list']}") if at["list"] else F.col(payload)
    each = df.select("*", F.explode(F.from_json(listed, "array<string>")).alias("j"))
    get = lambda k: F.coalesce(*(F.get_json_object("j", f"$.{p}") for p in at[k].split("|"))) if k in at else F.lit(None).cast("string")
    own = get("id")
    if source == "workday":
        own = workday_id(F.get_json_object("j", "$.bulletFields[0]"), F.get_json_object("j", "$.externalPath"))
    elif source == "ukg":
        own = F.lower(own)
    elif source in ("adp", "adpwfn"):
        own = F.concat(F.col(board) if board else F.lit("x"), F.lit("_"), own)
    return each.filter(own.isNotNull()).select(
        F.concat(F.lit(source + "_"), own).alias("external_id"), F.trim(get("title")).alias("title"), get("location").alias("location"), get("url").alias("url"), get("department").alias("department"),
        get("employment").alias("employment_type"), strip_html(get("description")).alias("description"), when_posted(get("posted")).alias("posted_at"), F.col("j").alias("raw_data"),
    )


def parse_feed(df: DataFrame, source: str, payload: str = "payload") -> DataFrame:
    """RSS: one posting an item."""
    shape = "struct<channel:struct<item:array<struct<title:string,link:string,guid:string,pubDate:string,description:string,location:string>>>>"
    item = F.explode(F.from_xml(payload, shape)["channel"]["item"])
    each = df.select(item.alias("i"))
    key = F.coalesce("i.guid", "i.link")
    return each.select(
        F.concat(F.lit(source + "_"), F.regexp_extract(key, r"([^/=]+)/?$", 1)).alias("external_id"), F.col("i.title").alias("title"), F.col("i.location").alias("location"), F.col("i.link").alias("url"), F.lit(None).cast("string").alias("department"),
        F.lit(None).cast("string").alias("employment_type"), strip_html(F.col("i.description")).alias("description"), F.try_to_timestamp(F.col("i.pubDate"), F.lit("EEE, dd MMM yyyy HH:mm:ss Z")).alias("posted_at"), F.to_json("i").alias("raw_data"),
    )


def parse_positions(df: DataFrame, source: str = "personio", payload: str = "payload") -> DataFrame:
    """Position feeds in XML: one posting a position."""
    shape = "struct<position:array<struct<id:string,name:string,office:string,department:string,schedule:string,employmentType:string,createdAt:string,jobDescriptions:struct<jobDescription:array<struct<name:string,value:string>>>>>>"
    each = df.select(F.explode(F.from_xml(payload, shape)["position"]).alias("i"))
    text = F.array_join(F.transform("i.jobDescriptions.jobDescription", lambda d: F.concat_ws("\n", d["name"], d["value"])), "\n")
    return each.select(
        F.concat(F.lit(source + "_"), "i.id").alias("external_id"), F.col("i.name").alias("title"), F.coalesce("i.office", F.lit("Remote")).alias("location"), F.lit(None).cast("string").alias("url"), F.col("i.department").alias("department"),
        F.coalesce("i.schedule", "i.employmentType").alias("employment_type"), strip_html(text).alias("description"), F.try_to_timestamp(F.col("i.createdAt")).alias("posted_at"), F.to_json("i").alias("raw_data"),
    )


def parse_page(df: DataFrame, source: str, html: str = "html", url: str = "url") -> DataFrame:
    """Pages that state a posting as JSON-LD, with its pay."""
    j = F.col("j")
    get = lambda p: F.get_json_object(j, f"$.{p}")
    each = df.withColumn("j", json_ld(F.col(html))).filter(j.isNotNull())
    return each.select(
        F.concat(F.lit(source + "_"), F.coalesce(get("identifier.value"), F.regexp_extract(url, r"([^/?#]+)/?(?:[?#].*)?$", 1))).alias("external_id"), get("title").alias("title"), get("jobLocation.address.addressLocality").alias("location"), F.col(url).alias("url"),
        get("employmentType").alias("employment_type"), strip_html(get("description")).alias("description"), F.try_to_timestamp(get("datePosted")).alias("posted_at"),
        F.coalesce(get("baseSalary.value.minValue"), get("baseSalary.value.value")).alias("salary_min"), get("baseSalary.value.maxValue").alias("salary_max"), get("baseSalary.currency").alias("salary_currency"), get("baseSalary.value.unitText").alias("salary_interval"),
    )


def parse_list_page(df: DataFrame, source: str, html: str = "html", board: str = "board") -> DataFrame:
    """Postings of a board's list page, for sources that publish pages only. board: the tenant's name; see LISTS."""
    at = LISTS[source]
    rows = df.select(F.col(board).alias("b"), F.explode(F.regexp_extract_all(html, F.lit("(?s)" + at["row"]), F.lit(0))).alias("r"))
    text = lambda c: F.nullif(F.trim(F.regexp_replace(decode_entities(F.regexp_replace(c, "<[^>]*>", " ")), r"\s+", " ")), F.lit(""))
    get = lambda k: text(F.regexp_extract("r", "(?s)" + at[k], 1)) if k in at else F.lit(None).cast("string")
    key = F.concat(F.lit(f"{source}_"), F.concat(F.lower("b"), F.lit("_")) if at["by_board"] else F.lit(""), get("id"))
    found = rows.filter(get("id").isNotNull() & get("title").isNotNull())
    return found.select(key.alias("external_id"), get("title").alias("title"), get("location").alias("location"), get("url").alias("url"), get("department").alias("department")).dropDuplicates(["external_id"])


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; lines that do not parse are left out."""
    shape = T.StructType.fromDDL(schema).add("_corrupt", T.StringType())
    return spark.read.schema(shape).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path).filter(F.col("_corrupt").isNull()).drop("_corrupt")


def import_slugs(spark: SparkSession, path: str, known: DataFrame) -> DataFrame:
    """A CSV of (ats, slug), without those that are known."""
    rows = spark.read.schema("ats string, slug string").option("header", True).csv(path)
    return rows.filter("slug IS NOT NULL").dropDuplicates(["ats", "slug"]).join(known.select("ats", "slug"), ["ats", "slug"], "left_anti")
