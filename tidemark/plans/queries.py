"""Named queries over search: flat filters, location groups, ranked lists, and the shapes of results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query
from . import documents, search
from .search import SearchRequest



def as_of():
    return F.expr("TIMESTAMP_NTZ '2001-08-02 00:00:00'")


@query(
    "search_jobs",
    "F-1 F-5 F-11 F-14 J-2 P-1 W-8",
    "SELECT id, title, company_name, ats, first_seen_at FROM {jobs} JOIN {companies} USING (company_id) WHERE removed_at IS NULL AND (regexp_matches(title, '\\bring\\b') OR (regexp_matches(title, '\\bblue\\b') AND regexp_matches(title, '\\bbolt\\b'))) AND experience_level IN ('senior', 'lead') ORDER BY first_seen_at DESC, id LIMIT 50",
)
def _search(t):
    found = search.where(t.jobs, SearchRequest(q="ring, blue bolt", experience_level="senior,lead"), as_of())
    page = search.page_of(found, SearchRequest(), [F.desc("first_seen_at"), F.col("id")])
    return page.join(t.companies, "company_id").select("id", "title", "company_name", "ats", "first_seen_at")


@query("filter_salary", "F-3 F-4 H12", "SELECT id FROM {postings} WHERE removed_at IS NULL AND salary_min_annual >= 85 AND salary_min_annual <= 200000 AND salary_currency = 'EUR'")
def _salary(t):
    return search.where(t.postings, SearchRequest(salary_min="85k", salary_max="200000", salary_currency="eur"), as_of()).select("id")


@query("filter_work_mode", "F-7 F-8 F-21", "SELECT id FROM {postings} WHERE removed_at IS NULL AND (is_remote OR lower(workplace_type) = 'hybrid' OR (workplace_type IS NULL AND NOT coalesce(is_remote, false)))")
def _mode(t):
    return search.where(t.postings, SearchRequest(work_mode="remote,Hybrid", include_unlabeled="true"), as_of()).select("id")


@query("filter_office_only", "F-7", "SELECT id FROM {postings} WHERE removed_at IS NULL AND lower(workplace_type) IN ('hybrid', 'onsite')")
def _office(t):
    return search.where(t.postings, SearchRequest(work_mode="hybrid,on-site"), as_of()).select("id")


@query("filter_employment", "F-9 F-2", "SELECT id FROM {postings} WHERE removed_at IS NULL AND employment_type IN ('Full-time', 'Contract')")
def _employment(t):
    return search.where(t.postings, SearchRequest(employment_type="full_time, CONTRACTOR, full_time"), as_of()).select("id")


@query("filter_flags", "F-12 F-13", "SELECT id FROM {postings} WHERE removed_at IS NULL AND is_remote AND visa_sponsorship = 'yes' AND remote_worldwide")
def _flags(t):
    return search.where(t.postings, SearchRequest(remote="true", visa="true", remote_worldwide="true"), as_of()).select("id")


@query("filter_company", "F-12", "SELECT id FROM {postings} WHERE removed_at IS NULL AND company_id = 42")
def _company(t):
    return search.where(t.postings, SearchRequest(company_id=42), as_of()).select("id")


@query("filter_ats", "F-12 J-2", "SELECT id FROM {postings} JOIN {companies} USING (company_id) WHERE removed_at IS NULL AND lower(ats) IN ('machinery', 'building')")
def _ats(t):
    return search.where(t.postings.join(t.companies, "company_id"), SearchRequest(ats="Machinery,BUILDING"), as_of()).select("id")


@query("filter_posted_days", "F-14 D-1 D5", "SELECT id FROM {postings} WHERE removed_at IS NULL AND coalesce(posted_at, first_seen_at) >= {as_of} - INTERVAL 90 DAY")
def _posted(t):
    return search.where(t.postings, SearchRequest(posted="last_3 months"), as_of()).select("id")


@query("filter_posted_calendar", "F-14 D-1 D5 D6", "SELECT id FROM {postings} WHERE removed_at IS NULL AND coalesce(posted_at, first_seen_at) >= {as_of} - INTERVAL 3 MONTH")
def _calendar(t):
    return search.where(t.postings, SearchRequest(posted="3mo", month_as_days=False), as_of()).select("id")


@query("keyword_substring", "F-6 F-30", "SELECT c_custkey FROM customer WHERE c_name ILIKE '%0012%'")
def _substring(t):
    return t.customer.filter(F.col("c_name").ilike("%0012%")).select("c_custkey")


@query("feed_prefixes", "F-25", "SELECT external_id FROM {postings} WHERE external_id LIKE 'ats\\_1%' ESCAPE '\\' OR external_id LIKE 'ats\\_25%' ESCAPE '\\'")
def _feeds(t):
    return t.postings.filter(F.col("external_id").startswith("ats_1") | F.col("external_id").startswith("ats_25")).select("external_id")


@query("url_prefilter", "F-26 F-27", "SELECT page_id FROM pages WHERE regexp_matches(lower(url), 'example\\.(com|org)') AND NOT regexp_matches(url, '/en/[0-9]$')")
def _prefilter(t):
    return t.pages.filter(F.lower("url").rlike(r"example\.(com|org)") & ~F.col("url").rlike(r"/en/[0-9]$")).select("page_id")


@query("unmet_demand", "F-24 X-9", "SELECT user_id, count(*) AS searches FROM events WHERE event_type = 'view' GROUP BY 1 HAVING coalesce(min(value), 0) <= 5 ORDER BY searches DESC, user_id LIMIT 20")
def _unmet(t):
    own = t.events.filter("event_type = 'view'").groupBy("user_id").agg(F.count("*").alias("searches"), F.min("value").alias("least"))
    return own.filter(F.coalesce("least", F.lit(0)) <= 5).select("user_id", "searches").orderBy(F.desc("searches"), "user_id").limit(20)


def located(t):
    """Postings with a place: the market segment as city, and a country by nation key."""
    code = F.element_at(F.lit(["us", "gb", "de", "fr", "ge"]), (F.col("nation_key") % 5 + 1).cast("int"))
    where = t.companies.select("company_id", F.lower("ats").alias("city"), code.alias("code"))
    rows = t.postings.join(where, "company_id")
    return rows.select("*", F.col("city").alias("location"), F.array("city").alias("location_tokens"), F.array("code").alias("location_countries"))


PLACED = "(SELECT j.*, lower(ats) AS city, CASE nation_key % 5 WHEN 0 THEN 'us' WHEN 1 THEN 'gb' WHEN 2 THEN 'de' WHEN 3 THEN 'fr' ELSE 'ge' END AS code FROM {postings} j JOIN {companies} USING (company_id) WHERE removed_at IS NULL)"


def _location_query(name, location, predicate, rows="F-15", **more):
    @query(name, rows, f"SELECT id FROM {PLACED} WHERE {predicate}")
    def run(t):
        return search.where(located(t), SearchRequest(location=location, **more), as_of()).select("id")


_location_query("location_place_country", "Machinery, Building, Germany", "city IN ('machinery', 'building') AND code = 'de'")
_location_query("location_country_first", "United States, Furniture, Household", "city IN ('furniture', 'household') AND code = 'us'")
_location_query("location_two_countries", "France, Germany", "code IN ('fr', 'de')", "F-15 F-16")
_location_query("location_alternatives", ["Machinery|France", "Germany"], "(city = 'machinery' AND code = 'fr') OR code = 'de'", "F-15 F-17")
_location_query("location_ambiguous", "Georgia", "code = 'ge' OR city = 'georgia'", "F-15")
_location_query("location_region", "Building, DACH", "city = 'building' AND code IN ('de', 'at', 'ch')", "F-18")
_location_query("location_home", ["Machinery"], "city = 'machinery' AND code = 'fr'", "F-19", home="Machinery|France")


VOTED = f"(SELECT place, code FROM (SELECT place, code, n, sum(n) OVER (PARTITION BY place) AS total, row_number() OVER (PARTITION BY place ORDER BY n DESC, code) AS k FROM (SELECT city AS place, code, count(*) AS n FROM {PLACED} GROUP BY 1, 2)) WHERE total >= 20 AND n >= 0.3 * total AND k <= 3)"


@query("remote_widening", "F-20 A-8", f"SELECT id FROM {PLACED} WHERE is_remote AND (city = 'machinery' OR code IN (SELECT code FROM {VOTED} WHERE place = 'machinery') OR remote_worldwide AND EXISTS (SELECT 1 FROM {VOTED} WHERE place = 'machinery'))")
def _widening(t):
    rows, request = located(t).filter(F.col("removed_at").isNull()), SearchRequest(location="Machinery", remote="true")
    return search.where(rows, request, as_of(), search.widened_countries(rows, request)).select("id")


@query(
    "remote_widening_modes",
    "F-20 A-8",
    f"SELECT id FROM {PLACED} WHERE is_remote AND (city = 'building' AND code = 'fr' OR EXISTS (SELECT 1 FROM {VOTED} WHERE place = 'building') AND (code = 'fr' OR code IN (SELECT code FROM {VOTED} WHERE place = 'building') OR remote_worldwide)) OR lower(workplace_type) = 'hybrid' AND city = 'building' AND code = 'fr'",
)
def _widening_modes(t):
    """Remote postings widen to the countries of the place and to that named; hybrid ones keep the place."""
    rows = located(t).filter(F.col("removed_at").isNull())
    request = SearchRequest(location="Building, France", work_mode="remote,hybrid")
    return search.where(rows, request, as_of(), search.widened_countries(rows, request)).select("id")


def linked(t):
    """Live postings with a link that postings of one title share, with and without a slash at its end."""
    return t.jobs.filter(F.col("removed_at").isNull()).withColumn("link", F.concat(F.lit("https://x.org/"), F.col("title_key").cast("string"), F.when(F.col("id") % 2 == 0, "/").otherwise("")))


ROLES = ("ring", "blue bolt", "red widgat")
SPLIT = "string_split(lower(title), ' ')"


def _errors(w: str) -> str:
    return f"list_transform({SPLIT}, lambda x: levenshtein(x, '{w}'))"


def _has(role: str) -> str:
    """All words of the role are in the title: from five letters with one error, from nine with two."""
    return " AND ".join(f"list_min({_errors(w)}) <= {2 if len(w) > 8 else 1 if len(w) > 4 else 0}" for w in role.split())


def _best(role: str) -> str:
    """Least errors, nearest words, fewest other words, newest, id."""
    own = role.split()
    place = lambda w: f"list_position({_errors(w)}, list_min({_errors(w)}))"
    gaps = [f"least(CASE WHEN {place(y)} > {place(x)} THEN {place(y)} - {place(x)} ELSE {place(x)} - {place(y)} + 1 END, 8)" for x, y in zip(own, own[1:], strict=False)]
    return f"{' + '.join(f'list_min({_errors(w)})' for w in own)}, {' + '.join(gaps) or '0'}, len({SPLIT}), first_seen_at DESC, id"


def _lists(depth: int) -> str:
    one = "SELECT id, title, title_key, {k} AS role, row_number() OVER (ORDER BY {best}) AS rank FROM {{jobs}} WHERE removed_at IS NULL AND {has}"
    return f"(SELECT * FROM ({' UNION ALL '.join(one.format(k=k, has=_has(r), best=_best(r)) for k, r in enumerate(ROLES))}) WHERE rank <= {depth})".replace("{{jobs}}", "{jobs}")


def _interleaved(limit: int, offset: int) -> str:
    first = f"SELECT id, title, role, rank, row_number() OVER (PARTITION BY title_key ORDER BY rank, role) AS turn FROM {_lists(limit + offset)}"
    return f"SELECT id, title, CAST(role AS INTEGER) AS role, place FROM (SELECT *, row_number() OVER (ORDER BY rank, role) - 1 AS place FROM ({first}) WHERE turn = 1) WHERE place >= {offset} AND place < {offset + limit}"


def _one_list(role: str, depth: int) -> str:
    return f"SELECT id, title, CAST(row_number() OVER (ORDER BY {_best(role)}) AS INTEGER) AS rank FROM {{jobs}} WHERE removed_at IS NULL AND {_has(role)} ORDER BY rank LIMIT {depth}"


@query("ranked_role", "R-1 R-4", _one_list("bolt blue", 40))
def _ranked(t):
    return search.ranked(t.jobs.filter(F.col("removed_at").isNull()), "bolt blue", 40).select("id", "title", "rank")


@query("ranked_with_errors", "R-4", _one_list("econamy bolt", 60))
def _ranked_errors(t):
    return search.ranked(t.jobs.filter(F.col("removed_at").isNull()), "econamy bolt", 60).select("id", "title", "rank")


@query("multi_role_search", "S-3 R-2 W-2 W-13 W-14 H2", _interleaved(20, 0))
def _multi(t):
    return search.search(linked(t), SearchRequest(q=", ".join(ROLES), limit=20), as_of())[0]


@query("multi_role_second_page", "R-2 W-2 W-14", _interleaved(15, 15))
def _multi_second(t):
    return search.search(linked(t), SearchRequest(q=", ".join(ROLES), limit=15, page=2), as_of())[0]


@query(
    "multi_role_metadata",
    "R-2 R-6 P-3",
    "WITH s AS (SELECT CAST(" + " + ".join(f"least(count(*) FILTER (WHERE {_has(r)}), 10000)" for r in ROLES) + " AS BIGINT) AS total FROM {jobs} WHERE removed_at IS NULL) "
    "SELECT total, 2 AS page, CAST(ceil(total / 15.0) AS BIGINT) AS pages, total > 30 AS has_next, true AS has_prev, CASE WHEN total > 30 THEN 30 END AS next_offset, 0 AS prev_offset, false AS capped FROM s",
)
def _multi_total(t):
    return search.search(linked(t), SearchRequest(q=", ".join(ROLES), limit=15, page=2), as_of())[1]


@query(
    "over_budget_search",
    "R-3",
    f"""SELECT id, title, 0 AS role, place FROM (SELECT id, title, row_number() OVER (ORDER BY held DESC, len(string_split(title, ' ')) - held, first_seen_at DESC, id) - 1 AS place FROM (
  SELECT *, CASE {" ".join(f"WHEN {_has(' '.join('bolt widgat rod'.split()[:n]))} THEN {n}" for n in range(3, 0, -1))} ELSE 0 END AS held FROM {{jobs}} WHERE removed_at IS NULL) WHERE held > 0) WHERE place >= 1400 AND place < 1420""",
)
def _over_budget(t):
    """A page so deep that the lists of three roles would pass the budget: one loose list of all words."""
    return search.search(linked(t), SearchRequest(q="bolt, widgat, rod", limit=20, offset=1400), as_of())[0]


@query("search_without_text", "R-5 P-3", "SELECT id, title, 0 AS role, place FROM (SELECT id, title, row_number() OVER (ORDER BY first_seen_at DESC, id) - 1 AS place FROM {jobs} WHERE removed_at IS NULL AND experience_level = 'lead') WHERE place >= 50 AND place < 100")
def _no_text(t):
    return search.search(linked(t), SearchRequest(experience_level="lead", page=2), as_of())[0]


@query("widened_role", "R-1", _one_list("blue bolt", 20))
def _widened(t):
    hits, _ = search.widening(t.jobs.filter(F.col("removed_at").isNull()), "blue bolt unheard of", 20)
    return hits.select("id", "title", "rank")


@query("result_shape", "P-2 P-1", "SELECT id, CAST(salary_min_annual AS VARCHAR) AS salary_min, salary_currency AS currency, coalesce(is_remote, false) AS is_remote, company_name AS company, ats_slug AS slug, posted_at FROM {postings} JOIN {companies} USING (company_id)")
def _shape(t):
    rows = t.postings.join(t.companies, "company_id")
    salary, company = F.struct(F.col("salary_min_annual").cast("string").alias("min"), F.col("salary_currency").alias("currency")), F.struct(F.col("company_name").alias("name"), F.col("ats_slug").alias("slug"))
    shaped = rows.select("id", salary.alias("salary"), F.coalesce("is_remote", F.lit(False)).alias("is_remote"), company.alias("company"), "posted_at")
    return shaped.select("id", F.col("salary.min").alias("salary_min"), "salary.currency", "is_remote", F.col("company.name").alias("company"), "company.slug", "posted_at")


@query(
    "page_metadata",
    "P-3 R-6",
    "SELECT total, 3 AS page, CAST(ceil(total / 50.0) AS BIGINT) AS pages, total > 150 AS has_next, true AS has_prev, CASE WHEN total > 150 THEN 150 END AS next_offset, 50 AS prev_offset, capped FROM (SELECT least(count(*), 10000) AS total, count(*) >= 10000 AS capped FROM {postings} WHERE removed_at IS NULL)",
)
def _meta(t):
    rows = t.postings.filter(F.col("removed_at").isNull()).withColumn("title", F.lit(""))
    return search.page_metadata(search.total_of(rows, []), SearchRequest(page=3))


def stored_rows(t):
    """Postings with their companies and all that a search document holds."""
    k = F.col("id") % 4
    place = F.when(k == 0, "Austin, TX").when(k == 1, "Remote, DACH").when(k == 2, "Lyon, France")
    rows = t.postings.join(t.companies.withColumnRenamed("ats", "segment"), "company_id", "left").withColumnsRenamed({"role_category": "title", "segment": "department"})
    return rows.select(
        "*", place.alias("location"), F.lower("department").alias("ats"), F.concat(F.lit("https://x.org/"), "external_id").alias("url"), F.lit("").alias("domain"), F.lit(None).cast("string").alias("logo_url"),
        F.col("title").alias("role_category"), F.col("salary_min_annual").cast("string").alias("salary_min"), F.lit("n/a").alias("salary_max"), F.lit(None).cast("long").alias("salary_max_annual"), F.lit("yearly").alias("salary_interval"),
    )


DOCUMENTS = """SELECT id, external_id, title, ats AS department, CASE id % 4 WHEN 0 THEN 'Austin, TX' WHEN 1 THEN 'Remote, DACH' WHEN 2 THEN 'Lyon, France' END AS location,
  CASE id % 4 WHEN 0 THEN 'us' WHEN 1 THEN CASE WHEN is_remote THEN 'de,at,ch' ELSE '' END WHEN 2 THEN 'fr' ELSE '' END AS location_countries, CASE id % 4 WHEN 0 THEN 'austin,tx' WHEN 1 THEN 'remote,dach' WHEN 2 THEN 'lyon,france' ELSE '' END AS location_tokens,
  workplace_type, employment_type, experience_level, visa_sponsorship, title AS role_category, is_remote, remote_worldwide, lower(ats) AS ats, 'https://x.org/' || external_id AS url,
  CAST(salary_min_annual AS DOUBLE) AS salary_min, CAST(NULL AS DOUBLE) AS salary_max, CAST(salary_min_annual AS DOUBLE) AS salary_min_annual, CAST(NULL AS DOUBLE) AS salary_max_annual, salary_currency, 'yearly' AS salary_interval, posted_at,
  CAST(epoch(coalesce(posted_at, first_seen_at)) AS BIGINT) AS posted_ts, CAST(epoch(first_seen_at) AS BIGINT) AS first_seen_ts, company_id, company_name, CAST(NULL AS VARCHAR) AS company_domain, ats_slug AS company_ats_slug, CAST(NULL AS VARCHAR) AS company_logo_url
FROM (SELECT *, role_category AS title FROM {postings}) LEFT JOIN {companies} USING (company_id) WHERE removed_at IS NULL"""


LISTED = "id external_id company_id ats title department location workplace_type employment_type salary_min salary_max salary_currency salary_interval salary_min_annual salary_max_annual url posted_at first_seen_at is_remote remote_worldwide visa_sponsorship experience_level domain ats_slug company_name logo_url".split()


@query(
    "listed_rows",
    "P-1",
    """SELECT id, external_id, company_id, lower(ats) AS ats, role_category AS title, ats AS department, CASE id % 4 WHEN 0 THEN 'Austin, TX' WHEN 1 THEN 'Remote, DACH' WHEN 2 THEN 'Lyon, France' END AS location, workplace_type, employment_type,
CAST(salary_min_annual AS VARCHAR) AS salary_min, 'n/a' AS salary_max, salary_currency, 'yearly' AS salary_interval, salary_min_annual, CAST(NULL AS BIGINT) AS salary_max_annual, 'https://x.org/' || external_id AS url, posted_at, first_seen_at, is_remote, remote_worldwide, visa_sponsorship, experience_level,
'' AS domain, ats_slug, company_name, CAST(NULL AS VARCHAR) AS logo_url FROM {postings} JOIN {companies} USING (company_id) WHERE removed_at IS NULL AND experience_level = 'senior'""",
)
def _listed(t):
    """The 26 columns of a result row; the description is left out unless it is asked for."""
    return search.where(stored_rows(t), SearchRequest(experience_level="senior"), as_of()).select(*LISTED)


@query("search_documents", "P-4 J-3 O-1 D-4", DOCUMENTS)
def _documents(t):
    docs = documents.to_documents(stored_rows(t).filter(F.col("removed_at").isNull()))
    return docs.withColumns({"location_countries": F.array_join("location_countries", ","), "location_tokens": F.array_join("location_tokens", ",")})


ENRICHED = [
    # title, place, mode, type, salary, description; salary, currency, interval, mode, type, remote, level
    ("Senior Clerk", "Graz", None, None, None, "<p>Full-time. We pay $50,000 - $60,000. You work onsite.</p>", "50000", "USD", "yearly", "onsite", "Full-time", False, "senior"),
    ("Clerk", "Graz", "Hybrid", "Vollzeit", "10", "<b>Contract</b> role, $90,000 - $95,000, fully remote position", "10", None, None, "Hybrid", "Vollzeit", False, None),
    ("Junior Cook", None, "", "", "", "This is a remote position.", "", None, None, "remote", None, True, "entry"),
    ("Cook", "Remote", None, None, None, None, None, None, None, "remote", None, True, None),
]


@query(
    "enriched_postings",
    "P-6 C-1 C-9 M-1",
    "SELECT * FROM (VALUES " + ", ".join(f"({k}, " + ", ".join("NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"'{v}'" for v in c[6:]) + ")" for k, c in enumerate(ENRICHED)) + ") v(k, salary_min, salary_currency, salary_interval, workplace_type, employment_type, is_remote, experience_level)",
)
def _enriched(t):
    shape = "k int, title string, location string, workplace_type string, employment_type string, salary_min string, description string, salary_max string, salary_currency string, salary_interval string"
    rows = t.spark.createDataFrame([(k, *c[:6], None, None, None) for k, c in enumerate(ENRICHED)], shape)
    return documents.enriched(rows).select("k", "salary_min", "salary_currency", "salary_interval", "workplace_type", "employment_type", "is_remote", "experience_level")


@query(
    "written_postings",
    "P-5 M-4 C-13 C-14",
    """SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'Remote' WHEN 1 THEN 'Hybrid' END AS workplace_type, CASE o_orderkey % 4 WHEN 0 THEN 'Full-time' WHEN 1 THEN 'Part-time' WHEN 2 THEN 'Internship' END AS employment_type,
CASE o_orderkey % 2 WHEN 0 THEN 'Data Engineer' ELSE 'Other' END AS role_category, CASE WHEN o_orderkey % 5 = 0 THEN CAST(round(CAST(floor(o_totalprice / 1000) AS BIGINT) * 2080) AS BIGINT) ELSE CAST(floor(o_totalprice) AS BIGINT) END AS salary_min_annual FROM orders""",
)
def _written(t):
    k = F.col("o_orderkey")
    pick = lambda n, *said: F.element_at(F.lit(list(said)), (k % n + 1).cast("int"))
    hourly = k % 5 == 0
    rows = t.orders.select(
        k.alias("id"), pick(3, "WORK_FROM_HOME", "hybrid remote", "unspecified").alias("workplace_type"), pick(4, "FULL_TIME", "Permanent - Part Time", "Internship - Full Time", "other").alias("employment_type"),
        pick(2, "Senior Data Engineer", "Florist").alias("title"), F.when(hourly, F.floor(F.col("o_totalprice") / 1000)).otherwise(F.floor("o_totalprice")).cast("string").alias("salary_min"), F.lit(None).cast("string").alias("salary_max"), F.when(hourly, "per hour").otherwise("Annual").alias("salary_interval"),
    )
    return documents.as_stored(rows).select("id", "workplace_type", "employment_type", "role_category", "salary_min_annual")


@query("normal_sources", "P-7 U-11", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'taleo' WHEN 2 THEN lower(c_mktsegment) ELSE '' END AS ats FROM customer")
def _sources(t):
    said = F.when(F.col("c_custkey") % 4 == 0, " GrnHse ").when(F.col("c_custkey") % 4 == 1, "taleo_selectminds").when(F.col("c_custkey") % 4 == 2, F.col("c_mktsegment"))
    return t.customer.select("c_custkey", documents.normal_source(said).alias("ats"))


@query("index_employment", "C-15 T-12", "SELECT * FROM (VALUES (0, 'Internship'), (1, 'Full-time'), (2, 'Zeitarbeit'), (3, NULL), (4, 'Contract'), (5, 'Full-time')) v(k, type)")
def _index_employment(t):
    rows = [(0, "Marketing Intern", "full_time"), (1, "Internship Program Coordinator", "FULL TIME"), (2, "Cook", "Zeitarbeit"), (3, "Cook", ""), (4, "Cook", "freelance"), (5, "Intern revisor", "vollzeit")]
    return t.spark.createDataFrame(rows, "k int, title string, type string").select("k", documents.index_employment_type(F.col("title"), F.col("type")).alias("type"))


GOOD = '{"is_remote":true,"remote_worldwide":false,"visa_sponsorship":"unknown","experience_level":"lead"}'
ANSWERS = [
    (GOOD, True, False, None, "lead"),
    ("```json\n" + GOOD.replace("unknown", "yes") + "\n```", True, False, "yes", "lead"),
    (GOOD.replace("true", '"true"'), None, None, None, None),
    (GOOD.replace("lead", "chief"), None, None, None, None),
    (GOOD.replace("unknown", "maybe"), None, None, None, None),
    ("no json", None, None, None, None),
    (None, None, None, None, None),
]


@query("model_answers", "C-16", "SELECT * FROM (VALUES " + ", ".join(f"({k}, " + ", ".join("NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"'{v}'" for v in a[1:]) + ")" for k, a in enumerate(ANSWERS)) + ") v(k, is_remote, remote_worldwide, visa_sponsorship, experience_level)")
def _answers(t):
    rows = t.spark.createDataFrame([(k, a[0]) for k, a in enumerate(ANSWERS)], "k int, content string")
    return rows.select("k", documents.parsed_answer(F.col("content")).alias("a")).select("k", "a.*")


@query(
    "merged_answers",
    "C-17",
    """SELECT id, CASE WHEN id % 3 = 0 THEN coalesce(visa_sponsorship, 'unknown') ELSE visa_sponsorship END AS visa_sponsorship, CASE WHEN id % 3 = 0 THEN 'lead' ELSE experience_level END AS experience_level,
CASE WHEN id % 3 = 0 AND workplace_type IS NULL THEN true ELSE is_remote END AS is_remote, CASE WHEN id % 3 = 0 AND workplace_type IS NULL THEN false ELSE remote_worldwide END AS remote_worldwide FROM {postings}""",
)
def _merged_answers(t):
    """Every third posting has a valid answer, and every third an invalid one."""
    answers = t.postings.filter("id % 3 < 2").select("id", F.when(F.col("id") % 3 == 0, GOOD).otherwise("{}").alias("content"))
    return documents.with_answers(t.postings, answers).select("id", "visa_sponsorship", "experience_level", "is_remote", "remote_worldwide")


@query("retagged_hybrids", "C-18", "SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'Remote' WHEN 4 THEN 'Onsite' ELSE 'Hybrid' END AS workplace_now FROM orders")
def _retagged(t):
    """Stored hybrids: two that the text takes back, one that it bears out, one that it says nothing of, and one with office days."""
    text = F.element_at(F.lit(["Work with hybrid cloud. This is a remote position.", "This role is hybrid.", "Bake bread.", "Mon, Tue in office.", "Hybrid cars; you work onsite."]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.lit("Engineer").alias("title"), F.lit("Graz").alias("location"), text.alias("description"), F.lit("Hybrid").alias("workplace_type"))
    return documents.retagged(rows).select("id", "workplace_now")


@query("stored_tokens", "K-18", "SELECT p_partkey, array_to_string(list_sort(list_distinct(string_split(lower(p_name || ' ' || p_type), ' '))), ' ') AS tokens FROM part")
def _stored_tokens(t):
    return t.part.select("p_partkey", F.array_join(documents.search_tokens(F.col("p_name"), F.lit(None).cast("string"), F.col("p_type")), " ").alias("tokens"))


@query("lateral_column", "P-10", "SELECT p_partkey, regexp_replace(p_brand, '[^0-9]', '', 'g') AS brand_no FROM part")
def _lateral(t):
    return t.part.withColumn("brand_no", F.regexp_replace("p_brand", "[^0-9]", "")).select("p_partkey", "brand_no")
