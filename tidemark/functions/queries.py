"""Named queries over the scalar functions. Literal rows cover what the synthetic prose never says."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query
from . import geo, labels, text
from .dates import epoch


def values(spark, rows: list[tuple], names: list[str]):
    """A small literal table, without Python in its plan."""
    cells = [F.struct(*(F.lit(v).cast("string").alias(n) if not isinstance(v, int) or v is None else F.lit(v).cast("long").alias(n) for v, n in zip(r, names, strict=True))) for r in rows]
    return spark.range(1).select(F.explode(F.array(*cells)).alias("v")).select("v.*")


@query(
    "strip_html",
    "T-1 T-2 T-3",
    r"""SELECT doc_id, md5(regexp_replace(regexp_replace('Head' || chr(10) || chr(10) || coalesce(text, '') || chr(10) || chr(10) || '• one' || chr(10) || '• two "x"', '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS plain FROM documents""",
)
def _strip(t):
    """Every whole text as the escaped paragraph of a page, between a heading and a list."""
    body = F.replace(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    page = F.concat(F.lit("<div><h2 class='x'>Head</h2><p>"), body, F.lit("</p><ul><li>one</li><li>two &quot;x&quot;</li></ul></div>"))
    return t.documents.select("doc_id", F.md5(text.strip_html(page)).alias("plain"))


@query("strip_html_cases", "T-1", "SELECT * FROM (VALUES (1, 'a\nb'), (2, '• x\n• y'), (3, 'A\n\nB & C'), (4, 'q \"z\"')) v(k, plain)")
def _strip_cases(t):
    rows = [(1, "a<br/>b"), (2, "<ul><li>x</li><li>y</li></ul>"), (3, "<h2>A</h2><p>B &amp; C</p>"), (4, "<b>q</b> &quot;z&quot;")]
    return values(t.spark, rows, ["k", "html"]).select(F.col("k").cast("int").alias("k"), text.strip_html(F.col("html")).alias("plain"))


@query(
    "folded_names",
    "T-4",
    r"""SELECT doc_id, md5(trim(regexp_replace(strip_accents(replace(replace(replace(replace(lower(coalesce(text, '') || ' Straße Łódź Øre Œuvre'), 'ß', 'ss'), 'ł', 'l'), 'ø', 'o'), 'œ', 'oe')), '\s+', ' ', 'g'))) AS folded FROM documents""",
)
def _folded(t):
    return t.documents.select("doc_id", F.md5(geo.norm_udf(F.concat(F.coalesce("text", F.lit("")), F.lit(" Straße Łódź Øre Œuvre")))).alias("folded"))


REGION_NAMES = [("  The “Bay Area” ", "the bay area"), ("Asia/Pacific", "asia pacific"), ("L'Aquila", "l'aquila"), ("São Tomé & Príncipe", "sao tome principe"), ("U.S.", "us"), ("Côte d’Ivoire", "cote d'ivoire")]


@query("plain_names", "T-5", "SELECT * FROM (VALUES " + ", ".join(f"({k}, '{w.replace(chr(39), chr(39) * 2)}')" for k, (_, w) in enumerate(REGION_NAMES)) + ") v(k, plain)")
def _plain(t):
    from . import places

    return values(t.spark, [(k, x) for k, (x, _) in enumerate(REGION_NAMES)], ["k", "name"]).select(F.col("k").cast("int").alias("k"), geo.per_value(places.plain, "string")(F.col("name")).alias("plain"))


@query("key_makers", "T-6 T-7", "SELECT p_partkey, trim(regexp_replace(lower(p_name || '--' || p_brand), '[^a-z0-9]+', ' ', 'g')) AS title_key, regexp_replace(regexp_replace(lower(trim(p_brand)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def _keys(t):
    return t.part.select("p_partkey", text.title_key(F.concat_ws("--", "p_name", "p_brand")).alias("title_key"), text.slug_of(F.col("p_brand")).alias("slug"))


@query("demand_key", "T-8 K-8", "SELECT lower(trim(event_type)) || '|' || CAST(user_id AS VARCHAR) || '||' AS k, count(*) AS n FROM events GROUP BY 1")
def _demand_key(t):
    none = F.lit(None).cast("string")
    return t.events.groupBy(text.demand_key(F.col("event_type"), F.col("user_id").cast("string"), none, none).alias("k")).agg(F.count("*").alias("n"))


@query("real_description", "T-10", "SELECT doc_id, length(trim(text)) >= 300 AND NOT regexp_matches(trim(text), '(\\.\\.\\.|…)$') AND NOT regexp_matches(trim(text), '%[A-Z_]{3,}%') AND (length(trim(text)) >= 800 OR regexp_matches(trim(text), '[.!?:)\"''”]$')) AS real FROM documents")
def _real(t):
    return t.documents.select("doc_id", text.real_description(F.col("text")).alias("real"))


@query("query_words", "T-13 T-14", "SELECT p_partkey, array_to_string(list_filter(string_split_regex(regexp_replace(p_name || ' #' || p_brand, '[^\\p{L}\\p{N}_-]', ' ', 'g'), '\\s+'), lambda x: x <> ''), ' ') AS words FROM part")
def _query_words(t):
    return t.part.select("p_partkey", F.array_join(text.query_words(F.concat("p_name", F.lit(" #"), "p_brand")), " ").alias("words"))


TITLES = [(1, "Senior Software Engineer"), (2, "Front-End wizard"), (3, "Data Analyst, risk"), (4, "Machine Learning lead"), (5, "Account Executive"), (6, "HR partner"), (7, "Gardener"), (8, None), (9, "Cloud Security"), (10, "iOS developer")]


@query("role_category", "C-6", "SELECT * FROM (VALUES (1, 'Software Engineer'), (2, 'Frontend Developer'), (3, 'Data Analyst'), (4, 'ML / AI Engineer'), (5, 'Sales'), (6, 'Human Resources'), (7, 'Other'), (8, 'Other'), (9, 'Security Engineer'), (10, 'Mobile Developer')) v(k, role)")
def _roles(t):
    return values(t.spark, TITLES, ["k", "title"]).select(F.col("k").cast("int").alias("k"), labels.role_category(F.col("title")).alias("role"))


@query("employment_type", "C-13 F-9", "SELECT * FROM (VALUES (1, 'Full-time'), (2, 'Internship'), (3, 'Part-time'), (4, 'Full-time'), (5, 'Temporary'), (6, 'Contract'), (7, NULL), (8, 'Part-time')) v(k, kind)")
def _employment(t):
    rows = [(1, "FULL_TIME"), (2, "Internship - Full Time"), (3, "Permanent - Part Time"), (4, "Temps plein"), (5, "PRN"), (6, "B2B"), (7, "whatever"), (8, "Teilzeit")]
    return values(t.spark, rows, ["k", "raw"]).select(F.col("k").cast("int").alias("k"), labels.employment_type(F.col("raw")).alias("kind"))


@query("employment_in_text", "C-12", "SELECT * FROM (VALUES (1, 'Full-time'), (2, 'Contract'), (3, 'Internship'), (4, NULL)) v(k, kind)")
def _in_text(t):
    rows = [(1, "Nurse", "This is a full time post"), (2, "Writer", "freelance"), (3, "Summer intern", ""), (4, "Cook", "kitchen")]
    return values(t.spark, rows, ["k", "title", "description"]).select(F.col("k").cast("int").alias("k"), labels.employment_in_text(F.col("title"), F.col("description")).alias("kind"))


@query("workplace_type", "C-14 F-7", "SELECT * FROM (VALUES (1, 'Hybrid'), (2, 'Remote'), (3, 'Onsite'), (4, NULL), (5, 'Onsite'), (6, 'Remote')) v(k, kind)")
def _workplace(t):
    rows = [(1, "hybrid remote"), (2, "WFH"), (3, "on_site"), (4, "unspecified"), (5, "In-Office"), (6, "télétravail / remote")]
    return values(t.spark, rows, ["k", "raw"]).select(F.col("k").cast("int").alias("k"), labels.workplace_type(F.col("raw")).alias("kind"))


@query("salary_interval", "M-3 D12", "SELECT * FROM (VALUES (1, 'hourly'), (2, 'yearly'), (3, 'biweekly'), (4, 'semimonthly'), (5, 'monthly'), (6, NULL), (7, 'yearly')) v(k, kind)")
def _interval(t):
    rows = [(1, "per-hour"), (2, "per-year-salary"), (3, "Bi-Weekly"), (4, "semi-monthly"), (5, "mo"), (6, "whenever"), (7, "hourly salary")]
    return values(t.spark, rows, ["k", "raw"]).select(F.col("k").cast("int").alias("k"), labels.salary_interval(F.col("raw")).alias("kind"))


@query("annual_salary", "M-4 M-5", "SELECT o_orderkey AS id, CASE WHEN o_totalprice > 0 AND o_totalprice <= (CASE o_orderkey % 3 WHEN 0 THEN 10000000 WHEN 1 THEN 125000 ELSE 25000 END) THEN CAST(round(o_totalprice * (CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 12 ELSE 52 END)) AS BIGINT) END AS annual FROM orders")
def _annual(t):
    kind = F.element_at(F.lit(["yearly", "monthly", "weekly"]), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return t.orders.select(F.col("o_orderkey").alias("id"), labels.annual_salary(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), kind).alias("annual"))


@query("epochs", "D-2 D-4", "SELECT id, CAST(epoch(coalesce(posted_at, first_seen_at)) AS BIGINT) AS posted_ts FROM {postings}")
def _epochs(t):
    return t.postings.select("id", epoch(F.coalesce("posted_at", "first_seen_at")).alias("posted_ts"))


@query("interval_arithmetic", "D-3 D-5", "SELECT id, posted_at - INTERVAL 1 MONTH AS month_before, coalesce(posted_at < {as_of} - INTERVAL 180 DAY, false) AS old FROM {postings}")
def _intervals(t):
    return t.postings.select("id", (F.col("posted_at") - F.expr("INTERVAL 1 MONTH")).alias("month_before"), F.coalesce(F.expr("posted_at < TIMESTAMP_NTZ '2001-08-02 00:00:00' - INTERVAL 180 DAY"), F.lit(False)).alias("old"))


# Locations by the codes that they read as.
READINGS = {
    "us": ["Austin, TX", "Salamanca, NY", "Spokane, WA", "Miami, FL", "Portland, OR", "Nashville, TN", "Washington, D.C.", "St. Louis, MO", "Remote, TX", "San Francisco, CA", "Indianapolis, IN", "Richmond, VA", "Denver, CO", "Atlanta, GA", "Wilmington, DE", "Newark, DE", "Boise, ID", "Chicago, IL", "Boston, MA", "Baltimore, MD", "Charlotte, NC", "Little Rock, AR", "Bozeman, MT", "Dover, DE", "Buffalo, New York", "Concord, California", "New Braunfels, Texas", "RICHMOND, Virginia", "Seattle, Washington", "Remote - Texas", "Texas", "Niagara Falls, New York, United States", "Austin, Texas, 78701", "Albuquerque, New Mexico", "Newark, New Jersey", "Jersey City, NJ", "Jersey City, NJ, US", "Atlanta, Georgia", "Lebanon, Tennessee", "Peru, Indiana", "Mexico, Missouri, USA", "Georgia, United States", "Austin, TX, USA - AUS", "US-CA-Ontario", "US-WA-Seattle", "USA-VA-Herndon", "US-MA-Boston; US-NY-New York", "HQ - San Diego, CA", "HQ - Indianapolis, IN", "Support Center - Irving, TX", "Main - Wilmington, DE", "Arcadia, FL, Auburn, AL, Edwardsville, KS, Gloversville, NY, Lyons, IL, Menasha, WI, Millcreek, UT, Puyallup, WA", "Arcadia, FL, Auburn, AL", "Austin, TX, Denver, CO", "Austin, TX, Dallas, TX", "Austin, TX, Denver, CO, USA", "TX - Dallas, NM - Albuquerque, VA - Norfolk, IN - Indianapolis, MI - Hazel Park, IN - Hammond, OH - Cleveland, TN, NY", "CA - San Diego, CO - Denver", "Urbandale, Douglas Ave, Urbandale, IA", "123 Main St, Urbandale, IA", "Austin, Congress Ave, Austin, TX", "Urbandale, Douglas Ave, Urbandale, IA 50322", "Urbandale, IA 50322", "Streeterville, Chicago, IL", "City Office Escondido, Escondido, CA", "Nashville Clinic, Nashville, TN", "Morgan Hill, CA", "4660 La Jolla Village Dr #100, San Diego, CA", "US - Austin, TX", "Holland, MI", "Nederland, TX, US, 77627", "Davie Medical Center - 329 NC Highway 801 N, Bermuda Run, NC", "Remote - U.S."],
    "ca": ["Montreal, CA", "Montréal, CA", "CAN-ON-Toronto", "CA-ON-Toronto", "Downtown - Toronto, CA", "Toronto, ON, CA", "Toronto, ON, CAN", "Ottawa, ON", "Toronto ON", "Montreal, QC", "Vancouver, BC", "Regina, SK", "St. John's, NL", "Brampton, Ontario, CA", "Toronto, San Francisco, CA"],
    "in": ["Pune, IN", "Bengaluru, IN", "Chennai, TN", "India - Pune, IN", "Gurugram, HR, IND", "Bengaluru, Karnataka, IN", "Pune, in", "Mumbai (Andheri East), IN"],
    "au": ["Perth, WA", "Sydney - AUS", "Melbourne, VIC, AUS", "AUS - NSW - MACQUARIE PARK", "Newcastle, NSW", "Sydney NSW", "Melbourne VIC 3000", "Darwin, NT", "Adelaide, SA", "Sydney, New South Wales, Australia", "North Sydney, New South Wales"],
    "co": ["Bogota, CO"],
    "ar": ["Buenos Aires, AR", "CABA, CABA, AR"],
    "id": ["Jakarta, ID"],
    "mt": ["Sliema, MT"],
    "il": ["Tel Aviv, IL", "Tel Aviv-Yafo, Tel Aviv District, IL"],
    "de": ["Berlin, DE", "München, DE", "Mehrere Standorte, DE", "Boeblingen, DEU / Munich, BY, DEU", "Berlin, Berlin, DE", "Berlin, de"],
    "ge": ["Tbilisi, Georgia"],
    "ge,us": ["Georgia"],
    "bg": ["Montana, Bulgaria"],
    "ee": ["Tallinn, EST"],
    "": ["Remote - EST", "US-XX-Foo", "Client Site - IND - Che - PDS", "Nowhere", "", "Indianapolis"],
    "ca,us": ["US-NY-New York; Toronto, ON, CAN", "CA-AB-Sherwood Park | US-CT-Danbury", "Toronto, ON, CAN; Chicago, IL, USA", "Toronto, Canada; Streeterville, Chicago, IL"],
    "fr": ["Paris - La Defense, FR", "Paris, Rue de Rivoli, Paris, FR"],
    "gb": ["London - Canary Wharf, GB", "London, England, GB, GB", "Cardiff, Wales", "Wales, UK", "Belfast, Northern Ireland, United Kingdom"],
    "de,fr": ["Paris, France, Berlin, Germany"],
    "tn": ["Chennai, Anna Salai, Chennai, TN"],
    "br": ["Sao Paulo, SP, BRA"],
    "ie": ["Dublin, IRL", "Dublin, Ireland"],
    "cn": ["Huangpu, Shanghai - CHN", "Zhangjiang, ARE-SH, CHN", "Beijing, People's Republic of China"],
    "it": ["ITA-Milan-Piazza Armando Diaz 2"],
    "za": ["ZAF - Gauteng - Isando"],
    "be,gb": ["Birmingham, GBR / Ghent, BE, BEL"],
    "vn": ["Can Tho, Vietnam"],
    "sa": ["Riyadh, SA"],
    "sk": ["Bratislava, SK"],
    "pg": ["Port Moresby, Papua New Guinea"],
    "gq": ["Malabo, Equatorial Guinea"],
    "gw": ["Bissau, Guinea-Bissau"],
    "gn": ["Conakry, Guinea"],
    "ss": ["Juba, South Sudan"],
    "sd": ["Khartoum, Sudan"],
    "cd": ["Kinshasa, Democratic Republic of the Congo"],
    "cg": ["Brazzaville, Republic of the Congo"],
    "tt": ["Port of Spain, Trinidad and Tobago"],
    "au,gb": ["United Kingdom - Remote, Sydney, New South Wales"],
    "ma": ["Casablanca, CasaNearshore, MA"],
    "in,pe": ["Lima, Peru, IN"],
    "fr,gb": ["London, UK; Paris, France"],
    "gb,us": ["London, United Kingdom / Austin, Texas"],
    "ng": ["Lagos, Nigeria"],
    "uy": ["Florida, Uruguay"],
    "mx": ["Austin, TX, Mexico City, Mexico"],
}
READ = [(k, text, codes) for k, (codes, text) in enumerate((codes, x) for codes, texts in READINGS.items() for x in texts)]


@query("country_reading", "G-1 G-2 G-3 G-5 G-13", "SELECT * FROM (VALUES " + ", ".join(f"({k}, '{codes}')" for k, _, codes in READ) + ") v(k, codes)")
def _countries(t):
    return values(t.spark, [(k, x) for k, x, _ in READ], ["k", "location"]).select(F.col("k").cast("int").alias("k"), F.array_join(geo.countries_udf(F.col("location")), ",").alias("codes"))


# Names and ISO codes of nations, by the keys of the input table.
NAMED = "Algeria,Argentina,Brazil,Canada,Egypt,Ethiopia,France,Germany,India,Indonesia,Iran,Iraq,Japan,Jordan,Kenya,Morocco,Mozambique,Peru,China,Romania,Saudi Arabia,Vietnam,Russia,United Kingdom,United States".split(",")
NATIONS = "dz ar br ca eg et fr de in id ir iq jp jo ke ma mz pe cn ro sa vn ru gb us".split()


@query(
    "customer_countries",
    "G-1 G-2 G-5",
    f"""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN code WHEN 1 THEN least(code, 'us') || CASE WHEN code = 'us' THEN '' ELSE ',' || greatest(code, 'us') END ELSE 'au' END AS codes
FROM (SELECT c_custkey, [{", ".join(f"'{c}'" for c in NATIONS)}][c_nationkey + 1] AS code FROM customer)""",
)
def _customer_countries(t):
    """Every customer's segment as a town, of their nation, or of it and a town in Texas, or of New South Wales."""
    rows, town, nation = t.customer, F.initcap("c_mktsegment"), F.element_at(F.lit(NAMED), F.col("c_nationkey") + 1)
    text = F.when(F.col("c_custkey") % 3 == 0, F.concat(town, F.lit(", "), nation)).when(F.col("c_custkey") % 3 == 1, F.concat(town, F.lit(", "), nation, F.lit("; Austin, TX"))).otherwise(F.concat(town, F.lit(", NSW")))
    return rows.select("c_custkey", F.array_join(geo.countries_udf(text), ",").alias("codes"))


PLACES = [
    (1, "Greater Munich Area", "greater munich area|munich|munchen|muenchen"),
    (2, "Saint-Denis", "saint-denis|saint denis|st denis"),
    (3, "GTA", "gta|toronto|mississauga|brampton|markham|vaughan|oakville|richmond hill"),
    (4, "Northern Area", "northern area"),
    (5, "Ft. Worth", "ft. worth|fort worth"),
    (6, "München", "munchen|munich|muenchen"),
]


@query("place_spellings", "G-6 G-7 G-10 G-11", "SELECT * FROM (VALUES " + ", ".join(f"({k}, '{w}')" for k, _, w in PLACES) + ") v(k, spellings)")
def _spellings(t):
    return values(t.spark, [(k, "|".join(geo.place_spellings(x))) for k, x, _ in PLACES], ["k", "spellings"]).select(F.col("k").cast("int").alias("k"), "spellings")


@query("location_tokens", "G-4", "SELECT * FROM (VALUES (1, 'new york|new|york|ny'), (2, 'sao paulo|sao|paulo|brazil'), (3, 'munchen bayern|munchen|bayern|munich|muenchen|bavaria'), (4, 'one|two|three|four|five'), (5, '')) v(k, tokens)")
def _tokens(t):
    return values(t.spark, [(1, "New York, NY"), (2, "São Paulo / Brazil"), (3, "München Bayern"), (4, "One Two Three Four Five"), (5, None)], ["k", "location"]).select(F.col("k").cast("int").alias("k"), F.array_join(geo.tokens_udf("location"), "|").alias("tokens"))


EUROPEAN = "at,be,bg,hr,cy,cz,dk,ee,fi,fr,de,gr,hu,ie,it,lv,lt,lu,mt,nl,pl,pt,ro,sk,si,es,se,gb,no,ch,is"


@query("remote_regions", "G-9", f"SELECT n_name, CASE r_name WHEN 'EUROPE' THEN '{EUROPEAN}' WHEN 'ASIA' THEN 'de,at,ch,ee,lv,lt' WHEN 'AFRICA' THEN 'se,no,dk,fi,is' ELSE '' END AS codes FROM nation JOIN region ON n_regionkey = r_regionkey")
def _regions(t):
    said = F.when(F.col("r_name") == "EUROPE", "Remote, Europe").when(F.col("r_name") == "ASIA", "Remote - DACH or Baltics").when(F.col("r_name") == "AFRICA", "nordic, Scandinavia").otherwise("Remote, Neuropea")
    return t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", F.array_join(geo.remote_region_countries(said), ",").alias("codes"))


@query("region_codes", "G-8 F-18", "SELECT * FROM (VALUES ('UK and Ireland', 'gb,ie'), ('ANZ', 'au,nz'), ('gcc', 'ae,sa,qa,kw,bh,om'), ('Narnia', ''), ('Deutschland', 'de')) v(term, codes)")
def _region_codes(t):
    return values(t.spark, [(x, ",".join(geo.country_codes(x))) for x in ("UK and Ireland", "ANZ", "gcc", "Narnia", "Deutschland")], ["term", "codes"])


@query("rows_to_read_anew", "G-14", "SELECT c_custkey, c_custkey % 4 IN (0, 1) OR c_custkey % 4 = 2 AND c_custkey % 8 = 2 AS anew FROM customer")
def _anew(t):
    """Addresses with a dash head, a state at the end, a town and a country unread or read, and one word."""
    k = F.col("c_custkey") % 4
    place = F.when(k == 0, "US-WA-Seattle").when(k == 1, "Kalispell, MT 59901").when(k == 2, "Lyon, Frankreich").otherwise("Lyon")
    known = F.when(F.col("c_custkey") % 8 == 2, F.array().cast("array<string>")).otherwise(F.lit(["fr"]))
    return t.customer.select("c_custkey", geo.reads_anew(place, known).alias("anew"))


@query("posting_keys", "U-1 U-2 S-24", "SELECT * FROM (VALUES (1, 'greenhouse_123', 'acme'), (2, 'workable_AB12', 'acme'), (3, 'smartrecruiters_123456', 'acme'), (4, NULL, NULL), (5, 'bamboohr_77', 'acme'), (6, NULL, NULL)) v(k, external_id, board)")
def _posting_keys(t):
    rows = [(1, "greenhouse", "https://boards.greenhouse.io/Acme/jobs/123?x=1"), (2, "workable", "https://apply.workable.com/acme/j/AB12/"), (3, "smartrecruiters", "https://jobs.smartrecruiters.com/Acme/123456-cook"), (4, "lever", "https://example.org/acme"), (5, "bamboohr", "https://acme.bamboohr.com/careers/77"), (6, "greenhouse", "not a url")]
    key = text.posting_key(F.col("ats"), F.col("url"))
    return values(t.spark, rows, ["k", "ats", "url"]).select(F.col("k").cast("int").alias("k"), key["external_id"].alias("external_id"), key["board"].alias("board"))


@query("url_parts", "U-5 U-8 U-9", "SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+(/[^?#]*)', 1) AS path FROM pages")
def _url_parts(t):
    return t.pages.select("page_id", F.lower(text.url_part(F.col("url"), "HOST")).alias("host"), F.coalesce(text.url_part(F.col("url"), "PATH"), F.lit("")).alias("path"))


GUARDED = [("https://x.org/a", True), ("http://x.org", False), ("https://10.0.0.1/x", False), ("https://127.1/", False), ("https://0x7f.1/", False), ("https://2130706433/", False), ("https://localhost/", False), ("https://db.internal/x", False), ("https://a.LOCAL/", False), ("https://[::1]/", False), ("https://host/", False), ("https://1.example.org", True), ("ftp://x.org", False), ("", False), (None, False)]


@query("guarded_links", "U-10", "SELECT * FROM (VALUES " + ", ".join(f"({k}, {str(w).lower()})" for k, (_, w) in enumerate(GUARDED)) + ") v(k, public)")
def _guarded(t):
    return values(t.spark, [(k, x) for k, (x, _) in enumerate(GUARDED)], ["k", "url"]).select(F.col("k").cast("int").alias("k"), text.public_https(F.col("url")).alias("public"))


@query(
    "public_links",
    "U-10",
    "SELECT page_id, CASE page_id % 4 WHEN 0 THEN starts_with(url, 'https://') ELSE page_id % 4 = 3 END AS public FROM pages",
)
def _public(t):
    """Every link as it is, to an address, to a local name, and to a name by https."""
    k = F.col("page_id") % 4
    link = F.when(k == 0, F.col("url")).when(k == 1, F.regexp_replace("url", "^https?://[^/?#]+", "https://192.168.0.9")).when(k == 2, F.regexp_replace("url", "^https?://[^/?#]+", "https://box.local")).otherwise(F.regexp_replace("url", "^http://", "https://"))
    return t.pages.select("page_id", text.public_https(link).alias("public"))


@query("response_verdicts", "S-26 S-27 S-28 U-14", "SELECT * FROM (VALUES (1, 'alive'), (2, 'dead'), (3, 'unknown'), (4, 'dead'), (5, 'unknown'), (6, 'dead')) v(k, verdict)")
def _verdicts(t):
    rows = [(1, 200, "https://x.org/jobs/1", "Apply now"), (2, 404, "https://x.org/jobs/1", ""), (3, 200, "https://x.org/jobs/1", "Are you a robot? job not found"), (4, 200, "https://x.org/jobs/1", "This posting has expired"), (5, 503, "https://x.org/jobs/1", ""), (6, 200, "https://x.org/careers", "Welcome")]
    v = values(t.spark, rows, ["k", "status", "final_url", "body"])
    return v.select(F.col("k").cast("int").alias("k"), text.verdict(F.col("status"), F.col("final_url"), F.col("body")).alias("verdict"))


@query("page_liveness", "S-27", "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'alive' WHEN 1 THEN 'dead' WHEN 2 THEN 'unknown' WHEN 3 THEN 'dead' ELSE 'dead' END AS verdict FROM pages")
def _liveness(t):
    """Every page as it is, with a closing line, blocked, gone, and sent on to the list of jobs."""
    k = F.col("page_id") % 5
    body = F.concat(text.strip_html(F.col("html")), F.when(k == 1, " This position has been filled.").when(k == 2, " Are you a robot?").otherwise(""))
    status, final = F.when(k == 3, 410).otherwise(200), F.when(k == 4, "https://x.org/jobs").otherwise("https://x.org/jobs/1")
    return t.pages.select("page_id", text.verdict(status, final, body).alias("verdict"))


INTERN_TITLES = [
    ("Software Intern", True),
    ("Intern kommunikation", False),
    ("Internship, sales", True),
    ("Internal audit", False),
    ("Intern revisor till Stockholm", False),
    ("Gruppchef Intern Logistik", False),
    ("Chaufför med intern körning", False),
    ("Marketing Intern - Design", True),
    ("Intern med fokus på data", True),
    ("Projektledare, intern IT och support", False),
    ("Intern Transportation Planner", True),
    ("Interne medewerker", False),
]


@query("intern_titles", "F-10 T-12", f"SELECT * FROM (VALUES {', '.join(f'({k}, {str(v).lower()})' for k, (_, v) in enumerate(INTERN_TITLES))}) v(k, intern)")
def _intern(t):
    from .classify import without_nordic_intern

    rows = values(t.spark, [(k, x) for k, (x, _) in enumerate(INTERN_TITLES)], ["k", "title"])
    return rows.select(F.col("k").cast("int").alias("k"), without_nordic_intern(F.col("title")).rlike(labels.js_regex(r"\bintern(ship)?s?\b")).alias("intern"))


@query("nordic_part_names", "T-12", "SELECT p_partkey, NOT regexp_matches(p_name, '^(green|blue|dim)') AS intern FROM part")
def _nordic_parts(t):
    """Every part's name as a title behind 'intern': three colours stand for Nordic nouns."""
    from .classify import without_nordic_intern

    noun = F.regexp_replace(F.regexp_replace(F.regexp_replace("p_name", "^green", "kontroll"), "^blue", "blå"), "^dim", "logistik")
    title = without_nordic_intern(F.concat(F.lit("Intern "), noun))
    return t.part.select("p_partkey", title.rlike(labels.js_regex(r"\bintern\b")).alias("intern"))


CASES = [
    (1, "Senior Data Engineer (Remote)", "Berlin", None, "Visa sponsorship is available."),
    (2, "Account Executive", "Remote - US", None, "No visa sponsorship"),
    (3, "Nurse", "Austin, TX", None, "This is a hybrid role, 2 days per week in the office"),
    (4, "Director of Sales", "Worldwide", "remote", ""),
    (5, "Summer Intern", "London", "onsite", "fully remote"),
    (6, "Remote Sensing Analyst", "Denver", None, "Our team works on site."),
    (7, "Writer", "", None, "Work from anywhere in the world."),
]


@query(
    "classified_cases",
    "C-1 C-2 C-3 C-4 C-5 C-7",
    "SELECT * FROM (VALUES (1, true, false, 'yes', 'senior'), (2, true, false, 'no', 'mid'), (3, false, false, NULL, NULL), (4, true, true, NULL, 'executive'), (5, false, false, NULL, 'internship'), (6, false, false, NULL, NULL), (7, true, true, NULL, NULL)) v(k, is_remote, remote_worldwide, visa_sponsorship, experience_level)",
)
def _classified(t):
    from .classify import classify

    rows = values(t.spark, CASES, ["k", "title", "location", "workplace", "description"])
    return rows.select(F.col("k").cast("int").alias("k"), classify(*(F.col(c) for c in ("title", "location", "workplace", "description"))).alias("c")).select("k", "c.*")


# Title, place, text; the work mode by text, the mode by a text that came later, remote, worldwide.
MODE_CASES = [
    ("Engineer", "Remote, United States", "Schemes such as ML-DSA or hybrid crypto schemes", "remote", "remote", True, False),
    ("Architect", "Austin, TX", "Designing hybrid cloud and multi-cloud architectures.", None, None, False, False),
    ("Analyst - Hybrid", "Leeds", "", "hybrid", "hybrid", False, False),
    ("Analyst", "Denver, CO", "This is a hybrid role, two days at the desk.", "hybrid", "hybrid", False, False),
    ("Analyst", "Denver, CO", "Work Model: Hybrid. Good pay.", "hybrid", "hybrid", False, False),
    ("Analyst", "Denver, CO", "We are hybrid, two days per week.", "hybrid", "hybrid", False, False),
    ("Analyst", "Denver, CO", "Ask whether this is a remote position.", None, None, False, False),
    ("Analyst", "Denver, CO", "Pay may differ if this is a remote role.", None, None, False, False),
    ("Analyst", "Denver, CO", "This is a remote position. Pay may differ if it is a remote role.", "remote", "remote", True, False),
    ("Analyst", "Denver, CO", "Benefits: four weeks of work from anywhere each year.", None, None, False, False),
    ("Analyst", "Denver, CO", "We have a work from anywhere policy.", None, None, False, False),
    ("Analyst", "Denver, CO", "Our team can work from anywhere.", "remote", "remote", True, False),
    ("Lead", None, "Work from anywhere in the world.", "remote", "remote", True, True),
    ("Lead", None, "Work from anywhere in the US", "remote", "remote", True, False),
    ("Lead", "Worldwide", "Our notes are kept in Git, a wiki, or hybrid", "remote", "remote", True, True),
    ("Warehouse Lead", "Worldwide", "", "remote", "remote", True, False),
    ("Lead", "Worldwide", "In-person position at first.", "remote", "remote", True, False),
    ("Driver", "Remote", "", "remote", "remote", True, False),
    ("Analyst in Boston", "Anywhere", "", "remote", "remote", True, False),
    ("Analyst", "Iselin, NJ", "Start here. Go anywhere. This is our promise.", None, None, False, False),
    ("Remote Sensing Analyst", "Denver, CO", "Methods of remote sensing.", None, None, False, False),
    ("Analyst", "Denver, CO", "The job is performed remotely with remote access to files.", "remote", None, False, False),
    ("Analyst", "Denver, CO", "Remote Position: No", None, None, False, False),
    ("Analyst", "Denver, CO", "Mon, Tue, Wed in office, Friday WFH option.", "hybrid", "hybrid", False, False),
    ("Entwickler", "Berlin", "Flexible Arbeit im Homeoffice und im Büro", "hybrid", "hybrid", False, False),
    ("Entwickler", "Berlin", "Die Stelle ist 100% Homeoffice", "remote", "remote", False, False),
    ("Sviluppatore", "Milano", "smart working e due giorni in sede", "hybrid", "hybrid", False, False),
    ("Clerk", "Graz", "Work is onsite every day", "onsite", "onsite", False, False),
    ("Clerk", "Graz", "", None, None, False, False),
    (None, None, None, None, None, False, False),
    ("Hybrid Immunization Specialist", "Fairfax", "", "hybrid", "hybrid", False, False),
    ("Hybrid Cloud Architect", "Fairfax", "", None, None, False, False),
    ("UX Designer - Barcelona Hybrid", "Barcelona", "", "hybrid", "hybrid", False, False),
    ("Designer", "Austin, TX", "We are an all-remote company.", "remote", None, False, False),
    ("Manager", "Newport", "She oversees all remote employees reporting to that office.", None, None, False, False),
]
_said = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"'{v}'"


@query(
    "workplace_in_text",
    "C-1 C-3 C-8 C-9 C-10 C-11 T-11",
    f"SELECT * FROM (VALUES {', '.join(f'({k}, ' + ', '.join(map(_said, c[3:])) + ')' for k, c in enumerate(MODE_CASES))}) v(k, mode, later_mode, is_remote, worldwide)",
)
def _workplace_text(t):
    from . import classify as C

    rows = values(t.spark, [(k, *c[:3]) for k, c in enumerate(MODE_CASES)], ["k", "title", "location", "description"])
    own = [F.col(c) for c in ("title", "location", "description")]
    remote = C.is_remote(own[0], own[1], F.lit(None).cast("string"), own[2])
    return rows.select(F.col("k").cast("int").alias("k"), C.workplace_in_text(*own).alias("mode"), C.workplace_in_description(*own).alias("later_mode"), remote.alias("is_remote"), C.is_worldwide(*own, remote).alias("worldwide"))


@query(
    "classified_documents",
    "C-2 C-4 C-8",
    r"""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'remote' WHEN 1 THEN 'hybrid' WHEN 2 THEN 'onsite' WHEN 3 THEN 'hybrid' WHEN 4 THEN NULL ELSE 'remote' END AS mode,
  doc_id % 6 IN (0, 5) AS is_remote, CASE doc_id % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END AS visa FROM documents WHERE text IS NOT NULL""",
)
def _classified_documents(t):
    """The invented words of every whole document between phrases that decide; the words themselves decide nothing.

    A full stop ends the document: readers pass over line ends, and a last word like 'without' would turn what follows it.
    """
    from . import classify as C

    mode = F.element_at(F.array(*(F.lit(x) for x in ("This is a remote position.", "Work Model: Hybrid.", "You work on-site.", "This role is hybrid.", "Experience with hybrid cloud.", "You work from home."))), (F.col("doc_id") % 6 + 1).cast("int"))
    visa = F.element_at(F.array(*(F.lit(x) for x in ("Visa sponsorship is available.", "We do not sponsor visas.", "Bring your papers.", "Be kind."))), (F.col("doc_id") % 4 + 1).cast("int"))
    body = F.concat_ws(" \n", mode, F.concat("text", F.lit(" .")), visa)
    none = F.lit(None).cast("string")
    title = F.lit("Clerk")
    rows = t.documents.filter("text IS NOT NULL")
    return rows.select("doc_id", C.workplace_in_text(title, none, body).alias("mode"), C.is_remote(title, none, none, body).alias("is_remote"), C.visa(body).alias("visa"))


@query(
    "salary_in_text",
    "M-1 M-2 M-7",
    "SELECT k, CAST(low AS BIGINT) AS low, CAST(high AS BIGINT) AS high, currency, interval FROM (VALUES (1, 120000, 150000, 'USD', 'yearly'), (2, 22, 28, 'USD', 'hourly'), (3, 100000, 100000, 'USD', 'yearly'), (4, NULL, NULL, NULL, NULL), (5, 53000, 80000, 'EUR', 'yearly'), (6, 50000, 70000, 'GBP', 'yearly'), (7, 90000, 110000, 'USD', 'yearly')) v(k, low, high, currency, interval)",
)
def _salary_text(t):
    from .money import salary_in_text

    rows = [(1, "We pay $120,000 - $150,000 + bonus"), (2, "$22 - $28 per hour"), (3, "base salary is $100,000 plus commission of $25,000"), (4, "Sign-on bonus $20,000 - $30,000. Great team"), (5, "53,000 EUR - 80,000 EUR"), (6, "£50k-£70k"), (7, "Tuition of $15,000 - $20,000 paid back. Pay: $90,000 - $110,000")]
    got = values(t.spark, rows, ["k", "text"]).select(F.col("k").cast("int").alias("k"), salary_in_text(F.col("text")).alias("p"))
    return got.select("k", F.col("p.min").cast("long").alias("low"), F.col("p.max").cast("long").alias("high"), "p.currency", "p.interval")


@query("byte_cut", "T-9", "SELECT doc_id, octet_length(encode(text)) > 100 AS longer FROM documents")
def _byte_cut(t):
    cut = text.utf8_cut(F.col("text"), 100)
    return t.documents.filter(F.octet_length(cut).between(0, 100) & F.col("text").startswith(cut)).select("doc_id", (F.octet_length("text") > 100).alias("longer"))


LINKS = [(1, "https://boards.greenhouse.io/Acme/jobs/1"), (2, "https://acme-demo.recruitee.com/o/cook"), (3, "https://example.org/jobs"), (4, "https://jobs.lever.co/test-board/x"), (5, "https://big.wd5.myworkdayjobs.com/en-US/Ext")]


@query(
    "company_of_link",
    "U-6 U-7 U-11 U-12",
    "SELECT * FROM (VALUES (1, 'greenhouse', 'acme', 'https://boards.greenhouse.io/acme'), (2, 'recruitee', 'acme-demo', 'https://acme-demo.recruitee.com'), (3, NULL, NULL, NULL), (4, 'lever', 'test-board', 'https://jobs.lever.co/test-board'), (5, 'workday', 'big', 'https://big.myworkdayjobs.com')) v(k, ats, slug, career_url)",
)
def _company_of(t):
    return values(t.spark, LINKS, ["k", "url"]).select(F.col("k").cast("int").alias("k"), text.company_of(F.col("url")).alias("c")).select("k", "c.*")


PLACES_OF_LINKS = [
    ("https://big.wd5.myworkdayjobs.com/en-US/Ext/job/Graz/Cook_JR1?x=1", "big", "Ext", "/job/Graz/Cook_JR1"),
    ("https://wd1.myworkdaysite.com/recruiting/acme/Careers/job/Cook_R-2/", "acme", "Careers", "/job/Cook_R-2"),
    ("https://big.myworkdayjobs.com/Ext/job/Cook", None, None, None),
    ("https://big.wd5.myworkdayjobs.com/job/Cook", None, None, None),
    ("https://abc.fa.us2.oraclecloud.com/hcmUI/CandidateExperience/en/sites/CX_1/requisitions/job/300012/?lastSelectedFacet=x", "abc", "CX_1", "300012"),
    ("https://abc.fa.oraclecloud.com/hcmUI/CandidateExperience/en/sites/CX_2/job/7", "abc", "CX_2", "7"),
    ("http://abc.fa.oraclecloud.com/hcmUI/sites/CX_2/job/7", None, None, None),
    ("https://abc.fa.oraclecloud.com/hcmUI/sites/CX_2/job/x7", None, None, None),
    ("https://jobs.workable.com/view/ab12/cook-at-The-Caf%C3%A9-%26-Co?x", "wjb_name_the-caf-co", "https://jobs.workable.com/company-name/the-caf-co", None),
    ("https://jobs.workable.com/view/ab12/cook", "wjb_name_acme-gmbh", "https://jobs.workable.com/company-name/acme-gmbh", None),
]


@query("parts_of_links", "U-5 U-8", "SELECT * FROM (VALUES " + ", ".join(f"({k}, " + ", ".join("NULL" if v is None else f"'{v}'" for v in x[1:]) + ")" for k, x in enumerate(PLACES_OF_LINKS)) + ") v(k, a, b, c)")
def _parts_of_links(t):
    rows = values(t.spark, [(k, x[0]) for k, x in enumerate(PLACES_OF_LINKS)], ["k", "url"])
    w, o, f = text.workday_parts(F.col("url")), text.oracle_parts(F.col("url")), F.when(F.col("url").contains("workable"), text.feed_company(F.col("url"), F.lit("Acme GmbH")))
    return rows.select(F.col("k").cast("int").alias("k"), F.coalesce(w["tenant"], o["tenant"], f["slug"]).alias("a"), F.coalesce(w["site"], o["site"], f["career_url"]).alias("b"), F.coalesce(w["path"], o["job"]).alias("c"))


@query("apis_of_links", "U-5", "SELECT o_orderkey, 'https://t' || o_custkey || '.wd3.myworkdayjobs.com/wday/cxs/t' || o_custkey || '/Site/job/X_' || o_orderkey AS api FROM orders")
def _apis(t):
    url = F.concat(F.lit("https://T"), "o_custkey", F.lit(".wd3.myworkdayjobs.com/de-DE/Site/job/X_"), "o_orderkey", F.lit("?source=feed"))
    return t.orders.select("o_orderkey", F.replace(text.workday_parts(url)["api"], F.lit("cxs/T"), F.lit("cxs/t")).alias("api"))


@query("sandbox_boards", "U-3 U-4", "SELECT * FROM (VALUES (2), (4)) v(k)")
def _sandbox(t):
    rows = values(t.spark, LINKS, ["k", "url"]).select(F.col("k").cast("int").alias("k"), text.company_of(F.col("url"))["slug"].alias("slug"))
    return text.guarded(rows, "slug")[1].select("k")


@query("with_country", "G-12", "SELECT * FROM (VALUES (1, 'Austin, TX'), (2, 'Lyon, France'), (3, 'Berlin, Germany'), (4, NULL), (5, 'Tbilisi')) v(k, location)")
def _with_country(t):
    rows = [(1, "Austin, TX", "United States"), (2, "Lyon", "France"), (3, "Berlin, Germany", "France"), (4, None, "France"), (5, "Tbilisi", "nowhere")]
    return values(t.spark, rows, ["k", "location", "country"]).select(F.col("k").cast("int").alias("k"), geo.with_country_udf(F.col("location"), F.col("country")).alias("location"))


@query(
    "change_report",
    "D-5 S-24",
    "SELECT id, employment_type IS DISTINCT FROM 'Contract' AS type_changed, posted_at IS NULL OR id % 3 > 0 AS date_changed, CASE id % 3 WHEN 0 THEN posted_at ELSE first_seen_at - INTERVAL 200 DAY END < {as_of} - INTERVAL 180 DAY AND coalesce(posted_at, {as_of}) >= {as_of} - INTERVAL 180 DAY AS now_old FROM (SELECT *, id % 3 AS k FROM {postings}) WHERE k > 0 OR posted_at IS NOT NULL",
)
def _report(t):
    from .dates import changes

    told = F.when(F.col("id") % 3 == 0, F.col("posted_at")).otherwise(F.expr("first_seen_at - INTERVAL 200 DAY"))
    rows = t.postings.filter("id % 3 > 0 OR posted_at IS NOT NULL")
    c = changes(F.col("employment_type"), F.col("posted_at"), F.lit("Contract"), told, F.expr("TIMESTAMP_NTZ '2001-08-02 00:00:00'"))
    return rows.select("id", c.alias("c")).select("id", "c.*")


@query("producible_ids", "F-27", "SELECT o_orderkey, o_orderkey % 4 = 1 AS stale FROM orders")
def _producible(t):
    """Stored ids: a requisition, a place that was taken for one, a path, and a suffix."""
    k, n = F.col("o_orderkey") % 4, F.col("o_orderkey").cast("string")
    own = F.when(k == 0, F.concat(F.lit("JR-"), n)).when(k == 1, "Graz, Austria").when(k == 2, F.concat(F.lit("/job/Cook_"), n)).otherwise(F.concat(F.lit("R"), n))
    from ..sources.payloads import REQUISITION

    return t.orders.select("o_orderkey", (~own.rlike(REQUISITION) & ~own.startswith("/")).alias("stale"))


@query("loose_annual_salary", "M-5", "SELECT * FROM (VALUES (0, 62400), (1, 50000), (2, NULL), (3, 120000), (4, NULL)) v(k, yearly)")
def _loose(t):
    """The variant that looks for an interval's word anywhere: 'monster' holds a month."""
    rows = [(0, "30", "hourly rate"), (1, "50000", "salaryish"), (2, "1,000", "month"), (3, "10000", "monster"), (4, "9", "never")]
    return values(t.spark, rows, ["k", "amount", "interval"]).select(F.col("k").cast("int").alias("k"), labels.loose_annual_salary(F.col("amount"), F.col("interval")).cast("int").alias("yearly"))
