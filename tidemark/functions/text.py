"""Text, HTML and URL expressions, all in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Named character references, the ampersand last.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def decode_entities(c: Column) -> Column:
    return reduce(lambda s, e: F.replace(s, F.lit(e[0]), F.lit(e[1])), ENTITIES.items(), c)


def strip_html(c: Column) -> Column:
    """Plain text of markup: breaks for paragraphs and headings, bullets for items, no tags."""
    s = F.regexp_replace(c, r"(?i)<br\s*/?>|</li>", "\n")
    s = F.regexp_replace(s, r"(?i)</p>|</h[1-6]>", "\n\n")
    s = F.regexp_replace(s, r"(?i)<li[^>]*>", "• ")
    s = F.regexp_replace(s, r"<[^>]+>", "")
    s = F.replace(F.replace(s, F.lit("&amp;"), F.lit("&")), F.lit("&lt;"), F.lit("<"))
    s = reduce(lambda x, e: F.replace(x, F.lit(e), F.lit(ENTITIES[e])), ("&gt;", "&quot;", "&#39;", "&nbsp;"), s)
    s = F.regexp_replace(s, r"\n{3,}", "\n\n")
    return F.when(c != "", F.regexp_replace(s, r"^\s+|\s+$", ""))


def title_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def slug_of(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def name_of_slug(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("-"), F.lit(" ")))


def query_words(c: Column) -> Column:
    """Words of a request, without signs other than - and _."""
    return F.filter(F.split(F.regexp_replace(c, r"[^\p{L}\p{N}_-]", " "), r"\s+"), lambda w: w != "")


def demand_key(*parts: Column) -> Column:
    return F.concat_ws("|", *(F.substring(F.trim(F.regexp_replace(F.lower(F.coalesce(p, F.lit(""))), r"\s+", " ")), 1, 200) for p in parts))


def real_description(c: Column) -> Column:
    """Whether a text reads like a whole description: long, not cut off, no template fields, closed if short."""
    s = F.trim(c)
    n = F.length(s)
    return (n >= 300) & ~s.rlike(r"(\.\.\.|…)$") & ~s.rlike(r"%[A-Z_]{3,}%") & ((n >= 800) | s.rlike(r"[.!?:)\"'”]$"))


def json_ld(html: Column, kind: str = "JobPosting") -> Column:
    """The first JSON-LD object of the kind in a page, as text."""
    blocks = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    return F.try_element_at(F.filter(blocks, lambda b: F.get_json_object(b, "$['@type']") == kind), F.lit(1))


def url_part(url: Column, part: str) -> Column:
    return F.try_parse_url(url, F.lit(part))


def public_https(url: Column) -> Column:
    """An https link to a public name: no address, in whatever spelling a browser reads as one, and no local name."""
    host = F.lower(url_part(url, "HOST"))
    named = host.rlike(r"^[a-z0-9-]+(\.[a-z0-9-]+)+$")
    address = host.rlike(r"^(?:(?:0x[0-9a-f]*|\d+)\.){1,3}(?:0x[0-9a-f]*|\d+)$")
    local = host.rlike(r"(^|\.)(localhost|local|internal|localdomain)$")
    return F.coalesce((F.lower(url_part(url, "PROTOCOL")) == "https") & named & ~address & ~local, F.lit(False))


# Hosts and paths of the boards whose links carry the posting's id: (host, path with board and id).
UUID = "[0-9a-fA-F-]{36}"
BOARDS = {
    "greenhouse": (r"(^|\.)greenhouse\.io$", r"^/([^/]+)/jobs/(\d+)"),
    "workable": (r"^apply\.workable\.com$", r"^/([^/]+)/j/([0-9A-Za-z]+)"),
    "lever": (r"^jobs\.(eu\.)?lever\.co$", rf"^/([^/]+)/({UUID})"),
    "ashby": (r"^jobs\.ashbyhq\.com$", rf"^/([^/]+)/({UUID})"),
    "smartrecruiters": (r"(^|\.)smartrecruiters\.com$", r"^/([^/]+)/(\d{6,})"),
    "rippling": (r"^ats\.rippling\.com$", rf"^/([^/]+)/jobs/({UUID})"),
}


def posting_key(ats: Column, url: Column) -> Column:
    """struct(external_id, board) of the posting that a board's link names, or null."""
    link, kind = F.trim(url), F.lower(ats)
    host, path = F.lower(url_part(link, "HOST")), url_part(link, "PATH")
    out = None
    for name, (hosts, paths) in BOARDS.items():
        hit = (kind == name) & host.rlike(hosts) & path.rlike(paths)
        value = F.struct(F.concat(F.lit(name + "_"), F.regexp_extract(path, paths, 2)).alias("external_id"), F.lower(F.regexp_extract(path, paths, 1)).alias("board"))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    sub = r"^([^.]+)\.bamboohr\.com$"
    own = F.struct(F.concat(F.lit("bamboohr_"), F.regexp_extract(path, r"/careers/(\d+)", 1)).alias("external_id"), F.regexp_extract(host, sub, 1).alias("board"))
    return out.when((kind == "bamboohr") & host.rlike(sub) & path.rlike(r"/careers/\d+"), own)


def verdict(status: Column, final_url: Column, body: Column, dead: str = r"no longer (available|accepting)|position has been filled|job not found|posting (has )?(expired|closed)") -> Column:
    """alive, dead or unknown of a captured response."""
    text = F.lower(F.coalesce(body, F.lit("")))
    blocked = status.isin(403, 429) | (status >= 500) | text.rlike("captcha|access denied|are you a robot")
    return F.when(status.isin(404, 410), "dead").when(blocked | status.isNull(), "unknown").when(text.rlike(dead), "dead").when(final_url.rlike(r"/(jobs|careers)/?$"), "dead").otherwise("alive")


def utf8_cut(c: Column, most_bytes: int) -> Column:
    """At most so many bytes of UTF-8, without half a character at the end."""
    cut = F.substring(F.encode(c, "UTF-8"), 1, most_bytes)
    return F.when(F.octet_length(c) <= most_bytes, c).otherwise(F.regexp_replace(F.try_validate_utf8(F.make_valid_utf8(cut.cast("string"))), "\ufffd+$", ""))


def workday_parts(url: Column) -> Column:
    """struct(host, tenant, site, path, api) of a Workday posting's link, or null. The path begins with /job."""
    link = r"^https?://([^/?#]+)(?:/[^/?#]+)*?/([^/?#]+)(/job(?:/[^?#]*)?)(?:[?#].*)?$"
    host, site, path = (F.regexp_extract(url, link, k) for k in (1, 2, 3))
    jobs, sites = host.rlike(r"(?i)\.wd\d+\.myworkdayjobs\.com$"), host.rlike(r"(?i)\.myworkdaysite\.com$")
    tenant = F.when(jobs, F.regexp_extract(host, r"^([^.]+)", 1)).when(sites, F.regexp_extract(url, r"^https?://[^/]+/recruiting/([^/?#]+)", 1))
    trimmed = F.regexp_replace(path, "/+$", "")
    api = F.concat(F.lit("https://"), F.lower(host), F.lit("/wday/cxs/"), tenant, F.lit("/"), site, trimmed)
    return F.when(tenant != "", F.struct(F.lower(host).alias("host"), tenant.alias("tenant"), site.alias("site"), trimmed.alias("path"), api.alias("api")))


def oracle_parts(url: Column) -> Column:
    """struct(host, tenant, region, site, job, api) of an Oracle candidate-experience posting's link, or null."""
    link = r"^https://([^./?#]+)\.fa(?:\.([^./?#]+))?\.oraclecloud\.com(?:/[^?#]*)?/sites/([^/?#]+)(?:/[^/?#]+)*?/job/(\d+)(?:[/?#].*)?$"
    tenant, region, site, job = (F.regexp_extract(url, link, k) for k in (1, 2, 3, 4))
    host = F.regexp_extract(url, r"^https://([^/?#]+)", 1)
    api = F.concat(F.lit("https://"), host, F.lit("/hcmRestApi/resources/latest/recruitingCEJobRequisitionDetails?onlyData=true&expand=all&finder=ById;Id="), job, F.lit(",siteNumber="), F.url_encode(site))
    return F.when(job != "", F.struct(host.alias("host"), tenant.alias("tenant"), F.nullif(region, F.lit("")).alias("region"), site.alias("site"), job.alias("job"), api.alias("api")))


def feed_company(url: Column, name: Column) -> Column:
    """struct(slug, career_url) of a marketplace posting's employer, by its link, else by its name; null without either."""
    said = F.regexp_extract(url, r"(?i)^https?://jobs\.workable\.com/view/[^/]+/.*-at-([^/?#]+)/?(?:[?#].*)?$", 1)
    slug = F.coalesce(F.nullif(slug_of(F.coalesce(F.try_url_decode(said), said)), F.lit("")), F.nullif(slug_of(name), F.lit("")))
    return F.when(slug.isNotNull(), F.struct(F.left(F.concat(F.lit("wjb_name_"), slug), F.lit(200)).alias("slug"), F.concat(F.lit("https://jobs.workable.com/company-name/"), slug).alias("career_url")))


# Hosts of boards, what in the link is the board's name, and the board's address.
HOSTS = {
    "greenhouse": (r"https?://(?:boards|job-boards)\.greenhouse\.io/([^/?#]+)", "https://boards.greenhouse.io/%s"),
    "lever": (r"https?://jobs\.(?:eu\.)?lever\.co/([^/?#]+)", "https://jobs.lever.co/%s"),
    "ashby": (r"https?://jobs\.ashbyhq\.com/([^/?#]+)", "https://jobs.ashbyhq.com/%s"),
    "workable": (r"https?://apply\.workable\.com/([^/?#]+)", "https://apply.workable.com/%s"),
    "smartrecruiters": (r"https?://(?:jobs|careers)\.smartrecruiters\.com/([^/?#]+)", "https://careers.smartrecruiters.com/%s"),
    "bamboohr": (r"https?://([^./]+)\.bamboohr\.com", "https://%s.bamboohr.com/careers"),
    "recruitee": (r"https?://([^./]+)\.recruitee\.com", "https://%s.recruitee.com"),
    "teamtailor": (r"https?://([^./]+)\.teamtailor\.com", "https://%s.teamtailor.com/jobs"),
    "breezy": (r"https?://([^./]+)\.breezy\.hr", "https://%s.breezy.hr"),
    "jazzhr": (r"https?://([^./]+)\.applytojob\.com", "https://%s.applytojob.com/apply"),
    "pinpoint": (r"https?://([^./]+)\.pinpointhq\.com", "https://%s.pinpointhq.com"),
    "personio": (r"https?://([^./]+)\.jobs\.personio\.(?:de|com)", "https://%s.jobs.personio.de"),
    "rippling": (r"https?://ats\.rippling\.com/(?:[a-z]{2}-[A-Z]{2}/)?([^/?#]+)", "https://ats.rippling.com/%s/jobs"),
    "icims": (r"https?://(?:careers-|jobs-)?([^./]+)\.icims\.com", "https://careers-%s.icims.com"),
    "workday": (r"https?://([^./]+)\.wd\d+\.myworkdayjobs\.com", "https://%s.myworkdayjobs.com"),
}
SANDBOX = "sandbox demo test testing qa uat staging dev example sample dummy".split()


def company_of(url: Column) -> Column:
    """struct(ats, slug, career_url) of a link to a known board, or null."""
    out = None
    for ats, (pattern, address) in HOSTS.items():
        slug = F.lower(F.regexp_extract(url, "(?i)" + pattern, 1))
        value = F.struct(F.lit(ats).alias("ats"), slug.alias("slug"), F.format_string(address, slug).alias("career_url"))
        hit = url.rlike("(?i)^" + pattern)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def is_sandbox(slug: Column) -> Column:
    """Whether a part of a board's name says that it is no real employer's."""
    return F.exists(F.split(F.lower(F.coalesce(slug, F.lit(""))), r"[-_.\s]+|(?<=[a-z])(?=\d)"), lambda p: p.isin(SANDBOX))


def guarded(df, slug: str, mode: str = "enforce"):
    """(kept, rejected) by the guard's mode: off and log keep all; log and enforce tell what a board's name rejects."""
    hit = is_sandbox(F.col(slug))
    kept = df.filter(~hit) if mode == "enforce" else df
    return kept, df.filter(hit) if mode != "off" else df.limit(0)
