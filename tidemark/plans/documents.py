"""From a parsed posting to the stored row, and from stored rows to the search document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify, geo, labels
from ..functions.dates import epoch
from ..functions.labels import js_regex
from ..functions.money import salary_in_text
from ..functions.text import strip_html

# Names that feeds use for a source.
SOURCE_ALIASES = {"grnhse": "greenhouse", "myworkdayjobs": "workday", "icims2": "icims", "zohorecruit": "zoho", "jworkable": "workable", "taleo_careersection": "taleo", "taleo_selectminds": "taleo"}
# Titles of internships, not of those who run the programme.
INTERNSHIP_TITLE = r"\bintern(?:ship)?s?\b(?!\s+(?:program(?:me)?s?|coordinator|recruit\w*|manager|lead|specialist|director|advisor|liaison)\b)|\bstagiaire\b|\bpracticante\b"
LEVELS = "internship entry mid senior lead executive unknown".split()


def normal_source(ats: Column) -> Column:
    key = F.trim(F.lower(F.coalesce(ats, F.lit(""))))
    return F.coalesce(F.create_map(*(F.lit(x) for pair in SOURCE_ALIASES.items() for x in pair))[key], key)


def filled(c: Column) -> Column:
    """The value, or null where it is blank."""
    return F.when(c != "", c)


def spelled(n: Column) -> Column:
    """A number as text, whole ones without a point."""
    return F.when(n == F.floor(n), n.cast("long").cast("string")).otherwise(n.cast("string"))


def enriched(postings: DataFrame) -> DataFrame:
    """Parsed postings with the blanks filled from their texts, and the labels that stored rows carry.

    A stated salary, work mode or employment type stays as it is; the labels follow from what stands then.
    """
    plain = strip_html(F.col("description"))
    pay = postings.withColumn("__pay", F.when(filled(F.col("salary_min").cast("string")).isNull(), salary_in_text(plain)))
    blank = F.col("__pay").isNotNull() & F.col("__pay.min").isNotNull()
    out = pay.withColumns(
        {
            "salary_min": F.when(blank, spelled(F.col("__pay.min"))).otherwise(F.col("salary_min")),
            "salary_max": F.when(blank, spelled(F.col("__pay.max"))).otherwise(F.col("salary_max")),
            "salary_currency": F.when(blank, F.col("__pay.currency")).otherwise(F.col("salary_currency")),
            "salary_interval": F.when(blank, F.col("__pay.interval")).otherwise(F.col("salary_interval")),
            "workplace_type": F.coalesce(filled(F.col("workplace_type")), classify.workplace_in_text(F.col("title"), F.col("location"), plain)),
            "employment_type": F.coalesce(filled(F.col("employment_type")), labels.employment_in_text(F.col("title"), plain)),
        }
    ).drop("__pay")
    told = classify.classify(*(F.col(c) for c in ("title", "location", "workplace_type", "description")))
    return out.withColumn("__l", told).select(*out.columns, "__l.is_remote", "__l.remote_worldwide", "__l.experience_level")


def as_stored(postings: DataFrame) -> DataFrame:
    """What a sync writes: types in one spelling, the role, and yearly salaries that compare."""
    yearly = lambda c: labels.annual_salary(F.col(c).cast("string"), F.col("salary_interval"))
    return postings.withColumns(
        {
            "workplace_type": labels.workplace_type(F.col("workplace_type")),
            "employment_type": labels.employment_type(F.col("employment_type")),
            "role_category": labels.role_category(F.col("title")),
            "salary_min_annual": yearly("salary_min"),
            "salary_max_annual": yearly("salary_max"),
        }
    )


def index_employment_type(title: Column, stored: Column) -> Column:
    """An internship's title wins, then the canonical spelling, then the stored one."""
    return F.when(classify.without_nordic_intern(title).rlike(js_regex(INTERNSHIP_TITLE)), "Internship").otherwise(F.coalesce(labels.employment_type(stored), filled(stored)))


def to_documents(rows: DataFrame) -> DataFrame:
    """Search documents of stored rows joined with their companies. Blanks are null, and dates epochs in seconds."""
    here = geo.countries_udf(F.col("location"))
    remote = F.coalesce(F.col("is_remote"), F.lit(False))
    number = lambda c: F.col(c).try_cast("double")
    text = lambda *names: [filled(F.col(c)).alias(c) for c in names]
    return rows.withColumn("__here", here).select(
        "id", "external_id", "title", *text("department", "location"),
        F.when(remote, F.array_union("__here", geo.remote_region_countries(F.coalesce("location", F.lit(""))))).otherwise(F.col("__here")).alias("location_countries"),
        geo.tokens_udf(F.col("location")).alias("location_tokens"),
        *text("workplace_type"),
        index_employment_type(F.col("title"), F.col("employment_type")).alias("employment_type"),
        *text("experience_level", "visa_sponsorship", "role_category"),
        remote.alias("is_remote"), F.coalesce("remote_worldwide", F.lit(False)).alias("remote_worldwide"), "ats", "url",
        *(number(c).alias(c) for c in ("salary_min", "salary_max", "salary_min_annual", "salary_max_annual")),
        *text("salary_currency", "salary_interval"),
        "posted_at", epoch(F.coalesce("posted_at", "first_seen_at")).alias("posted_ts"), epoch(F.col("first_seen_at")).alias("first_seen_ts"),
        "company_id", *text("company_name"), filled(F.col("domain")).alias("company_domain"), filled(F.col("ats_slug")).alias("company_ats_slug"), filled(F.col("logo_url")).alias("company_logo_url"),
    )


# -- answers of a language model -----------------------------------------------------------------------------------------


def parsed_answer(content: Column) -> Column:
    """struct(is_remote, remote_worldwide, visa_sponsorship, experience_level) of an answer, or null if it is not valid.

    Fences of code are cut. Both flags must be booleans and both labels of their lists; 'unknown' becomes null.
    """
    body = F.trim(F.regexp_replace(F.regexp_replace(content, r"(?i)```json?\s*", ""), "```", ""))
    flag = lambda k: F.get_json_object(body, f"$.{k}")
    boolean = lambda k: body.rlike(rf'"{k}"\s*:\s*(?:true|false)\b')
    valid = boolean("is_remote") & boolean("remote_worldwide") & flag("visa_sponsorship").isin("yes", "no", "unknown") & flag("experience_level").isin(LEVELS) & F.from_json(body, "is_remote boolean").isNotNull()
    known = lambda k: F.nullif(flag(k), F.lit("unknown")).alias(k)
    return F.when(valid, F.struct(flag("is_remote").cast("boolean").alias("is_remote"), flag("remote_worldwide").cast("boolean").alias("remote_worldwide"), known("visa_sponsorship"), known("experience_level")))


def with_answers(stored: DataFrame, answers: DataFrame) -> DataFrame:
    """stored with the answers (id, content) laid over it. A stated work mode keeps the flags that follow from it."""
    told = answers.select("id", parsed_answer(F.col("content")).alias("__a"))
    rows = stored.join(told.filter("__a IS NOT NULL"), "id", "left").withColumn("__came", F.col("__a").isNotNull())
    free = F.col("workplace_type").isNull()
    return rows.withColumns(
        {
            "visa_sponsorship": F.when(F.col("__came"), F.coalesce("__a.visa_sponsorship", "visa_sponsorship", F.lit("unknown"))).otherwise(F.col("visa_sponsorship")),
            "experience_level": F.coalesce("__a.experience_level", "experience_level"),
            "is_remote": F.when(free, F.coalesce("__a.is_remote", "is_remote")).otherwise(F.col("is_remote")),
            "remote_worldwide": F.when(free, F.coalesce("__a.remote_worldwide", "remote_worldwide")).otherwise(F.col("remote_worldwide")),
        }
    ).select(*stored.columns)


def retagged(rows: DataFrame) -> DataFrame:
    """rows with `workplace_now`: a stored Hybrid goes where no field of the posting says hybrid, to what its texts say.

    Other stored modes, and hybrid ones that title, place or text bear out, are kept; nothing is guessed: where the texts
    say nothing, the stored mode stays.
    """
    own = [F.col(c) for c in ("title", "location", "description")]
    said = classify.workplace_in_description(*own)
    unfounded = (F.lower("workplace_type") == "hybrid") & ~classify.states_hybrid(*own) & ~classify.any_of(F.lower(F.concat_ws(" ", *own)), [*classify.P.HYBRID_FOREIGN, classify.P.OFFICE_DAYS])
    return rows.withColumn("workplace_now", F.when(unfounded & said.isin("remote", "onsite"), F.initcap(said)).otherwise(F.col("workplace_type")))


def search_tokens(*columns: Column) -> Column:
    """The words of a stored row's searched columns, each once, in the order of the alphabet."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(F.concat_ws(" ", *columns)), r"[^\p{L}\p{N}_-]+"), lambda w: w != "")))
