"""Search requests: what is asked, as data; compiled to one predicate and one plan."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.dates import posted_window
from ..functions.labels import normalize_employment_type

# Names that are a country and a place elsewhere.
AMBIGUOUS = frozenset({"georgia", "angola", "macedonia", "liberia"})
MOST_ROWS, USUAL_ROWS, HIT_CAP, ROLE_CAP, DEPTH_BUDGET = 200, 50, 10_000, 24, 4_000


@dataclass(frozen=True)
class SearchRequest:
    q: str | None = None
    location: str | list[str] | None = None
    work_mode: str | list[str] | None = None
    employment_type: str | list[str] | None = None
    experience_level: str | list[str] | None = None
    ats: str | list[str] | None = None
    company_id: int | None = None
    posted: str | None = None
    remote: str | None = None
    remote_worldwide: str | None = None
    visa: str | None = None
    home: str | None = None
    include_unlabeled: str | None = None
    salary_min: str | None = None
    salary_max: str | None = None
    salary_currency: str | None = "USD"
    limit: int = USUAL_ROWS
    offset: int = 0
    page: int | None = None
    month_as_days: bool = True  #: a month of the posted window is 30 days, else a calendar month


def listed(value) -> list[str]:
    """An array or comma list: trimmed, without repeats in any case of letters."""
    parts = value if isinstance(value, list) else str(value or "").split(",")
    seen: dict[str, str] = {}
    for p in (str(x).strip() for x in parts):
        if p:
            seen.setdefault(p.lower(), p)
    return list(seen.values())


def leading_int(value) -> int | None:
    """The integer that a text begins with: '85k' is 85."""
    m = re.match(r"\s*([+-]?\d+)", str(value if value is not None else ""))
    return int(m[1]) if m else None


# -- location grammar ------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Group:
    """Places joined by OR, and the countries (by code) that they must lie in; either may be empty, not both."""

    places: tuple[str, ...] = ()
    countries: tuple[str, ...] = ()


#: An element as a word over p (place), a (ambiguous name), c (country) and x (a group of its own), cut into runs: a country
#: that leads the last run closes it; a run takes the country after it; every other country stands alone.
RUNS = re.compile(r"c(?P<led>[pa]+)$|(?P<run>[pa]+)(?P<closed>c?)|c|x")


def parse_element(element: str) -> list[Group]:
    """Groups of one comma list. Places are joined to the country beside their run; `place|Country` is a group of its own.

    An ambiguous name is a place of its run and, beside it, a country, unless exactly the United States closes the run.
    """
    kinds, values = "", []
    for term in filter(None, map(str.strip, element.split(","))):
        piped = [p for p in map(str.strip, term.split("|")) if p]
        if len(piped) > 1 and (codes := geo.country_codes(piped[-1])):
            kinds, values = kinds + "x", [*values, Group(tuple(piped[:-1]), codes)]
        else:
            codes = geo.country_codes(term)
            kinds, values = kinds + ("p" if not codes else "a" if geo.norm(term) in AMBIGUOUS else "c"), [*values, term]
    out: list[Group] = []
    for m in RUNS.finditer(kinds):
        if m[0] == "x":
            out.append(values[m.start()])
        elif m[0] == "c":
            out.append(Group((), geo.country_codes(values[m.start()])))
        else:
            first, last = m.span("led" if m["led"] else "run")
            closer = values[m.start()] if m["led"] else values[last] if m["closed"] else ""
            codes = geo.country_codes(closer) if closer else ()
            named = [values[k] for k in range(first, last)]
            if codes != ("us",):
                out += [Group((), geo.country_codes(values[k])) for k in range(first, last) if kinds[k] == "a"]
            out.append(Group(tuple(dict.fromkeys(named)), codes))
    return out


def place_predicate(place: str, tokens: Column, countries: Column, location: Column) -> Column:
    """Any spelling of the place among the location's tokens; a state's code only inside the United States."""
    spellings = geo.place_spellings(place)
    parts = [F.arrays_overlap(tokens, F.lit(spellings))]
    state = geo.us_state_code(place)
    if state:
        parts.append(F.array_contains(tokens, state) & F.array_contains(countries, "us"))
    if len(place.split()) > 4:
        parts.append(F.lower(location).contains(geo.norm(place)))
    return reduce(or_, parts)


def group_predicate(group: Group, tokens: Column, countries: Column, location: Column) -> Column:
    inside = F.arrays_overlap(countries, F.lit(list(group.countries))) if group.countries else None
    named = reduce(or_, (place_predicate(p, tokens, countries, location) for p in group.places)) if group.places else None
    return inside if named is None else named if inside is None else named & inside


def location_elements(request: SearchRequest) -> list[str]:
    return request.location if isinstance(request.location, list) else [request.location] if request.location else []


def home_of(request: SearchRequest) -> tuple[str, tuple[str, ...]] | None:
    """The city and countries of home, 'City|Country', if it has both."""
    home = [p.strip() for p in (request.home or "").split("|")]
    codes = geo.country_codes(home[1]) if len(home) == 2 and home[0] else ()
    return (home[0], codes) if codes else None


def location_predicate(request: SearchRequest) -> Column | None:
    """OR of all groups of all elements. home: 'City|Country' narrows the element that equals it, to that country or none."""
    tokens, countries, location = F.col("location_tokens"), F.col("location_countries"), F.col("location")
    home = home_of(request)
    parts: list[Column] = []
    for element in location_elements(request):
        if home and geo.norm(element) == geo.norm(home[0]):
            known = F.arrays_overlap(countries, F.lit(list(home[1]))) | countries.isNull() | (F.size(countries) == 0)
            parts.append(place_predicate(home[0], tokens, countries, location) & known)
        else:
            parts += [group_predicate(g, tokens, countries, location) for g in parse_element(element)]
    return reduce(or_, parts) if parts else None


# How many postings a place needs to tell its country, the least share of them, how many countries and places.
PLACE_LEAST, PLACE_SHARE, PLACE_COUNTRIES, PLACES_LOOKED_UP = 20, 0.3, 3, 6


def widened_countries(df: DataFrame, request: SearchRequest) -> list[str]:
    """The countries that a remote search with places widens to; none where it names no place that lies in one.

    A place lies where the postings that have it say: one scan counts countries for all places that the request names.
    Countries that it names itself, and that of its home, are kept.
    """
    asked = request.remote == "true" or "remote" in {m.lower() for m in listed(request.work_mode)}
    if not asked or request.remote_worldwide == "true" or not location_elements(request):
        return []
    home = home_of(request)
    away = [e for e in location_elements(request) if not (home and geo.norm(e) == geo.norm(home[0]))]
    terms = list(dict.fromkeys(t.strip() for e in away for t in re.split("[,|]", e) if t.strip()))
    named = [c for t in terms for c in geo.country_codes(t)]
    places = [t for t in terms if not geo.country_codes(t) or geo.norm(t) in AMBIGUOUS][:PLACES_LOOKED_UP]
    found = list(home[1]) if home and len(away) < len(location_elements(request)) else []
    if places:
        tokens, countries, location = F.col("location_tokens"), F.col("location_countries"), F.col("location")
        hits = F.array_compact(F.array(*(F.when(place_predicate(p, tokens, countries, location), F.lit(p)) for p in places)))
        votes = df.select(F.explode(hits).alias("place"), F.col("location_countries").alias("codes"))
        told = votes.select("place", F.explode("codes").alias("code")).groupBy("place", "code").agg(F.count("*").alias("n")).collect()
        for place in places:
            own = {r["code"]: r["n"] for r in told if r["place"] == place}
            if (total := sum(own.values())) >= PLACE_LEAST:
                found += sorted((c for c in own if own[c] >= PLACE_SHARE * total), key=lambda c: (-own[c], c))[:PLACE_COUNTRIES]  # noqa: B023
    return sorted({*found, *named}) if found else []


# -- flat predicates -------------------------------------------------------------------------------------------------


def predicates(request: SearchRequest, as_of: Column, columns: list[str], widened: list[str] | None = None) -> list[Column]:
    """All that is asked besides the text, on rows with the named columns.

    widened: countries where remote postings are wanted too, beside the places. Other work modes keep the places.
    """
    out = [F.col("removed_at").isNull()]
    stated = location_predicate(request) if "location_tokens" in columns else None
    modes = {m.lower() for m in listed(request.work_mode)}
    office = [m for m in ("hybrid", "onsite") if m in modes or m == "onsite" and "on-site" in modes]
    here = F.lower("workplace_type").isin(office) if office else None
    if office and request.include_unlabeled == "true":
        here = here | ((F.col("workplace_type").isNull() | (F.col("workplace_type") == "")) & ~F.coalesce("is_remote", F.lit(False)))
    if stated is not None and widened:
        away = F.col("is_remote") & (stated | F.arrays_overlap("location_countries", F.lit(widened)) | F.coalesce("remote_worldwide", F.lit(False)))
        out.append(away if here is None or request.remote == "true" else away | (here & stated))
    else:
        ways = [F.col("is_remote")] * ("remote" in modes) + [here] * (here is not None)
        out += [reduce(or_, ways) if ways else F.lit(False)] * bool(modes) + [stated] * (stated is not None)
    if kinds := listed(request.employment_type):
        out.append(F.lower("employment_type").isin([(normalize_employment_type(k) or k).lower() for k in kinds]))
    for name in ("experience_level", "ats"):
        if values := listed(getattr(request, name)):
            out.append(F.lower(name).isin([v.lower() for v in values]))
    if request.company_id is not None:
        out.append(F.col("company_id") == int(request.company_id))
    if request.remote == "true":
        out.append(F.col("is_remote"))
    if request.remote_worldwide == "true":
        out.append(F.col("remote_worldwide"))
    if request.visa == "true":
        out.append(F.col("visa_sponsorship") == "yes")
    low, high = leading_int(request.salary_min), leading_int(request.salary_max)
    if low is not None:
        out.append(F.col("salary_min_annual") >= low)
    if high is not None:
        out.append(F.col("salary_min_annual") <= high)
    if (low is not None or high is not None) and request.salary_currency:
        out.append(F.col("salary_currency") == request.salary_currency.upper())
    window = posted_window(request.posted)
    if window:
        back = F.make_interval(months=F.lit(window.n)) if window.unit == "months" and not request.month_as_days else F.expr(f"INTERVAL {window.seconds} SECOND")
        out.append(F.coalesce("posted_at", "first_seen_at") >= as_of - back)
    return out


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\W_][\w-]*", (text or "").lower())


def text_predicate(q: str | None, column: str = "title") -> Column | None:
    """Roles (comma list) joined by OR, the words of a role by AND."""
    tokens = F.split(F.lower(F.col(column)), r"[^\p{L}\p{N}_-]+")
    roles = [reduce(and_, (F.array_contains(tokens, w) for w in own)) for own in map(words, listed(q)) if own]
    return reduce(or_, roles) if roles else None


def where(df: DataFrame, request: SearchRequest, as_of: Column, widened: list[str] | None = None) -> DataFrame:
    parts = predicates(request, as_of, df.columns, widened)
    text = text_predicate(request.q)
    return df.filter(reduce(and_, parts + ([text] if text is not None else [])))


def page_of(df: DataFrame, request: SearchRequest, order: list[Column]) -> DataFrame:
    limit = max(1, min(MOST_ROWS, request.limit))
    offset = (request.page - 1) * limit if request.page else request.offset
    return df.orderBy(*order).offset(max(0, offset)).limit(limit)


# -- ranked retrieval ------------------------------------------------------------------------------------------------

TOKENS = r"[^\p{L}\p{N}_-]+"


# Letters from which a word may have one error, or two; how far apart two words can be.
ONE_ERROR, TWO_ERRORS, FARTHEST = 5, 9, 8


class Held:
    """A word of a request among a title's tokens: its least errors, whether they are few enough, and where it stands."""

    def __init__(self, tokens: Column, word: str):
        most = 2 if len(word) >= TWO_ERRORS else 1 if len(word) >= ONE_ERROR else 0
        errors = F.transform(tokens, lambda t: F.when(t == word, 0).otherwise(F.nullif(F.levenshtein(t, F.lit(word), most), F.lit(-1)))) if most else F.transform(tokens, lambda t: F.when(t == word, 0))
        self.errors = F.array_min(errors)
        self.found = self.errors.isNotNull()
        self.place = F.array_position(errors, self.errors)


def gap(a: Held, b: Held) -> Column:
    """How far the second word stands from the first; one more if it stands before it."""
    return F.least(F.when(b.place > a.place, b.place - a.place).otherwise(a.place - b.place + 1), F.lit(FARTHEST))


def rank_of(tokens: Column, own: list[str]) -> tuple[Column, Column]:
    """Whether the tokens hold all words, and struct(errors, apart, extra) that ranks what does, least first."""
    held = [Held(tokens, w) for w in own]
    errors = reduce(lambda x, y: x + y, (h.errors for h in held))
    apart = reduce(lambda x, y: x + y, (gap(x, y) for x, y in zip(held, held[1:], strict=False)), F.lit(0).cast("long"))
    return reduce(and_, (h.found for h in held)), F.struct(errors.alias("errors"), apart.alias("apart"), (F.size(tokens) - len(own)).alias("extra"))


def best_first() -> list[Column]:
    """Fewest errors, nearest words, fewest other words in the title, then newest, then id."""
    return [F.col("fit"), F.desc("first_seen_at"), F.col("id")]


def tagged(df: DataFrame, roles: list[str]) -> DataFrame:
    """A row for each role whose words are all in the title: role, its number, and fit, how well. One scan."""
    tokens = F.split(F.lower("title"), TOKENS)
    hits = []
    for k, r in enumerate(roles):
        found, fit = rank_of(tokens, words(r))
        hits.append(F.when(found, F.struct(F.lit(k).alias("role"), fit.alias("fit"))))
    return df.withColumn("__hit", F.explode(F.array_compact(F.array(*hits)))).select(*df.columns, "__hit.role", "__hit.fit")


def ranked(df: DataFrame, role: str, depth: int) -> DataFrame:
    """Rows whose title holds every word of the role, best first: (…, rank). An empty role: all rows, newest first."""
    from pyspark.sql import Window

    hits = tagged(df, [role]).drop("role") if words(role) else df.withColumn("fit", F.lit(0))
    return hits.orderBy(*best_first()).limit(depth).withColumn("rank", F.row_number().over(Window.orderBy(*best_first()))).drop("fit")


def loose(df: DataFrame, q: str, depth: int) -> DataFrame:
    """Rows whose title holds the first word of q, those with more of its leading words first: (…, rank)."""
    from pyspark.sql import Window

    tokens, own = F.split(F.lower("title"), TOKENS), words(q)
    found = [Held(tokens, w).found for w in own]
    held = F.lit(0)
    for n in range(1, len(own) + 1):
        held = F.when(reduce(and_, found[:n]), n).otherwise(held)
    order = [F.desc("held"), F.col("extra"), F.desc("first_seen_at"), F.col("id")]
    rows = df.withColumn("held", held).filter("held > 0").withColumn("extra", F.size(tokens) - F.col("held"))
    return rows.orderBy(*order).limit(depth).withColumn("rank", F.row_number().over(Window.orderBy(*order))).drop("held", "extra")


def lists(df: DataFrame, roles: list[str], depth: int) -> DataFrame:
    """(id, title, link, role, rank): the first depth rows of each role, from one scan.

    Up to a depth of 1,000 each task keeps only its own best of a role before the shuffle (a limit of the window group), and
    beyond it each role takes its first rows by itself.
    """
    from pyspark.sql import Window

    if depth > 1000:
        parts = [ranked(df, r, depth).select("id", "title", "link", "rank").withColumn("role", F.lit(k)) for k, r in enumerate(roles)]
        return reduce(DataFrame.unionByName, parts)
    rank = F.row_number().over(Window.partitionBy("role").orderBy(*best_first()))
    hits = tagged(df.select("id", "title", "link", "first_seen_at"), roles)
    return hits.withColumn("rank", rank).filter(F.col("rank") <= depth).select("id", "title", "link", "rank", "role")


def interleave(df: DataFrame, roles: list[str], limit: int, offset: int = 0) -> DataFrame:
    """Round-robin of the roles' lists. A row whose id or whose (link, title) was taken before is passed over.

    Depth times roles is bounded by DEPTH_BUDGET, so the sequential pass sees a bounded list in one group. Past the budget
    the page is cut from one loose list of all words instead, as deep as it was asked for.
    """
    roles = [r for r in roles if words(r)][:ROLE_CAP]
    depth = offset + limit
    if depth * len(roles) > DEPTH_BUDGET or not roles:
        rows = loose(df, " ".join(roles), depth) if roles else ranked(df, "", depth)
        page = rows.filter(F.col("rank") > offset)
        return page.select("id", "title", F.lit(0).alias("role"), (F.col("rank") - 1).cast("long").alias("place"))

    def take(rows):
        import pandas as pd

        seen, kept = set(), []
        for x, title, link, role in rows.sort_values(["rank", "role"])[["id", "title", "link", "role"]].itertuples(index=False):
            keys = {("id", x), ("link", str(link).rstrip("/").lower(), re.sub(r"[^a-z0-9]+", " ", title.lower()).strip())}
            if not keys & seen:
                seen |= keys
                kept.append((x, title, role, len(kept)))
        return pd.DataFrame(kept[offset : offset + limit], columns=["id", "title", "role", "place"]).astype({"id": "int64", "role": "int32", "place": "int64"})

    return lists(df, roles, depth).withColumn("all", F.lit(0)).groupBy("all").applyInPandas(take, "id long, title string, role int, place long")


def total_of(df: DataFrame, roles: list[str]) -> DataFrame:
    """One row, total: what the roles hit, a row once for each of them, at most HIT_CAP each; and capped, whether one is."""
    roles = [r for r in roles if words(r)][:ROLE_CAP]
    counts = tagged(df.select("title"), roles).groupBy("role").count() if roles else df.groupBy(F.lit(0).alias("role")).count()
    return counts.agg(F.coalesce(F.sum(F.least("count", F.lit(HIT_CAP))), F.lit(0)).alias("total"), F.coalesce(F.max(F.col("count") >= HIT_CAP), F.lit(False)).alias("capped"))


def page_metadata(total: DataFrame, request: SearchRequest) -> DataFrame:
    """One row about the page that the request asks for, from (total, capped)."""
    limit = max(1, min(MOST_ROWS, request.limit))
    offset = max(0, (request.page - 1) * limit if request.page else request.offset)
    n, after = F.col("total"), F.col("total") > offset + limit
    return total.select(
        n,
        F.lit(offset // limit + 1).alias("page"),
        F.ceil(n / limit).alias("pages"),
        after.alias("has_next"),
        F.lit(offset > 0).alias("has_prev"),
        F.when(after, offset + limit).alias("next_offset"),
        F.lit(max(0, offset - limit) if offset else None).cast("int").alias("prev_offset"),
        "capped",
    )


def search(df: DataFrame, request: SearchRequest, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """The page (id, title, role, place), and one row about it. df has a link and what the filters ask for.

    One role is searched with all its words, and if nothing has them, with fewer from its end; several roles take turns.
    Without text the newest rows come first.
    """
    from dataclasses import replace

    rows = where(df, replace(request, q=None), as_of, widened_countries(df, request) if "location_tokens" in df.columns else None)
    roles = [r for r in listed(request.q) if words(r)][:ROLE_CAP]
    limit = max(1, min(MOST_ROWS, request.limit))
    offset = max(0, (request.page - 1) * limit if request.page else request.offset)
    if len(roles) > 1:
        page = interleave(rows, roles, limit, offset)
    else:
        hits = widening(rows, roles[0], offset + limit)[0] if roles else ranked(rows, "", offset + limit)
        page = hits.filter(F.col("rank") > offset).select("id", "title", F.lit(0).alias("role"), (F.col("rank") - 1).cast("long").alias("place"))
    return page, page_metadata(total_of(rows, roles), request)


def widening(df: DataFrame, role: str, depth: int) -> tuple[DataFrame, bool]:
    """The role's hits; if there are none, words go from its end until there are."""
    own, widened = words(role), False
    while own:
        hits = ranked(df, " ".join(own), depth)
        if len(own) == 1 or not hits.isEmpty():
            return hits, widened
        own, widened = own[:-1], True
    return df.limit(0), False
