"""Labels of postings from title, place and description: pattern tables in a fixed precedence, as one CASE each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .labels import js_regex

def text_of(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


#: Words that the patterns of a reader cannot do without: most texts have none, and one quick search tells.
ABOUT_REMOTE, ABOUT_VISA = "(?i)remote|wfh|anywhere|home|virtual", "(?i)sponsor|visa|immigration|relocation|citizenship|1b|authorized|eligible"


def any_of(c: Column, patterns: list[str], ignore_case: bool = True) -> Column:
    """Whether the text holds one of the patterns: tried together, case-sensitive ones by themselves."""
    plain = [p for p in patterns if not p.startswith("(?-i)")]
    exact = [p[5:] for p in patterns if p.startswith("(?-i)")]
    hit = c.rlike(js_regex("|".join(f"(?:{p})" for p in plain), ignore_case))
    for p in exact:
        hit = hit | c.rlike(js_regex(p, ignore_case=False))
    return hit


def one_line(c: Column) -> Column:
    return F.regexp_replace(c, js_regex(r"\s+"), " ")


def without_boilerplate(c: Column) -> Column:
    """The text without phrases that speak of remote work without offering it."""
    for p in P.REMOTE_BOILERPLATE:
        c = F.regexp_replace(c, js_regex(p), " ")
    return c


def states_hybrid_work(c: Column) -> Column:
    """Whether a title or text names hybrid as the way the work is done. Markup is no text."""
    said = one_line(F.replace(F.regexp_replace(text_of(c), "<[^>]*>", " "), F.lit("&nbsp;"), F.lit(" ")))
    return said.rlike(js_regex(r"\bhybrid\b")) & (any_of(said, P.HYBRID_WORK) | any_of(said, P.HYBRID_IN_PLACE, ignore_case=False))


def states_hybrid(title: Column, location: Column, description: Column) -> Column:
    """The word alone in the place, the opening of the title, or wording that names it as the way of work."""
    return text_of(location).rlike(js_regex(r"\bhybrid\b")) | text_of(title).rlike(js_regex(P.TITLE_OPENS_HYBRID)) | states_hybrid_work(title) | states_hybrid_work(description)


def states_remote(title: Column, description: Column) -> Column:
    """Whether a description says that this job is worked remotely, or calls the title's own job remote."""
    said = without_boilerplate(one_line(text_of(description)))
    name = F.lower(F.trim(text_of(title)))
    denied = any_of(said, [P.NOT_REMOTE, P.REMOTE_FIELD_NO, P.OFFICE_DAYS])
    return said.rlike(ABOUT_REMOTE) & ~denied & (any_of(said, P.REMOTE_STATEMENT) | ((F.length(name) > 3) & F.lower(said).contains(F.concat(F.lit("remote "), name))))


def without_nordic_intern(title: Column) -> Column:
    """The title without every 'intern' that means internal: before a noun that is Nordic or Dutch, or in such a title."""
    t = text_of(title)
    word = r"(?=\s+{})"
    noun = rf"(?:{'|'.join(P.NORDIC_NOUNS)})"
    lettered = rf"(?![–—-])[^\s,;:()/|]*[{P.NORDIC_LETTERS}]"
    other = rf"(?!(?:{P.AFTER_INTERN})(?:$|[\s,;:()/|]))[^\s,;:()/|–—-]"
    clear = F.regexp_replace(t, js_regex(rf"\bintern{word.format(f'(?:{noun}|{lettered})')}"), " ")
    by_title = F.regexp_replace(clear, js_regex(rf"\bintern{word.format(other)}"), " ")
    nordic = t.rlike(js_regex(rf"[{P.NORDIC_LETTERS}]|\b(?:{P.NORDIC_WORDS})\b", ignore_case=False))
    return F.when(nordic, by_title).otherwise(clear)


def location_is_worldwide(location: Column) -> Column:
    """Every word is of a work model, and one says worldwide."""
    loc = F.regexp_replace(text_of(location), r"(?i),\s*but\b.*$", "")
    words = F.filter(F.split(F.lower(loc), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.exists(words, lambda w: w.isin(P.WORLDWIDE_WORDS)) & F.forall(words, lambda w: w.isin(P.WORLDWIDE_WORDS + P.WORK_MODEL_WORDS) | w.rlike(r"^\d+$"))


def is_remote(title: Column, location: Column, workplace: Column, description: Column) -> Column:
    """A stated mode decides; then what denies remote work; then title, place and description that offer it."""
    stated = F.lower(text_of(workplace))
    everything = F.concat_ws(" ", text_of(title), text_of(location), without_boilerplate(F.regexp_replace(text_of(description), r"\s+", " ")))
    place = text_of(location)
    return (
        F.when(stated.isin("remote", "fully remote", "fully_remote"), True)
        .when(stated.isin("hybrid", "on-site", "onsite", "in-office"), False)
        .when(states_hybrid(title, location, description) | any_of(everything, P.REMOTE_NO), False)
        .when(any_of(text_of(title), [P.REMOTE_TITLE]), True)
        .when(place.rlike(js_regex(r"\bremote\b")) & ~place.rlike("(?i)hybrid"), True)
        .when(location_is_worldwide(location) | any_of(place, [P.ANYWHERE_PLACE]), True)
        .otherwise(any_of(everything, P.REMOTE_YES))
    )


def is_worldwide(title: Column, location: Column, description: Column, remote: Column) -> Column:
    """Of remote postings: a worldwide place, or no place and a text that says so and names no country."""
    place = F.trim(text_of(location))
    narrow = any_of(text_of(title), P.ONE_COUNTRY) | ((F.length(place) >= 2) & any_of(place, P.ONE_COUNTRY))
    in_one = any_of(place, [r"\banywhere\s+in\b"]) & ~any_of(place, [r"\banywhere\s+in\s+the\s+world\b"])
    here = any_of(text_of(description), [P.PRESENCE]) | any_of(text_of(title), [P.VENUES, P.TRADES, P.TITLE_CITIES])
    return (
        F.when(~F.coalesce(remote, F.lit(False)) | narrow | in_one | here, False)
        .when(location_is_worldwide(place), True)
        .when((F.length(place) < 3) & ~any_of(text_of(description), [*P.COUNTRY_IN_TEXT, P.PRESENCE_DAYS]), any_of(text_of(description), P.WORLDWIDE_YES))
        .otherwise(False)
    )


def visa(description: Column) -> Column:
    """no before yes, else null."""
    return F.when(~description.rlike(ABOUT_VISA), None).when(any_of(description, P.VISA_NO), "no").when(any_of(description, P.VISA_YES), "yes")


def experience_level(title: Column, description: Column) -> Column:
    """Internships first; then titles whose 'executive', 'manager' or 'partner' does own work; then the general words."""
    t, d = text_of(title), text_of(description)
    nordic = without_nordic_intern(t)
    ranked = lambda base: F.when(any_of(t, [P.LEVEL_UP]), "senior").when(any_of(t, [P.LEVEL_DOWN]), "entry").otherwise(base)
    return (
        F.when(any_of(nordic, P.LEVEL_INTERNSHIP), "internship")
        .when(any_of(t, [P.LEVEL_ASSISTANT]), "entry")
        .when(any_of(t, [P.LEVEL_SALES_REP]), ranked("entry"))
        .when(any_of(t, P.LEVEL_OWN_WORK), ranked("mid"))
        .when(any_of(t, P.LEVEL_ENTRY), "entry")
        .when(any_of(t, P.LEVEL_EXECUTIVE), "executive")
        .when(any_of(t, P.LEVEL_SENIOR), "senior")
        .when(any_of(t, P.LEVEL_LEAD), "lead")
        .when(any_of(t, P.LEVEL_MID), "mid")
        .when(any_of(d, P.LEVEL_INTERNSHIP), "internship")
        .when(any_of(d, P.LEVEL_ENTRY), "entry")
    )


def workplace_in_text(title: Column, location: Column, description: Column) -> Column:
    """remote, hybrid or onsite, from what title, place and text say of this job; else null."""
    body = without_boilerplate(text_of(description))
    fields = F.lower(F.concat_ws(" ", *(F.nullif(text_of(c), F.lit("")) for c in (title, location)), F.nullif(body, F.lit(""))))
    hybrid = any_of(fields, P.HYBRID_FOREIGN) | states_hybrid(title, location, body)
    head = F.concat(text_of(title), F.lit(" "), text_of(location))
    remote = head.rlike(js_regex(P.REMOTE_HEAD)) | states_remote(title, description)
    return (
        F.when(text_of(location).rlike(js_regex(P.LOCATION_GLOBAL)), "remote")
        .when((any_of(fields, P.FULL_REMOTE_FOREIGN) | remote) & ~hybrid, "remote")
        .when(hybrid | any_of(fields, [P.OFFICE_MIX, P.OFFICE_DAYS, P.HOME_WORK_FOREIGN]), "hybrid")
        .when(any_of(fields, [P.ONSITE]), "onsite")
    )


def workplace_in_description(title: Column, location: Column, description: Column) -> Column:
    """workplace_in_text for a description that came later: remote only if the head or a strong statement says so."""
    found, body = workplace_in_text(title, location, description), text_of(description)
    head = F.concat(text_of(title), F.lit(" "), text_of(location))
    told = head.rlike(js_regex(P.REMOTE_HEAD)) | text_of(location).rlike(js_regex(P.LOCATION_GLOBAL))
    strong = ~any_of(body, [P.NOT_REMOTE, P.REMOTE_FIELD_NO]) & any_of(body, [*P.FULL_REMOTE_FOREIGN, *P.STRONG_REMOTE])
    return F.when((found != "remote") | told | strong, found)


def classify(title: Column, location: Column, workplace: Column, description: Column) -> Column:
    """One struct of all labels."""
    remote = is_remote(title, location, workplace, description)
    return F.struct(remote.alias("is_remote"), is_worldwide(title, location, description, remote).alias("remote_worldwide"), visa(description).alias("visa_sponsorship"), experience_level(title, description).alias("experience_level"))
