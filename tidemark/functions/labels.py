"""Label rules as data: ordered (label, pattern) pairs, compiled to one CASE; the same pairs run on the driver."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

LATIN = "A-Za-z0-9_"


SPACES = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
OPENS, CLOSES = f"(?<![{LATIN}])", f"(?![{LATIN}])"
BOUNDARY = f"(?:{OPENS}(?=[{LATIN}])|(?<=[{LATIN}]){CLOSES})"


def begins_word(pattern: str, i: int) -> bool:
    """Whether all that the pattern can match from place i begins with an ASCII word character."""
    if pattern.startswith("(?:", i):
        at, depth, alternatives = i + 3, 1, [i + 3]
        while depth:
            c = pattern[at]
            at += 2 if c == "\\" else len(re.match(r"\[(?:\\.|[^\]\\])*\]", pattern[at:])[0]) if c == "[" else 1
            depth += (c == "(") - (c == ")")
            if c == "|" and depth == 1:
                alternatives.append(at)
        return pattern[at : at + 1] not in ("?", "*") and all(begins_word(pattern, k) for k in alternatives)
    one = re.match(r"(?:[A-Za-z0-9_]|\\[wd]|\[(?:[A-Za-z0-9_]|(?<=\w)-(?=\w))+\])(?![?*]|\{0)", pattern[i:])
    return bool(one)


def js_regex(pattern: str, ignore_case: bool = True) -> str:
    r"""A Java pattern that reads \b, \s and $ as ECMAScript does: ASCII words, Unicode spaces, the very end.

    A boundary after a word character closes a word, and one before what begins with a word character opens one; there one
    side is looked at. Elsewhere both are.
    """
    out, after_word, in_class = [], False, False
    for m in re.finditer(r"\\.|\(\?(?:[:=!]|<[=!])|.", pattern, re.S):
        piece, end = m[0], m.end()
        quantified = re.match(r"[?*]|\{0", pattern[end:])
        if in_class:
            out.append(SPACES if piece == r"\s" else r"\[" if piece == "[" else piece)
            in_class = piece != "]"
            after_word = False
            continue
        if piece == r"\b":
            out.append(CLOSES if after_word else OPENS if begins_word(pattern, end) else BOUNDARY)
            continue
        out.append(f"[{SPACES}]" if piece == r"\s" else r"\z" if piece == "$" else piece)
        in_class = piece == "["
        if piece != "+":  # a character that is there once or more stays what it is
            after_word = bool(re.fullmatch(r"[A-Za-z0-9_]|\\[wd]", piece)) and not quantified
    return ("(?iu)" if ignore_case else "") + "".join(out)


def first_rule(text: Column, rules: list[tuple[str, str]], otherwise: str | None = None) -> Column:
    """The label of the first pattern that the text holds."""
    out = None
    for label, pattern in rules:
        hit = text.rlike(js_regex(pattern))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(otherwise)


def rule_of(text: str | None, rules: list[tuple[str, str]], otherwise: str | None = None) -> str | None:
    return next((label for label, p in rules if re.search(p, text or "", re.I | re.A)), otherwise)


# Role labels by pattern, the first that matches wins.
ROLES = [
    ("Software Engineer", r"software engineer|software developer"),
    ("Frontend Developer", r"frontend|front-end|front end"),
    ("Backend Developer", r"backend|back-end|back end"),
    ("Fullstack Developer", r"full stack|fullstack"),
    ("Data Scientist", r"data scientist"),
    ("Data Analyst", r"data analyst"),
    ("Data Engineer", r"data engineer"),
    ("ML / AI Engineer", r"machine learning|ML engineer|AI engineer"),
    ("Product Manager", r"product manager"),
    ("Project Manager", r"project manager"),
    ("Product Designer", r"product designer|UX designer|UI designer"),
    ("DevOps / SRE", r"devops|site reliability|SRE"),
    ("QA Engineer", r"QA|quality assurance|test engineer"),
    ("Mobile Developer", r"mobile|iOS|android"),
    ("Marketing", r"marketing"),
    ("Sales", r"sales|account executive|business development"),
    ("Customer Support", r"customer success|customer support"),
    ("Security Engineer", r"security|cybersecurity"),
    ("Cloud / Infrastructure", r"cloud|infrastructure"),
    ("Technical Writer", r"technical writer|content writer"),
    ("Recruiter", r"recruiter|talent"),
    ("Finance", r"finance|accountant|financial"),
    ("Human Resources", r"human resources|HR "),
]
# Employment types by pattern; kinds of stay win over full and part time, and foreign spellings over "temp".
EMPLOYMENT = [
    ("Full-time", r"\btemps plein\b"),
    ("Part-time", r"\btemps partiel\b"),
    ("Internship", r"\bintern(ship)?\b|\bstagiaire\b|\bpracticante\b"),
    ("Volunteer", r"\bvolunteer\b|\bvoluntario\b"),
    ("Temporary", r"\btemp(orary)?\b|\bseasonal\b|\bfixed[\s-]?term\b|\binterim\b|\bcasual\b|\bprn\b|\bper[\s-]?diem\b"),
    ("Contract", r"\bcontract(or|ed)?\b|\bfreelance\b|\b1099\b|\bconsultant\b|\bb2b\b|\bcontrato\b"),
    ("Part-time", r"\bpart[\s-]?time\b|\bparttime\b|\bmoonlight(er)?\b|\bmedio tiempo\b|\btiempo parcial\b|\bteilzeit\b"),
    ("Full-time", r"\bfull[\s-]?time\b|\bfulltime\b|\bpermanent\b|\bregular\b|\btiempo completo\b|\bvollzeit\b"),
]
EMPLOYMENT_IN_TEXT = [
    ("Full-time", r"\bfull[\s-]?time\b"),
    ("Part-time", r"\bpart[\s-]?time\b"),
    ("Contract", r"\bcontract(?:or)?\b|\bfreelance\b|\b1099\b"),
    ("Internship", r"\binternship\b|\bintern\b"),
    ("Temporary", r"\btemporary\b|\btemp\b"),
]
# Work modes by pattern, hybrid before remote.
WORKPLACE = [("Hybrid", r"\bhybrid\b"), ("Remote", r"\bremote\b|\bwork from home\b|\bwfh\b"), ("Onsite", r"\bon ?site\b|\bin office\b|\bin person\b|\boffice\b")]
INTERVALS = [
    ("semimonthly", r"\b(semimonthly|semi-monthly)\b"),
    ("biweekly", r"\b(biweekly|bi-weekly|fortnight)"),
    ("yearly", r"\b(year|yearly|annual|annually|annum|yr|per-year|salary)\b"),
    ("monthly", r"\b(month|monthly|per-month|mo)\b"),
    ("semimonthly", r"\btwice[-\s]?monthly\b"),
    ("weekly", r"\b(week|weekly|per-week|wk)\b"),
    ("daily", r"\b(day|daily|per-day|diem)\b"),
    ("hourly", r"\b(hour|hourly|per-hour|hr|wage)\b"),
]


def role_category(title: Column) -> Column:
    return first_rule(F.coalesce(title, F.lit("")), ROLES, "Other")


def employment_type(raw: Column) -> Column:
    """Canonical, or null where the spelling says nothing known."""
    return first_rule(F.regexp_replace(F.replace(F.lower(raw), F.lit("&amp;"), F.lit("&")), "[_/]+", " "), EMPLOYMENT)


def normalize_employment_type(raw: str | None) -> str | None:
    return rule_of(re.sub("[_/]+", " ", (raw or "").lower().replace("&amp;", "&")), EMPLOYMENT)


def employment_in_text(title: Column, description: Column) -> Column:
    return first_rule(F.concat_ws(" ", title, description), EMPLOYMENT_IN_TEXT)


def workplace_type(raw: Column) -> Column:
    return first_rule(F.regexp_replace(raw, r"[_\-\s]+", " "), WORKPLACE)


def salary_interval(raw: Column) -> Column:
    return first_rule(F.lower(F.trim(raw)), INTERVALS)


# Per interval, periods a year and the most that is credible.
PER_YEAR = {"yearly": (1, 10_000_000), "monthly": (12, 125_000), "semimonthly": (24, 60_000), "biweekly": (26, 50_000), "weekly": (52, 25_000), "daily": (260, 10_000), "hourly": (2080, 1_500)}


def annual_salary(amount: Column, interval: Column) -> Column:
    """Whole units a year; null where amount or interval are unreadable, not positive, or not credible."""
    n = F.regexp_replace(amount, "[, ]", "").try_cast("double")
    kind = salary_interval(interval)
    times = F.create_map(*(F.lit(x) for k, (t, _) in PER_YEAR.items() for x in (k, t)))[kind]
    most = F.create_map(*(F.lit(x) for k, (_, m) in PER_YEAR.items() for x in (k, m)))[kind]
    year = n * times
    return F.when((n > 0) & (n <= most) & (year <= 100_000_000), F.round(year).cast("long"))


# Intervals by words anywhere in the spelling, in their order.
LOOSE_INTERVALS = [
    ("semimonthly", "semimonthly|semi-monthly"),
    ("biweekly", "biweekly|bi-weekly|fortnight"),
    ("yearly", "year|yearly|annual|annually|annum|yr|per-year|salary"),
    ("monthly", "month|monthly|per-month|mo"),
    ("weekly", "week|weekly|per-week|wk"),
    ("daily", "day|daily|per-day|diem"),
    ("hourly", "hour|hourly|per-hour|hr|wage"),
]


def loose_annual_salary(amount: Column, interval: Column) -> Column:
    """annual_salary as the stored procedure has it: words count inside others, amounts with commas do not, and an interval
    whose amount is not credible gives way to the next that the spelling holds."""
    n = F.when(amount.rlike(r"^[0-9]+([.][0-9]+)?$"), amount.cast("double"))
    out = F.lit(None).cast("long")
    for name, words in reversed(LOOSE_INTERVALS):
        times, most = PER_YEAR[name]
        out = F.when(interval.rlike(f"(?i){words}") & (n > 0) & (n <= most), F.round(n * times).cast("long")).otherwise(out)
    return out
