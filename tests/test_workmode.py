"""Work-mode wording on accepting and rejecting texts, and the pattern tables against Python's own engine."""

import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions import classify, labels, patterns

HYBRID = [
    "This is a hybrid role based in our Austin office.", "We offer a hybrid work model with two days in office.", "Hybrid (3 days in office)", "Hybrid, 2 days a week in Denver",
    "Location: Hybrid", "Workplace type - Hybrid", "Senior Analyst - Hybrid", "Senior Analyst (Hybrid)", "This position can be remote or hybrid.", "On-site, hybrid or remote",
    "The role is hybrid, with Tuesdays in the office.", "Hybrid in Austin, TX", "Hybrid Remote", "hybrid-remote schedule", "#LI-Hybrid", "Our hybrid environment allows balance.",
    "Work modality: Hybrid", "Work Model Hybrid Background Check", "Arbeitsmodell: Hybrid", "WORK MODE: • Hybrid/Split", "a dynamic, hybrid-friendly culture", "This role is categorized as hybrid.",
    "#LI-SA1 #Hybrid", "a hybrid home/office workplace", "Telework Type: Hybrid", "Remote Position: Hybrid Region: Asia", "Karlsruhe oder London, Hybrid Über uns", "Spring internships will be hybrid.",
    "Location: Vadodara (Client office, Hybrid)", "<p>Location:</strong> London | <strong>Work Model:</strong> Hybrid</span></p>", "working hybrid from our (Irvine) Office", "Therapist - Hybrid Forest Hills- Full Time",
]
NOT_HYBRID = [
    "Designing hybrid cloud and multi-cloud architectures.", "remote and hybrid cloud deployments", "We build hybrid and multi-cloud environments.", "hybrid vehicles and battery systems",
    "Git-based, wiki, or hybrid.", "hybrid mobile apps", "Run workloads hybrid in the cloud", "Agile, Waterfall, or hybrid delivery methodologies", "cloud or hybrid infrastructure, 5G", "virtual and hybrid formats",
    "a hybrid leadership role", "hybrid retrieval architectures", "online or hybrid instruction", "Hybrid Theatre perform a range", "virtual, and hybrid schools", "a nine-passenger, hybrid-electric aircraft", "hybrid bonding, and 3D integration",
    "working a hybrid list of accounts", "The Data Scientist will be a hybrid professional", "waterfall, hybrid, and agile methodologies", "cloud, hybrid, and on-prem environments", "nothing of the kind", "",
]


def test_hybrid_wording(spark):
    rows = spark.createDataFrame([(t, True) for t in HYBRID] + [(t, False) for t in NOT_HYBRID], "text string, want boolean")
    wrong = rows.filter(classify.states_hybrid_work(F.col("text")) != F.col("want")).collect()
    assert [r.text for r in wrong] == []


@pytest.mark.parametrize("name", [k for k in dir(patterns) if isinstance(getattr(patterns, k), list) and k.isupper() and getattr(patterns, k) and "\\" in "".join(getattr(patterns, k)) and k != "NORDIC_NOUNS"])
def test_tables_read_like_ascii_regexes(spark, name):
    """Java's reading of each translated pattern against Python's, on wordings around each of the tables."""
    texts = [*HYBRID, *NOT_HYBRID, "fully remote", "not a remote job", "Remote - Global", "we sponsor H1B, no visa", "junior engineer II", "Director of X", "co-op 2 years", "éremote ré", "naïve on-site", "work from home fridays", "Mon-Thu in office", "US only", "the us", "SUS", "x_us"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for p in getattr(patterns, name):
        exact = p.startswith("(?-i)")
        p = p.removeprefix("(?-i)")
        told = [r[0] for r in rows.select(F.col("t").rlike(labels.js_regex(p, ignore_case=not exact and name != "HYBRID_IN_PLACE"))).collect()]
        flags = 0 if exact or name == "HYBRID_IN_PLACE" else re.I
        try:
            own = re.compile(p.replace(r"\s", r"[\s]" if False else r"\s").replace(r"\b", r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"), flags)
        except re.error:  # look-behinds of several widths
            own = pytest.importorskip("regex").compile(p, flags | re.A)
        assert told == [bool(own.search(t)) for t in texts], p


def test_boundaries_look_at_the_right_side():
    assert labels.js_regex(r"\bfoo\b[^x]") == f"(?iu){labels.OPENS}foo{labels.CLOSES}[^x]"
    assert labels.js_regex(r"\b(?:if|this)\b(?:x|$)") == f"(?iu){labels.OPENS}(?:if|this){labels.BOUNDARY}(?:x|\\z)"
    assert labels.js_regex(r"days?\b|\b(?:a|)b") == f"(?iu)days?{labels.BOUNDARY}|{labels.BOUNDARY}(?:a|)b"
