import pytest

from tidemark.functions.dates import posted_window
from tidemark.plans.search import Group, SearchRequest, interleave, leading_int, listed, parse_element, where


@pytest.mark.parametrize(
    "text, groups",
    [
        ("Austin, United States", [Group(("Austin",), ("us",))]),
        ("United States, Nashville, New Orleans", [Group(("Nashville", "New Orleans"), ("us",))]),
        ("Berlin, Hamburg, Germany", [Group(("Berlin", "Hamburg"), ("de",))]),
        ("United States, Canada", [Group((), ("us",)), Group((), ("ca",))]),
        ("Canada, Austin, United States", [Group((), ("ca",)), Group(("Austin",), ("us",))]),
        ("Springfield", [Group(("Springfield",), ())]),
        ("Georgia, United States", [Group(("Georgia",), ("us",))]),
        ("Georgia", [Group((), ("ge",)), Group(("Georgia",), ())]),
        ("Georgia, Nigeria", [Group((), ("ge",)), Group(("Georgia",), ("ng",))]),
        ("Austin, Paris|France, Rome", [Group(("Austin",), ()), Group(("Paris",), ("fr",)), Group(("Rome",), ())]),
        ("", []),
    ],
)
def test_location_groups(spark, text, groups):
    assert parse_element(text) == groups


def test_request_values():
    assert listed("a, B, b,,A ") == ["a", "B"]
    assert leading_int("85k") == 85 and leading_int("x") is None and leading_int(None) is None
    assert [posted_window(v) and posted_window(v).seconds for v in ("last_24h", "7d", "7 days", "past-week", "3 fortnights", "", None)] == [86400, 604800, 604800, 604800, None, None, None]


def test_pages_of_roles_agree(spark):
    rows = spark.createDataFrame([(i, f"{'red' if i % 2 else 'blue'} bolt {i % 7}", f"https://x.org/{i % 50}/", f"2024-01-{i % 28 + 1:02d}") for i in range(200)], "id long, title string, link string, first_seen_at string")
    whole = interleave(rows, ["red", "blue"], 20).orderBy("place").collect()
    assert len({r.id for r in whole}) == 20 and {r.role for r in whole} == {0, 1}
    parts = [interleave(rows, ["red", "blue"], 10, k).orderBy("place").collect() for k in (0, 10)]
    assert [r.id for p in parts for r in p] == [r.id for r in whole]


def test_filters_narrow(spark):
    from pyspark.sql import functions as F

    from tidemark.tables import Tables

    jobs = Tables(spark, "/root/testdata/sf0.001").postings
    at = F.expr("TIMESTAMP_NTZ '2001-08-02 00:00:00'")
    every = {r.id for r in where(jobs, SearchRequest(), at).select("id").collect()}
    for request in (SearchRequest(work_mode="remote"), SearchRequest(posted="1y"), SearchRequest(employment_type="fulltime"), SearchRequest(salary_min="100000")):
        assert {r.id for r in where(jobs, request, at).select("id").collect()} <= every
