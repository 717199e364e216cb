"""Named queries: what they cover in the operator inventory, how Spark runs them, and SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from .tables import AS_OF, COMPANIES, JOBS, POSTINGS, Tables


@dataclass(frozen=True)
class Query:
    name: str
    rows: str
    run: Callable
    sql: str | None


FOUND: dict[str, Query] = {}


def query(name: str, rows: str, sql: str | None = None):
    """Register run(tables). In sql, {jobs}, {postings}, {companies} and {as_of} stand for the shared views."""

    def held(run: Callable[[Tables], object]):
        said = sql and sql.replace("{jobs}", JOBS).replace("{postings}", POSTINGS).replace("{companies}", COMPANIES).replace("{as_of}", AS_OF)
        FOUND[name] = Query(name, rows, lambda spark, sf_dir: run(Tables(spark, sf_dir)), said)
        return run

    return held
