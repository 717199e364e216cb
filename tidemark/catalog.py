"""Every named query of the engine with its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from . import registry
from .functions import queries as _functions  # noqa: F401
from .operators import aggregates, boards, joins, merging, windows  # noqa: F401
from .plans import queries as _plans  # noqa: F401
from .sources import paged as _paged  # noqa: F401
from .sources import queries as _sources  # noqa: F401
from .streaming import queries as _streaming  # noqa: F401

FLAGSHIP = "search_jobs"


def queries() -> dict[str, Callable]:
    return {k: q.run for k, q in registry.FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q.sql for k, q in registry.FOUND.items() if q.sql}
