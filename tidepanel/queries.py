"""All registered queries of the library itself."""

from __future__ import annotations

from tidepanel.plans import audits, chains, cross, features, research, studies, trading  # noqa: F401
from tidepanel.registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
