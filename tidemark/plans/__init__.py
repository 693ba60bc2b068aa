"""Registered queries, grouped by the part of the library they exercise."""

import importlib

from tidemark.plans.registry import ORACLES, QUERIES

GROUPS = (
    "timetravel", "features", "scoring", "decisions", "probability", "metrics", "fitting", "models", "relational", "identity",
    "sources",
)


def all_queries():
    for group in GROUPS:
        importlib.import_module(f"tidemark.plans.q_{group}")
    return dict(QUERIES), dict(ORACLES)
