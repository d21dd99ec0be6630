"""Imports every query module so that its ``@query`` registrations run."""

from __future__ import annotations

import importlib

MODULES = [
    "tablesight.plans.flagship",
    "tablesight.plans.q_grouped",
    "tablesight.plans.q_profile",
    "tablesight.plans.q_ordered",
    "tablesight.plans.q_clean",
    "tablesight.plans.q_text",
    "tablesight.plans.q_charts",
    "tablesight.plans.q_packs",
    "tablesight.plans.q_ml",
    "tablesight.plans.q_sources",
    "tablesight.plans.q_streaming",
    "tablesight.plans.q_misc",
]


def load():
    from tablesight.plans.registry import ORACLE, QUERIES
    for m in MODULES:
        importlib.import_module(m)
    return QUERIES, ORACLE
