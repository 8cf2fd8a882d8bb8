"""Views over test tables, the query catalogue and the SQL twins."""

import importlib

FAMILIES = ("q_audit", "q_trust", "q_graph", "q_models", "q_ops", "q_learn")


def load():
    """Import every query family and return the filled catalogue."""
    for name in FAMILIES:
        importlib.import_module(f"stationproof.plans.{name}")
    return importlib.import_module("stationproof.plans.catalog")
