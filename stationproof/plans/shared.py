"""Stored inputs of the read, trust, graph and operations queries.

These operators start from an audit that has already been loaded. The audit is therefore run
and written once per session and data set; the queries of the audit itself never use this.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from stationproof.functions.state import cut
from stationproof.operators import canonical, coverage, detectors
from stationproof.operators.coverage import Coverage
from stationproof.plans import views

_STORES: dict[tuple[str, str], "Store"] = {}


class Store(NamedTuple):
    readings: DataFrame
    cov: Coverage
    defects: DataFrame


def store(spark: SparkSession, sf: str) -> Store:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _STORES:
        views.prepare(spark)
        r = cut(canonical.add_row_hash(views.readings(spark, sf)))
        cov = coverage.build(r, keep=False)
        cov = cov._replace(gap_ranges=cut(cov.gap_ranges))
        d = cut(detectors.run_all(cov, unit_rules=views.UNIT_RULES, floors=views.FLOORS))
        _STORES[key] = Store(r, cov, d)
    return _STORES[key]
