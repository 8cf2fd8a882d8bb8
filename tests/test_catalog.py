"""Cheap whole-catalogue checks; the full comparison is `python -m tests.compare <dir>`."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "f2_row_hash", "f5_checksum", "v2_series_grid", "v7_structural_absence", "d13_step_change", "d16_all_detectors",
    "a1_defect_rate", "c6_repair_summary", "e6_nearest_points", "t9_trust_score", "g14_verdicts", "m14_conformal_quantile",
    "l1_residual_features", "o6_alerts", "q8_quality_summary", "k7_verification_hash", "x3_explanation_routing",
]


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_twin_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_twin(spark, name):
    ok, message = compare(spark, connect(SF), name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert ok, message
