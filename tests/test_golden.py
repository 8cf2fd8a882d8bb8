"""Planted faults must be recovered exactly, and clean data must stay clean."""

from pyspark.sql import functions as F

from stationproof.operators import audit, coverage, detectors
from tests.corpus import golden

EXPECTED = {
    "R01": 17, "R02": 1, "R03": 2, "R07": 3, "R08": 2, "R09": 4, "R10": 336, "R11": 8,
    "R12": 336, "R13": 336, "R14": 1, "R18": 1, "R19": 2,
}


def test_ledger_recovery(spark):
    r = golden(spark).cache()
    out = audit.run_audit(r)
    codes = {x.key: x.n_flags for x in out["breakdowns"].where("dimension = 'code'").collect()}
    assert codes == EXPECTED
    rate = out["defect_rate"].first()
    assert (rate.n_defective_cells, rate.n_covered_cells) == (1045, 7056)
    assert round(100 * rate.n_defective_cells / rate.n_covered_cells, 4) == 14.8101
    c = out["coverage"].first()
    assert (c.n_observed_cells, c.n_absent_cells, c.n_excluded_cells, c.n_expected_cells) == (7039, 17, 1008, 8064)
    assert r.count() == 7041
    step = out["defects"].where("reason_code = 'R14'").first()
    assert (step.station_id, step.parameter, str(step.timestamp_utc)) == ("STA-02", "NO", "2026-05-08 00:00:00")
    assert step.evidence["signed_magnitude"] == "15.0"
    top = out["notable_events"].orderBy("rank").first()
    assert top.category == "physical_exceedance" and "exceeds the physical maximum for PM10" in top.headline
    assert out["network_wide"].count() == 0
    assert audit.rate_violations(out["defect_rate"]).count() == 0


def test_clean_corpus_has_no_flags(spark):
    r = golden(spark, inject=False, hours=96)
    assert detectors.run_all(coverage.build(r)).count() == 0


def test_coverage_identity(spark):
    c = coverage.build(golden(spark))
    t = coverage.totals(c, coverage.structural_absences(c.readings, c.series, c.n_rows)).first()
    assert t.n_observed_cells + t.n_absent_cells == t.n_covered_cells


def test_audit_is_deterministic(spark):
    def run():
        d = detectors.run_all(coverage.build(golden(spark)))
        return sorted(map(str, d.select("station_id", "parameter", "timestamp_utc", "reason_code", F.to_json("evidence")).collect()))

    assert run() == run()
