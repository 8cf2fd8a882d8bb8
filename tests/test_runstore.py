"""Snapshots of audit runs."""

import pytest
from pyspark.sql import functions as F

from stationproof.sources.runstore import RunStore, Stale


def tables(spark, run, n, at):
    rows = spark.range(n).select(
        F.concat(F.lit("s"), F.col("id") % 2).alias("station_id"), F.lit("p").alias("parameter"),
        F.expr("timestamp_ntz'2024-01-01 06:00:00' + make_interval(0, 0, 0, cast(id % 10 as int))").alias("timestamp_utc"), F.lit("R01").alias("reason_code"),
    )
    meta = spark.sql(f"SELECT {n}L AS n_rows, timestamp_ntz'{at}' AS generated_at")
    return {"runs": meta, "defects": rows, "coverage_facts": rows.select("station_id", "parameter").distinct()}


def test_readers_see_whole_runs_only(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "runs"))
    assert store.version() == 0 and store.manifest() == {}
    with pytest.raises(KeyError):
        store.runs()
    store.commit("ar_b", tables(spark, "ar_b", 40, "2024-02-01 00:00:00"))
    before = store.version()
    # what a loader wrote before it failed is in no manifest
    tables(spark, "x", 99, "2024-02-01 00:00:00")["defects"].write.parquet(str(tmp_path / "runs/data/defects/left"))
    assert store.table("defects").count() == 40
    store.commit("ar_a", tables(spark, "ar_a", 10, "2024-02-02 00:00:00"))
    assert store.latest_run().first().audit_run_id == "ar_a"
    assert [r.audit_run_id for r in store.page(5).collect()] == ["ar_a", "ar_b"]
    assert [r.audit_run_id for r in store.page(5, after="ar_a").collect()] == ["ar_b"]
    assert [r.audit_run_id for r in store.recent().collect()] == ["ar_a", "ar_b"]
    assert store.run_defects("ar_b").count() == 40 and store.run_coverage_facts("ar_a").count() == 2
    assert store.table("defects", version=before).count() == 40


def test_a_second_loader_is_refused(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "runs"))
    since = store.version()
    store.commit("ar_a", tables(spark, "ar_a", 10, "2024-02-01 00:00:00"), since)
    with pytest.raises(Stale):
        store.commit("ar_b", tables(spark, "ar_b", 10, "2024-02-01 00:00:00"), since)
    assert store.table("defects").count() == 10
    store.commit("ar_a", tables(spark, "ar_a", 6, "2024-02-03 00:00:00"))
    assert store.table("defects").count() == 6 and store.runs().count() == 1


def test_days_are_pruned(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "runs"))
    store.commit("ar_a", tables(spark, "ar_a", 100, "2024-02-01 00:00:00"))
    some = store.table("defects", days=("2024-01-03", "2024-01-04"))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and some.count() == 20
    assert len(some.inputFiles()) > 2 and {r.d.isoformat() for r in some.select(F.col("day").alias("d")).distinct().collect()} == {"2024-01-03", "2024-01-04"}
