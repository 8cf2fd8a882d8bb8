"""Scans over blocks must equal scans over whole series, however small or uneven the blocks."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from stationproof import config as C
from stationproof.functions import scan
from stationproof.operators import counters, coverage, detectors, fault
from stationproof.plans import views

SF = "/root/testdata/sf0.001"


@pytest.fixture
def rows(spark):
    """One long series, a third of it at one single instant, next to short ones."""
    rnd = random.Random(5)
    data, seq = [], 0
    for key, n in (("hot", 900), ("a", 40), ("b", 3), ("c", 1)):
        for i in range(n):
            hour = 700 if key == "hot" and i % 3 == 0 else rnd.randrange(0, 1400)
            data.append((key, hour * 3600, seq, float(rnd.randrange(-50, 50))))
            seq += 1
    df = spark.createDataFrame(data, "k string, s long, ingest_seq long, x double")
    return df.withColumn("timestamp_utc", F.timestamp_seconds("s").cast("timestamp_ntz"))


@pytest.mark.parametrize("target", [7, 50, 400])
def test_blocked_scan_equals_plain_scan(rows, target):
    order = ["timestamp_utc", "ingest_seq"]
    x = F.col("x")
    cols = dict(lags={"l": x}, sums={"t": x}, maxs={"m": x}, mins={"n": x})
    plain = scan.ordered_scan(rows, ["k"], order, **cols)
    blocked = scan.assign_blocks(rows, ["k"], target=target)
    assert scan.BLK in blocked.columns
    got = scan.drop_blocks(scan.ordered_scan(blocked, ["k"], order, **cols))
    assert sorted(map(str, got.select(plain.columns).collect())) == sorted(map(str, plain.collect()))
    blocks = blocked.groupBy("k", scan.BLK).count()
    assert blocks.agg(F.max("count")).first()[0] <= 5 * target
    assert blocks.where("k = 'hot'").count() <= 3 * -(-900 // target)


def blocks_of(df, target):
    b = scan.assign_blocks(df, ["k"], target=target).groupBy("k", scan.BLK).count().agg(F.count("*").alias("n"), F.max("count").alias("most")).first()
    return b.n, b.most


@pytest.mark.parametrize("shape", ["one_day", "sparse_sequence", "one_instant"])
def test_blocks_stay_few_and_even(spark, shape):
    n, target = 20_000, 1000
    us, seq = {
        "one_day": ("id * 1000000 div 3", "id"),
        "sparse_sequence": ("id * 3600000000", "id * 8589934592"),
        "one_instant": ("if(id % 3 = 0, 5000, id) * 1000000", "id * 8589934592"),
    }[shape]
    df = spark.range(n).selectExpr("'hot' AS k", f"cast(timestamp_micros({us}) AS timestamp_ntz) AS timestamp_utc", f"{seq} AS ingest_seq")
    number, most = blocks_of(df, target)
    assert number <= 3 * n // target and most <= 3 * target
    got = scan.assign_seq_blocks(df, ["k"], target=target).groupBy(scan.BLK).count().agg(F.count("*").alias("n"), F.max("count").alias("most")).first()
    assert got.n <= 3 * n // target and got.most <= 3 * target


def test_running_sum_of_nulls_and_zero_sums(spark):
    rows = [("h", i, v) for i, v in enumerate([None, None, 1.0, -1.0] + [None] * 20 + [2.0, -2.0] + [None] * 10)]
    df = spark.createDataFrame(rows, "k string, ingest_seq long, x double").withColumn("timestamp_utc", F.timestamp_seconds("ingest_seq").cast("timestamp_ntz"))
    plain = scan.ordered_scan(df, ["k"], ["ingest_seq"], sums={"t": F.col("x")})
    blocked = scan.drop_blocks(scan.ordered_scan(scan.assign_blocks(df, ["k"], target=4), ["k"], ["ingest_seq"], sums={"t": F.col("x")}))
    assert sorted(map(str, blocked.select(plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_instants_within_one_second_all_count(spark):
    df = spark.range(3).selectExpr("'a' AS station_id", "'p' AS parameter", "cast(timestamp_micros(id * 1000) AS timestamp_ntz) AS timestamp_utc", "1D AS value", "'u' AS unit", "id AS ingest_seq")
    row = coverage.series_grid(df).first()
    assert row.n_observed == 3 and row.cadence_s == C.DEFAULT_CADENCE_S


def test_blocks_in_delivered_order(rows):
    plain = scan.ordered_scan(rows, ["k"], ["ingest_seq"], maxs={"m": F.col("s")})
    blocked = scan.assign_seq_blocks(rows, ["k"], target=30)
    got = scan.drop_blocks(scan.ordered_scan(blocked, ["k"], ["ingest_seq"], maxs={"m": F.col("s")}))
    assert sorted(map(str, got.select(plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_exact_median_and_order_statistics(spark):
    rnd = random.Random(3)
    data = [("a", rnd.gauss(0, 1)) for _ in range(30001)] + [("a", 0.25)] * 15000 + [("b", 1.0), ("b", 4.0)]
    df = spark.createDataFrame(data, "k string, v double")
    got = {r.k: r.m for r in scan.exact_median(df, ["k"], "v", "m").collect()}
    for k in ("a", "b"):
        assert got[k] == statistics.median(v for kk, v in data if kk == k)
    n = sum(1 for k, _ in data if k == "a")
    nth = scan.order_statistics(df, ["k"], "v", {"q": F.ceil(F.col("_n") * 0.9)}).where("k = 'a'").first().q
    assert nth == sorted(v for k, v in data if k == "a")[-(-n * 9 // 10) - 1]


def test_ranks_by_counting_rounds_are_exact(spark, monkeypatch):
    """Outliers, ties over most of a group, extremes, missing values and ranks outside the group."""
    rnd = random.Random(8)
    data = {
        "ties": [0.25] * 3000 + [rnd.random() for _ in range(500)],
        "wide": [rnd.choice([-1, 1]) * 10 ** rnd.uniform(-300, 300) for _ in range(900)] + [float("inf"), -float("inf"), 1.7e308, -1.7e308, 0.0],
        "same": [7.0] * 800,
        "small": [3.0, 1.0, 2.0],
        "none": [None, float("nan")],
    }
    rows = [(k, v) for k, vs in data.items() for v in vs] + [("ties", None), ("ties", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    n = F.col("_n")
    ranks = {"first": F.lit(1), "mid": F.floor((n + 1) / 2), "q9": F.ceil(n * 0.9), "last": n, "over": n + 1}

    def wanted(vs):
        vs = sorted(v for v in vs if v is not None and v == v)
        return (len(vs), vs[0], vs[(len(vs) + 1) // 2 - 1], vs[-(-len(vs) * 9 // 10) - 1], vs[-1], None)

    truth = {k: wanted(vs) for k, vs in data.items() if k != "none"}
    everything = [v for vs in data.values() for v in vs]
    for held in (200_000, 40):
        monkeypatch.setattr(scan, "HELD_ROWS", held)
        monkeypatch.setattr(scan, "PARTS", 256)
        got = {r[0]: tuple(r)[1:] for r in scan.order_statistics(df, ["k"], "v", ranks).collect()}
        assert got == truth
        assert tuple(scan.order_statistics(df.where("k <> 'ties' OR v > 0"), [], "v", ranks).first()) == wanted(everything)


def test_a_hot_group_is_never_ordered_whole(spark, monkeypatch):
    monkeypatch.setattr(scan, "HELD_ROWS", 1000)
    df = spark.range(60_000).selectExpr("if(id % 50 = 0, id div 50 % 7, 7) AS k", "if(id % 3 = 0, 5.0D, id / 7.0D) AS v")
    made = scan.exact_median(df, ["k"], "v", "m")
    values = {}
    for r in df.collect():
        values.setdefault(r.k, []).append(r.v)
    assert {r.k: r.m for r in made.collect()} == {k: statistics.median(v) for k, v in values.items()}


@pytest.mark.parametrize("target", [40, 300])
def test_rank_agreement_by_counts_equals_windows(spark, target):
    from stationproof.operators import trust

    readings = views.readings(spark, "/root/testdata/sf0.01").cache()
    cov = coverage.build(readings)
    c = trust.clock(cov.series)
    plain = trust.rank_agreement(readings, cov.series, c, at_most=cov.n_rows)
    counted = trust.rank_agreement(readings, cov.series, c, target=target)
    key = lambda df: {tuple(r)[:4]: round(r.rho, 9) for r in df.collect()}
    assert key(plain) == key(counted) and len(key(plain)) > 50


def test_rolling_across_blocks(rows):
    from pyspark.sql import Window as W

    r = scan.ordered_scan(rows, ["k"], ["timestamp_utc", "ingest_seq"], sums={"rn": F.lit(1).cast("long")})
    w = lambda p: W.partitionBy(*p).orderBy("rn").rowsBetween(-23, 0)
    plain = r.withColumn("a", F.sum("x").over(w(["k"])))
    cut, part = scan.rolling_frame(r, ["k"], "rn", 24, target=60)
    got = cut.withColumn("a", F.sum("x").over(w(part))).where("NOT _halo").select(plain.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))


def test_detectors_do_not_depend_on_blocks(spark, monkeypatch):
    r = views.readings(spark, SF).cache()

    def flags(n):
        cov = coverage.build(r)
        d = detectors.run_all(cov, unit_rules=views.UNIT_RULES, floors=views.FLOORS)
        out = d.select("station_id", "parameter", "timestamp_utc", "reason_code", F.round("rank_value", 6).alias("v"))
        return sorted(map(str, out.collect()))

    whole = flags(None)
    monkeypatch.setattr(scan, "BLOCK_ROWS", 4)
    assert flags(4) == whole


def test_counters_and_features_do_not_depend_on_blocks(spark, monkeypatch):
    c = views.counters(spark, SF).cache()
    res = views.readings(spark, SF).where("value IS NOT NULL").groupBy("station_id", "parameter", "timestamp_utc").agg(F.avg("value").alias("actual"))
    res = res.withColumn("residual", F.col("actual") - 10).cache()

    def run():
        a = sorted(map(str, counters.repair_summary(c, 86400).collect()))
        x = fault.residual_features(res)
        b = sorted(map(str, x.select("station_id", "parameter", "timestamp_utc", F.round("resid_roll_mean_24", 6), F.round("raw_z", 6)).collect()))
        return a, b

    whole = run()
    monkeypatch.setattr(scan, "BLOCK_ROWS", 40)
    assert run() == whole


def test_global_rank_equals_row_numbers(spark):
    df = spark.range(2000).selectExpr("id", "id * 7919 % 500 AS x")
    ranked = scan.global_rank(df.repartition(7), [F.col("x").desc(), F.col("id")], "rank")
    got = [(r.id, r["rank"]) for r in ranked.collect()]
    wanted = sorted(((i * 7919 % 500, i) for i in range(2000)), key=lambda v: (-v[0], v[1]))
    assert sorted(got) == sorted((i, n + 1) for n, (_, i) in enumerate(wanted))
    assert scan.global_rank(df.where("id < 0"), [F.col("id")], "rank").count() == 0
    assert "Window [" not in ranked._jdf.queryExecution().executedPlan().toString() or "SinglePartition" not in ranked._jdf.queryExecution().executedPlan().toString()
