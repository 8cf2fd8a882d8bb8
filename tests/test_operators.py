"""Hand-worked tables and stated invariants."""

import random

import pytest
from pyspark.sql import functions as F

from stationproof.functions import geo, scan
from stationproof.functions.columns import dense
from stationproof.operators import adjudicate as adj
from stationproof.operators import canonical, conformal, counters, cv, explain, exposure, graph, ops, reads, trust
from stationproof.plans import views
from stationproof.sources import readings as src
from stationproof.sources import sinks
from tests.corpus import golden, plume

SF = "/root/testdata/sf0.001"


def judge(spark, rising):
    st, r = plume(spark, rising)
    ev = spark.sql("SELECT 1L AS event_id, 'SCEN-SRC' AS station_id, 'PM10' AS parameter, TIMESTAMP_NTZ '2026-06-03 12:00:00' AS timestamp_utc, CAST(NULL AS DOUBLE) AS fallback_value, 1L AS audit_rank")
    local = graph.station_wind(r)
    values = adj.last_values(r)
    c = adj.candidates(ev, values)
    v, e = adj.adjudicate(c, values, graph.pairs(st), st, local, graph.city_wind(local))
    assert adj.verdict_violations(v).count() == 0
    return v.first(), {x.dst: x for x in e.collect()}


def test_corroborated_plume(spark):
    v, e = judge(spark, ("SCEN-N1", "SCEN-N2"))
    assert (v.verdict, v.confidence, v.match_score) == ("GENUINE_EVENT", 1.0, 1.0)
    assert round(e["SCEN-N1"].edge_weight, 6) == 0.391528 and round(e["SCEN-N2"].edge_weight, 6) == 0.214612
    assert round(e["SCEN-N1"].actual_excess, 4) == 1628.9359 and round(e["SCEN-N2"].actual_excess, 4) == 893.4116
    assert "SCEN-UP" not in e


def test_isolated_fault_and_partial(spark):
    v, _ = judge(spark, ())
    assert (v.verdict, v.confidence, v.reason_code) == ("LIKELY_FAULT", 1.0, "R17")
    v, _ = judge(spark, ("SCEN-N2",))
    assert v.verdict == "AMBIGUOUS" and round(v.match_score, 3) == 0.354 and v.routes_to_review


def test_counter_repair(spark):
    rows = [(0, 10.0), (1, 15.0), (2, 15.0), (2, 16.0), (3, 2.0), (4, 1.9), (5, 7.0)]
    df = spark.createDataFrame([(i, s, v) for i, (s, v) in enumerate(rows)], "ingest_seq long, s long, cumulative double")
    df = df.select(F.lit("c").alias("counter_id"), F.lit("cars").alias("parameter"), F.timestamp_seconds(F.col("s") * 900).cast("timestamp_ntz").alias("timestamp_utc"), "cumulative", "ingest_seq")
    steps = counters.increments(counters.last_delivered(df)).orderBy("timestamp_utc").collect()
    assert [r.increment for r in steps] == [0.0, 5.0, 1.0, 2.0, 0.0, pytest.approx(5.1)]
    assert [r.reason_code for r in steps] == [None, None, None, "R05", "R06", None]
    s = counters.repair_summary(df).first()
    assert (s.n_resets, s.n_nonmonotonic, s.n_duplicates, s.is_dead, s.completeness) == (1, 1, 1, False, 1.0)
    back = counters.cumulate(counters.difference(counters.last_delivered(df))).orderBy("timestamp_utc").collect()
    assert all(abs(r.recumulated - r.cumulative) < 1e-9 for r in back)


def test_conformal_order_statistic(spark):
    df = spark.createDataFrame([("g", float(i)) for i in range(1, 101)] + [("s", 1.0), ("s", 2.0)], "k string, score double")
    q = {r.k: r.q for r in conformal.quantile(df, ["k"]).collect()}
    assert q["g"] == 91.0 and q["s"] == float("inf")
    with pytest.raises(ValueError):
        conformal.quantile(df, ["k"], 1.0)


def test_time_blocks(spark):
    df = spark.range(11).select(F.timestamp_seconds(F.col("id") * 3600).cast("timestamp_ntz").alias("timestamp_utc"))
    sizes = [r["count"] for r in cv.time_blocks(df, 4).groupBy("block").count().orderBy("block").collect()]
    assert sizes == [3, 3, 3, 2]
    folds = cv.splits(df, 3)
    assert cv.leakage(folds).count() == 0
    assert cv.leakage(folds.withColumn("role", F.lit("train")).unionByName(folds.where("role = 'test'"))).count() > 0
    with pytest.raises(ValueError):
        cv.enough_instants(df.limit(2), 3)


def test_nearest_equals_brute_force(spark):
    import math
    import random

    rnd = random.Random(1)
    st = [(f"s{i}", rnd.uniform(47, 48), rnd.uniform(21, 22)) for i in range(12)] + [("far", -33.0, 151.0)]
    pts = [(f"p{i:03d}", rnd.uniform(47.4, 47.6), rnd.uniform(21.4, 21.6)) for i in range(60)] + [("dup", 47.5, 21.5), ("dup2", 47.5, 21.5)]
    a = spark.createDataFrame(st, "station_id string, lat double, lon double")
    b = spark.createDataFrame(pts, "point_id string, p_lat double, p_lon double")
    got = {(r.station_id, r["rank"]): r.point_id for r in exposure.nearest(a, b).collect()}

    def d(x, y):
        p, q = math.radians(x[1]), math.radians(y[1])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(y[2] - x[2]) / 2) ** 2
        return 2 * 6371.0088 * math.asin(min(1, math.sqrt(h)))

    for s in st:
        best = sorted(pts, key=lambda y: (round(d(s, y), 9), y[0]))[:3]
        assert [got[(s[0], i + 1)] for i in range(3)] == [y[0] for y in best]


def test_radius_join_has_no_nested_loop(spark):
    st = views.stations(views.readings(spark, SF))
    plan = graph.pairs(st)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    plan = dense(st, st.select(F.col("station_id").alias("o")), "station_id")._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_edge_weights_fall_with_distance_and_angle(spark):
    w = lambda d, b: graph.wind_weight(F.lit(270.0), F.lit(5.0), F.lit(d), F.lit(b))
    r = spark.range(1).select(w(1.0, 90.0), w(2.0, 90.0), w(2.0, 120.0), w(16.0, 90.0), geo.angle_diff(F.lit(359.0), F.lit(1.0))).first()
    assert r[0] > r[1] > r[2] > 0 and r[3] == 0 and r[4] == 2.0


def test_trust_is_bounded_and_falls_with_faults(spark):
    from stationproof.operators import coverage, detectors

    def run(inject):
        cov = coverage.build(golden(spark, inject))
        d = detectors.run_all(cov)
        s = trust.score(trust.components(cov, d))
        assert trust.score_violations(s).count() == 0
        return {r.station_id: r for r in s.groupBy("station_id").agg(F.avg("trust").alias("t")).collect()}

    good, bad = run(False), run(True)
    assert all(bad[k].t < good[k].t for k in bad)


def test_dispatch_rules(spark):
    so = spark.sql("SELECT * FROM VALUES (1, 10, 'sms', false, TIMESTAMP_NTZ '2026-01-01 00:15:00'), (2, 10, 'sms', true, TIMESTAMP_NTZ '2026-01-01 00:15:00') t(signoff_id, event_id, channel, revoked, expires_at)")
    rq = spark.sql("SELECT * FROM VALUES (1, 1, 10, 'sms', TIMESTAMP_NTZ '2026-01-01 00:00:00'), (2, 1, 10, 'sms', TIMESTAMP_NTZ '2026-01-01 00:01:00'), (3, 1, 10, 'sms', TIMESTAMP_NTZ '2026-01-01 00:15:00'), (4, 1, 11, 'sms', TIMESTAMP_NTZ '2026-01-01 00:00:00'), (5, 2, 10, 'sms', TIMESTAMP_NTZ '2026-01-01 00:00:00'), (6, 9, 10, 'sms', TIMESTAMP_NTZ '2026-01-01 00:00:00') t(request_id, signoff_id, event_id, channel, requested_at)")
    c = ops.check_dispatches(rq, so)
    assert {r.request_id: r.reason for r in c.collect()} == {1: "ok", 2: "ok", 3: "expired", 4: "mismatch", 5: "revoked", 6: "missing"}
    assert [r.request_id for r in ops.dispatches(c).collect()] == [1]


def test_operator_sentence(spark):
    cols = ["wind_dir_sin", "wind_dir_cos", "humidity", "pressure"]
    row = spark.sql("SELECT 3D AS wind_dir_sin, -2D AS wind_dir_cos, 1D AS humidity, 0D AS pressure")
    e = explain.sentence(explain.linear_attributions(row, cols, [1.0] * 4, [0.0] * 4)).first().explanation
    assert e == "Driven primarily by wind direction (raised), then humidity (raised); not barometric pressure."
    flat = explain.sentence(explain.linear_attributions(row, cols, [0.0] * 4, [0.0] * 4)).first().explanation
    assert flat == explain.NOTHING


def test_repeated_load_adds_nothing(spark, tmp_path):
    r = canonical.add_row_hash(golden(spark, hours=48))
    root = str(tmp_path / "store")
    first, n = sinks.load_batch(r, root)
    assert n == r.select("row_hash").distinct().count()
    assert sinks.load_batch(r, root) == (first, 0)
    more = canonical.add_row_hash(golden(spark, inject=False, hours=60))
    _, m = sinks.load_batch(more, root)
    assert spark.read.parquet(f"{root}/readings").count() == n + m
    assert spark.read.parquet(f"{root}/readings").groupBy("row_hash").count().where("count > 1").count() == 0


def test_run_tables_and_residuals_replace_themselves(spark, tmp_path):
    d = spark.range(5).withColumn("x", F.lit(1.0))
    root = str(tmp_path)
    for _ in range(2):
        sinks.write_run({"defects": d}, "ar_1", root)
        sinks.store_residuals(d, "v1-a", root)
    sinks.write_run({"defects": d.limit(2)}, "ar_2", root)
    counts = {r.audit_run_id: r["count"] for r in spark.read.parquet(f"{root}/defects").groupBy("audit_run_id").count().collect()}
    assert counts == {"ar_1": 5, "ar_2": 2}
    assert spark.read.parquet(f"{root}/residuals").count() == 5


def test_reports_bundles_and_manifest(spark, tmp_path):
    r = canonical.add_row_hash(golden(spark, hours=48))
    sinks.write_manifest(r, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m/parameters")).count() == 6
    sinks.write_report({"a": spark.range(3).toDF("n")}, str(tmp_path / "rep"))
    assert spark.read.json(str(tmp_path / "rep/a")).count() == 3
    windy = spark.sql("SELECT 1L AS event_id, 350.004D AS from_deg, 2.5D AS speed, 'station-local' AS wind_origin")
    sinks.write_bundles(spark.range(2).toDF("event_id"), spark.range(4).toDF("event_id"), str(tmp_path / "b"), windy)
    note = spark.read.json(str(tmp_path / "b" / "wind")).first()
    assert (note.event_id, note.from_deg, note.to_deg, note.speed, note.wind_origin) == (1, 350.0, 170.0, 2.5, "station-local")
    assert spark.read.json(str(tmp_path / "b/neighbours")).count() == 4


def test_sources(spark, tmp_path):
    d = tmp_path / "vendor"
    d.mkdir()
    head = "timestamp,Location,Mérőeszköz,érték,mértékegység\n"
    (d / "deb-ker01_Levego.csv").write_text(head + '2026-05-01-00-00,"Site, one (47.5, 21.6)",PM10,12.5,µg/m3\n2026-05-01-01-00,"Site, one (47.5, 21.6)",PM10,hiba,µg/m3\n', encoding="utf8")
    rows = src.load(spark, "vendor", str(d)).orderBy("timestamp_utc").collect()
    assert [(r.station_id, r.value, r.source_file) for r in rows] == [("DEB-KER01", 12.5, "deb-ker01_Levego.csv"), ("DEB-KER01", None, "deb-ker01_Levego.csv")]
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "deb-ker02_Levego.csv").write_text(head + "2026-05-01-00-00,x,Radon,1,Bq\n", encoding="utf8")
    with pytest.raises(canonical.SchemaDriftError):
        src.load(spark, "vendor", str(bad))
    p = str(tmp_path / "canon")
    canonical.add_row_hash(golden(spark, hours=24)).drop("ingest_seq").write.parquet(p)
    assert src.load(spark, "canonical", p).columns == [*canonical.COLUMNS, "ingest_seq"]
    assert src.load(spark, "canonical", p).count() > 0
    (tmp_path / "s.json").write_text('{"STA-01": {"name": "a", "lat": 47.5, "lon": 21.5}}')
    assert src.load(spark, "sites", str(tmp_path / "s.json")).first().lat == 47.5
    with pytest.raises(KeyError):
        src.load(spark, "nowhere", p)


def test_model_record_is_checked(spark, tmp_path):
    from stationproof.operators import boosting, learn

    t = spark.range(60).select(F.lit(0).alias("model"), F.col("id").cast("double").alias("x"), (F.col("id") * 2.0).alias("y"))
    forest = boosting.fit(t, ["x"], 1, boosting.Params(rounds=3, min_rows=5))
    root = str(tmp_path / "models")
    assert learn.latest(spark, root, "deweather") is None
    with pytest.raises(ValueError):
        learn.load(spark, root, "deweather-v1-abcdef01")
    row = lambda sum_: spark.range(1).select(F.lit("deweather").alias("name"), F.lit(learn.version(sum_)).alias("version"), F.lit(sum_).alias("data_checksum"))
    learn.save(spark, forest, root, row("abcdef0123"))
    learn.save(spark, forest, root, row("0011223344"))
    assert learn.latest(spark, root, "deweather") == "deweather-v1-00112233" and learn.latest(spark, root, "fault") is None
    again, record = learn.load(spark, root, "deweather-v1-abcdef01", "abcdef0123")
    assert record.first()["version"] == "v1-abcdef01"
    assert again.predict(t, "p").exceptAll(forest.predict(t, "p")).isEmpty()
    with pytest.raises(ValueError):
        learn.load(spark, root, "deweather-v1-abcdef01", "other")
    row("other").write.mode("overwrite").parquet(f"{root}/deweather-v1-abcdef01/record")
    with pytest.raises(ValueError):
        learn.load(spark, root, "deweather-v1-abcdef01")


def test_additive_attributions(spark):
    from stationproof.plans import load

    q = load().QUERIES["x1_additive_attributions"]
    assert q(spark, SF).agg(F.max("gap")).first()[0] < 1e-4


def _readings(spark, rows):
    df = spark.createDataFrame(rows, "us long, value double").selectExpr(
        "'S' AS station_id", "'PM10' AS parameter", "cast(timestamp_micros(us) AS timestamp_ntz) AS timestamp_utc", "value", "'u' AS unit",
        "cast(null AS string) AS instrument_id", "'f.csv' AS source_file",
    )
    return canonical.add_row_hash(df)


def test_close_readings_are_all_loaded(spark, tmp_path):
    rows = [(0, 1.0), (0, 1.0 + 1e-7), (1000, 1.0), (2000, None), (0, 1e25), (0, 1.0)]
    _, n = sinks.load_batch(_readings(spark, rows), str(tmp_path))
    assert n == 5
    _, n = sinks.load_batch(_readings(spark, [*rows, (86_400_000_000, 1.0), (2000, 2e-7)]), str(tmp_path))
    assert n == 2
    assert spark.read.parquet(f"{tmp_path}/readings").count() == 7


def test_pages_reach_every_row_and_refuse_too_many(spark):
    scores = spark.range(600).selectExpr("'A' AS station_id", "cast(timestamp_seconds(id * 3600) AS timestamp_ntz) AS timestamp_utc", "0.5D AS trust")
    assert reads.trust_series(scores, "A").count() == 600
    seen, after = [], None
    while part := reads.trust_series(scores, "A", after=after, limit=250).collect():
        seen += [r.timestamp_utc for r in part]
        after = seen[-1]
    assert len(seen) == len(set(seen)) == 600
    with pytest.raises(ValueError):
        reads.page(scores, ["timestamp_utc"], limit=501)


def test_every_scoring_instant_is_kept(spark):
    series = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-01 00:00:00' AS start, TIMESTAMP_NTZ '2024-05-09 00:00:00' AS `end`")
    assert trust.instants(series).count() == 130 and trust.instants(series, 7).count() == 7


def test_late_rows_from_instants(spark, monkeypatch):
    monkeypatch.setattr(scan, "BLOCK_ROWS", 60)
    rng = random.Random(3)
    rows = [(c, p, rng.choice([None, *range(40)]), 1.0, q) for c in ("a", "b", None) for p in ("x", None) for q in [None, *rng.sample(range(1000), 120)]]
    df = spark.createDataFrame(rows, "counter_id string, parameter string, s long, cumulative double, ingest_seq long")
    df = df.withColumn("timestamp_utc", F.timestamp_seconds(F.col("s") * 900).cast("timestamp_ntz"))
    wanted = []
    for key in {r[:2] for r in rows}:
        most = None
        for r in sorted((r for r in rows if r[:2] == key), key=lambda r: -1 if r[4] is None else r[4]):
            if r[2] is not None:
                wanted += [r] if most is not None and r[2] < most else []
                most = max(r[2], -1 if most is None else most)
    late = counters.late_rows(df)
    assert sorted(map(str, (tuple(r[:5]) for r in late.collect()))) == sorted(map(str, wanted)) and late.columns == df.columns
    reads = spark.sparkContext.accumulator(0)

    def read(q):
        reads.add(1)
        return q

    seen = df.withColumn("ingest_seq", F.udf(read, "long").asNondeterministic()("ingest_seq"))
    assert counters.repair_events(seen).where("reason_code = 'R04'").count() == len(wanted)
    assert reads.value <= 2 * len(rows)
