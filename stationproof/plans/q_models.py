"""Catalogue: features, cross-validation, conformal intervals, faults."""

from __future__ import annotations

from pyspark.sql import functions as F

from stationproof.functions.columns import CELL, SERIES
from stationproof.operators import conformal, cv, fault, features
from stationproof.plans import oracle as O
from stationproof.plans import views
from stationproof.plans.catalog import query
from stationproof.plans.q_graph import r6
from stationproof.plans.shared import store

FOLDS = 4
# Rounding below adds a small offset first: means of a few decimals often end exactly between
# two roundings, where the last bit of a sum would decide.


def feed(spark, sf):
    """Daily weather derived from orders: temperature on some days only."""
    o = views.table(spark, sf, "orders")
    return o.groupBy(F.col("o_orderdate").cast("timestamp_ntz").alias("d")).agg(F.count(F.lit(1)).alias("n")).select(
        # orders predate the readings; the shift brings their days into the same months
        (F.col("d") + F.expr("INTERVAL '9131' DAY")).alias("timestamp_utc"),
        F.when(F.col("n") % 3 > 0, F.col("n").cast("double")).alias("temperature"),
        (F.col("n") % 5).cast("double").alias("precipitation"),
    )


MET = ("wind_speed", "humidity", "pressure", "wind_dir_sin", "wind_dir_cos")
CAL = ("hour_sin", "hour_cos", "dow_sin", "dow_cos", "season_sin", "season_cos", "boundary_layer_proxy")
CAL_SQL = """sin(2 * pi() * hour(t) / 24) AS hour_sin, cos(2 * pi() * hour(t) / 24) AS hour_cos, sin(2 * pi() * (isodow(t) - 1) / 7) AS dow_sin,
  cos(2 * pi() * (isodow(t) - 1) / 7) AS dow_cos, sin(2 * pi() * dayofyear(t) / 365.25) AS season_sin, cos(2 * pi() * dayofyear(t) / 365.25) AS season_cos,
  least(greatest(0.15 + 0.85 * (0.65 * 0.5 * (1 + cos(2 * pi() * (hour(t) - 15) / 24)) + 0.35 * 0.5 * (1 + cos(2 * pi() * (dayofyear(t) - 172) / 365.25))), 0), 1) AS boundary_layer_proxy"""

O.cte(
    hrs="SELECT DISTINCT timestamp_utc FROM rd",
    gridf="SELECT station_id, timestamp_utc FROM (SELECT DISTINCT station_id FROM rd), hrs",
    metc="""SELECT station_id, timestamp_utc, avg(value) FILTER (parameter = 'Wind_Speed') AS wind_speed, avg(value) FILTER (parameter = 'Humidity') AS humidity, avg(value) FILTER (parameter = 'Pressure') AS pressure,
  sin(radians(avg(value) FILTER (parameter = 'Wind_Direction'))) AS wind_dir_sin, cos(radians(avg(value) FILTER (parameter = 'Wind_Direction'))) AS wind_dir_cos FROM rd GROUP BY ALL""",
    met1="SELECT g.*, " + ", ".join(f"coalesce(m.{c}, avg(m.{c}) OVER (PARTITION BY timestamp_utc)) AS {c}" for c in MET) + " FROM gridf g LEFT JOIN metc m USING (station_id, timestamp_utc)",
    met2="SELECT station_id, timestamp_utc, " + ", ".join(f"coalesce({c}, avg({c}) OVER (), 0) AS {c}" for c in MET) + " FROM met1",
    cal=f"SELECT t AS timestamp_utc, {CAL_SQL} FROM (SELECT timestamp_utc AS t FROM hrs)",
    feed="""SELECT o_orderdate + INTERVAL 9131 DAY AS timestamp_utc, CASE WHEN count(*) % 3 > 0 THEN count(*)::DOUBLE END AS temperature, (count(*) % 5)::DOUBLE AS precipitation FROM orders GROUP BY 1""",
    wth="""SELECT timestamp_utc, coalesce(last_value(temperature IGNORE NULLS) OVER (ORDER BY timestamp_utc ROWS UNBOUNDED PRECEDING),
  first_value(temperature IGNORE NULLS) OVER (ORDER BY timestamp_utc ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 10.0)::DOUBLE AS temperature, coalesce(precipitation, 0) AS precipitation FROM hrs LEFT JOIN feed USING (timestamp_utc)""",
    fold="""SELECT k AS fold, timestamp_utc, CASE WHEN block <= k THEN 'train' ELSE 'test' END AS role FROM (SELECT timestamp_utc, ntile(5) OVER (ORDER BY timestamp_utc) AS block FROM hrs), range(1, 5) t(k) WHERE block <= k + 1""",
    res="""SELECT station_id, parameter, timestamp_utc, y, y_hat, y - y_hat AS residual, block, 2.0 AS sigma FROM (SELECT station_id, parameter, timestamp_utc, avg(value) AS y FROM rd WHERE value IS NOT NULL GROUP BY ALL)
  JOIN (SELECT parameter, timestamp_utc, avg(value) AS y_hat FROM rd GROUP BY ALL) USING (parameter, timestamp_utc) JOIN blk USING (timestamp_utc)""",
    cal3="""SELECT parameter, count(*) AS n, CASE WHEN ceil((count(*) + 1) * (1.0::DOUBLE - 0.1::DOUBLE)) > count(*) THEN 'inf'::DOUBLE ELSE
  list_sort(list(abs(y - y_hat)))[ceil((count(*) + 1) * (1.0::DOUBLE - 0.1::DOUBLE))::INT] END AS q FROM res WHERE block = 3 GROUP BY parameter HAVING count(*) >= 20""",
)


@query("m1_dense_grid", "SELECT * FROM gridf")
def m1(spark, sf):
    return features.grid(views.readings(spark, sf))


@query("m2_m3_imputed_weather", "SELECT station_id, timestamp_utc, " + ", ".join(f"round({c} + 1e-9, 6) AS {c}" for c in MET) + " FROM met2")
def m2(spark, sf):
    r = views.readings(spark, sf)
    return features.impute(features.grid(r), features.measured_cells(r), list(MET)).withColumns(
        {c: F.round(F.col(c) + 1e-9, 6) for c in MET}
    )


@query("m4_m5_calendar", "SELECT timestamp_utc, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in CAL) + " FROM cal")
def m4(spark, sf):
    hours = views.readings(spark, sf).select("timestamp_utc").distinct()
    out = features.calendar(hours)
    return out.withColumns({c: F.round(c, 6) + 0.0 for c in CAL})


@query("m6_weather_join", "SELECT * FROM wth")
def m6(spark, sf):
    hours = views.readings(spark, sf).select("timestamp_utc").distinct()
    return features.weather(hours, feed(spark, sf))


@query("s8_weather_feed", "SELECT * FROM feed")
def s8(spark, sf):
    return feed(spark, sf)


@query(
    "m7_feature_matrix",
    "SELECT station_id, timestamp_utc, " + ", ".join(f"round({c} + 1e-9, 6) + 0.0 AS {c}" for c in MET + CAL) + ", temperature, precipitation, 0.0::DOUBLE AS traffic_flow FROM met2 JOIN cal USING (timestamp_utc) JOIN wth USING (timestamp_utc)",
)
def m7(spark, sf):
    m = features.matrix(views.readings(spark, sf), feed(spark, sf))
    return m.withColumns({c: F.round(F.col(c) + 1e-9, 6) + 0.0 for c in MET + CAL})


@query(
    "m7_feature_spec",
    "SELECT * FROM (VALUES "
    + ", ".join(f"({i}::BIGINT, '{n}', '{p}', {str(True if p != 'traffic' else a).lower()})" for i, (n, (p, a)) in enumerate(features.FEATURES.items()))
    + ") t(position, feature, origin, available), (SELECT count(*) AS n_rows FROM gridf)",
)
def m7s(spark, sf):
    spec = features.feature_spec(spark, has_weather=True)
    n = features.grid(views.readings(spark, sf)).agg(F.count(F.lit(1)).alias("x")).scalar()
    return spec.withColumn("n_rows", n)


@query("m8_time_blocked_splits", "SELECT * FROM fold")
def m8(spark, sf):
    return cv.splits(views.readings(spark, sf), FOLDS)


@query("m9_leakage_check", "SELECT count(*) AS n_leaky FROM (SELECT fold FROM fold GROUP BY fold HAVING max(timestamp_utc) FILTER (role = 'train') >= min(timestamp_utc) FILTER (role = 'test'))")
def m9(spark, sf):
    return cv.leakage(cv.splits(views.readings(spark, sf), FOLDS)).agg(F.count(F.lit(1)).alias("n_leaky"))


def network_residuals(readings):
    """Residuals against the network mean of the instant: a model anyone can recompute."""
    y = readings.where(F.col("value").isNotNull()).groupBy(*CELL).agg(F.avg("value").alias("y"))
    hat = readings.groupBy("parameter", "timestamp_utc").agg(F.avg("value").alias("y_hat"))
    b = cv.time_blocks(readings, FOLDS)
    return (
        y.join(hat, ["parameter", "timestamp_utc"])
        .join(b, "timestamp_utc")
        .withColumns({"residual": F.col("y") - F.col("y_hat"), "sigma": F.lit(2.0)})
    )


@query("m13_fit_metrics", """SELECT block, parameter, count(*) AS n, round(1 - sum(residual ** 2) / nullif(sum((y - m) ** 2), 0), 5) AS r2, round(avg(abs(residual)), 5) AS mae
  FROM res JOIN (SELECT block, parameter, avg(y) AS m FROM res GROUP BY ALL) USING (block, parameter) GROUP BY ALL""")
def m13(spark, sf):
    from stationproof.operators import deweather

    out = deweather.fit_metrics(network_residuals(views.readings(spark, sf)), ["block", "parameter"])
    return out.withColumns({"r2": F.round("r2", 5), "mae": F.round("mae", 5)})


@query("m14_conformal_quantile", "SELECT parameter, n, round(q, 6) AS q FROM cal3")
def m14(spark, sf):
    r = network_residuals(views.readings(spark, sf)).where("block = 3")
    return conformal.quantile(conformal.with_scores(r), ["parameter"]).where("n >= 20").withColumn("q", F.round("q", 6))


@query("m15_calibrate", "SELECT parameter, n, round(q / 2, 6) AS q FROM cal3")
def m15(spark, sf):
    r = network_residuals(views.readings(spark, sf)).where("block = 3")
    return conformal.calibrate(r, ["parameter"], normalised=True).withColumn("q", F.round("q", 6))


@query("m16_intervals", """SELECT station_id, parameter, timestamp_utc, round(y_hat - q, 6) AS lower, round(y_hat + q, 6) AS upper, y >= y_hat - q AND y <= y_hat + q AS covered FROM res JOIN cal3 USING (parameter) WHERE block = 4""")
def m16(spark, sf):
    r = network_residuals(views.readings(spark, sf))
    q = conformal.calibrate(r.where("block = 3"), ["parameter"])
    out = conformal.intervals(r.where("block = 4"), q, ["parameter"])
    return out.select(*CELL, "lower", "upper", "covered").withColumns(r6("lower", "upper"))


@query("m17_calibrate_then_score", """SELECT parameter, any_value(n) AS n_calibration, round(any_value(q), 6) AS q, count(*) AS n_test, round(avg(CASE WHEN y >= y_hat - q AND y <= y_hat + q THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS coverage
  FROM res JOIN cal3 USING (parameter) WHERE block = 4 GROUP BY parameter""")
def m17(spark, sf):
    r = network_residuals(views.readings(spark, sf))
    return conformal.calibrate_then_score(r, ["parameter"], FOLDS).withColumns(r6("q", "coverage"))


# --- faults -------------------------------------------------------------------------------------
O.cte(
    fx0="""SELECT *, avg(residual) OVER w6 AS m6, avg(residual) OVER w24 AS m24, CASE WHEN min(residual) OVER w6 = max(residual) OVER w6 THEN 0 ELSE stddev_pop(residual) OVER w6 END AS s6 FROM res
  WINDOW w6 AS (PARTITION BY station_id, parameter ORDER BY timestamp_utc ROWS 5 PRECEDING), w24 AS (PARTITION BY station_id, parameter ORDER BY timestamp_utc ROWS 23 PRECEDING)""",
    fxs="""SELECT station_id, parameter, CASE WHEN min(residual) = max(residual) THEN 1 ELSE stddev_pop(residual) END AS rs, CASE WHEN min(y) = max(y) THEN 1 ELSE stddev_pop(y) END AS ays, median(y) AS med FROM res GROUP BY ALL""",
    fx="""SELECT station_id, parameter, timestamp_utc, residual, residual / rs AS resid_z, abs(residual / rs) AS resid_abs_z, m6 AS resid_roll_mean_6, m24 AS resid_roll_mean_24, m6 - m24 AS resid_trend, s6 AS resid_roll_std_6,
  (y - med) / ays AS raw_z, least(greatest(1 - abs(residual) / (abs(y - med) + 1e-9), 0), 1) AS explained_ratio FROM fx0 JOIN fxs USING (station_id, parameter)""",
    rulec="""SELECT station_id, parameter, timestamp_utc, arg_min(c, p) AS fault_class FROM defect JOIN (VALUES ('R07','physically_impossible',0),('R08','physically_impossible',0),('R09','physically_impossible',0),
  ('R12','frozen',1),('R10','unit_inconsistency',3)) t(reason_code, c, p) USING (reason_code) GROUP BY ALL""",
)


def series_residuals(readings):
    return network_residuals(readings).select(*CELL, F.col("y").alias("actual"), "residual")


def fault_inputs(spark, sf):
    s = store(spark, sf)
    return s, fault.residual_features(series_residuals(s.readings), s.cov.n_rows)


@query("l1_residual_features", "SELECT station_id, parameter, timestamp_utc, " + ", ".join(f"round({c} + 1e-8, 5) AS {c}" for c in fault.FEATURES) + " FROM fx")
def l1(spark, sf):
    x = fault.residual_features(series_residuals(views.readings(spark, sf)))
    return x.withColumns({c: F.round(F.col(c) + 1e-8, 5) for c in fault.FEATURES})


@query("l2_artefact_labels", "SELECT station_id, parameter, timestamp_utc FROM fx WHERE raw_z > 1.5 AND resid_abs_z < 0.6")
def l2(spark, sf):
    return fault.artefacts(fault_inputs(spark, sf)[1])


@query("l3_rule_classes", "SELECT * FROM rulec")
def l3(spark, sf):
    return fault.rule_classes(store(spark, sf).defects)


@query("l4_classify_rules_only", """SELECT station_id, parameter, timestamp_utc, coalesce(fault_class, 'none') AS fault_class, 'rule' AS source, 1.0::DOUBLE AS confidence FROM res LEFT JOIN rulec USING (station_id, parameter, timestamp_utc)
  UNION ALL SELECT DISTINCT station_id, parameter, timestamp_utc, 'communication_failure', 'rule', 1.0 FROM r02""")
def l4(spark, sf):
    s, x = fault_inputs(spark, sf)
    return fault.classify(x, s.defects)


O.cte(
    sig="SELECT * FROM (VALUES " + ", ".join(f"('{k}', {i}, {n}, {s}, '{p}')" for k, i, n, s, p in fault.SIGNATURES) + ") t(kind, instance, n_instances, station_ix, parameter)",
    lab0="""SELECT r.*, kind, instance, n_instances, row_number() OVER w - 1 AS j0, count(*) OVER (PARTITION BY r.station_id, r.parameter) AS n, first_value(value) OVER w AS fv, (SELECT count(*) FROM hrs) AS hours
  FROM rd r JOIN (SELECT station_id, row_number() OVER (ORDER BY station_id) - 1 AS ix FROM (SELECT DISTINCT station_id FROM rd)) i USING (station_id) JOIN sig ON sig.station_ix = ix AND sig.parameter = r.parameter
  WINDOW w AS (PARTITION BY r.station_id, r.parameter ORDER BY timestamp_utc, ingest_seq)""",
    lab1="""SELECT *, j0 - CASE kind WHEN 'drift' THEN round(instance * greatest(0, hours - 60) / greatest(1, n_instances - 1)) WHEN 'dropout' THEN greatest(1, round(instance * greatest(0, hours - 26) / greatest(1, n_instances - 1))) ELSE 0 END AS j,
  row_number() OVER (PARTITION BY station_id, parameter, kind = 'gain' AND j0 >= 1 AND j0 <= n - 2 ORDER BY md5(station_id || ':' || parameter || ':' || CAST(j0 AS VARCHAR))) AS lot FROM lab0
  WHERE CASE kind WHEN 'drift' THEN n >= 62 WHEN 'gain' THEN n >= 6 WHEN 'dropout' THEN n >= 12 ELSE n >= 2 END""",
    lab2="""SELECT *, CASE kind WHEN 'drift' THEN j BETWEEN 0 AND 59 WHEN 'dropout' THEN j BETWEEN 0 AND 9 WHEN 'gain' THEN (j0 >= 1 AND j0 <= n - 2 AND lot <= 3) OR j0 = n - 2 ELSE true END AS hit FROM lab1""",
    lab3="""SELECT *, CASE WHEN NOT hit THEN value WHEN kind = 'drift' THEN value + j * 0.9 * avg(value) FILTER (hit AND kind = 'drift') OVER (PARTITION BY station_id, parameter) / 60 WHEN kind = 'gain' THEN value * 100 WHEN kind = 'flatline' THEN fv ELSE value END AS planted FROM lab2""",
    labelled="""SELECT r.station_id, r.parameter, r.timestamp_utc, r.ingest_seq, round(r.value, 5) AS clean_value, round(CASE WHEN l.kind IS NOT NULL THEN l.planted ELSE r.value END + 1e-8, 5) AS value,
  CASE WHEN hit THEN kind END AS signature, coalesce(hit AND kind = 'dropout', false) AS removed FROM rd r LEFT JOIN lab3 l ON l.station_id = r.station_id AND l.parameter = r.parameter AND l.ingest_seq = r.ingest_seq""",
    judged="""SELECT r.station_id, r.parameter, r.timestamp_utc, coalesce(a.c, 'none') AS true_class, coalesce(rc.fault_class, 'none') AS predicted_class FROM (SELECT * FROM res WHERE block = 4) r
  LEFT JOIN (SELECT station_id, parameter, timestamp_utc, 'meteorological_artefact' AS c FROM fx WHERE raw_z > 1.5 AND resid_abs_z < 0.6) a USING (station_id, parameter, timestamp_utc) LEFT JOIN rulec rc USING (station_id, parameter, timestamp_utc)""",
    classes="SELECT * FROM (VALUES ('none'), ('communication_failure'), ('frozen'), ('physically_impossible'), ('unit_inconsistency'), ('calibration_drift'), ('meteorological_artefact')) t(c)",
    conf="SELECT a.c AS true_class, b.c AS predicted_class, (SELECT count(*) FROM judged j WHERE j.true_class = a.c AND j.predicted_class = b.c) AS n FROM classes a, classes b",
)


@query("l5_fault_signatures", "SELECT * FROM labelled")
def l5(spark, sf):
    s = store(spark, sf)
    return fault.labelled(s.readings, s.cov.n_rows).drop("fault_class").withColumns(
        {"clean_value": F.round("clean_value", 5), "value": F.round(F.col("value") + 1e-8, 5)}
    )


def judged(spark, sf):
    """Rules-only predictions against artefact labels on the last time block."""
    s, x = fault_inputs(spark, sf)
    last = cv.time_blocks(s.readings, FOLDS).where("block = 4").select("timestamp_utc")
    x = x.join(last, "timestamp_utc", "left_semi")
    pred = fault.classify(x, s.defects.where("reason_code <> 'R02'")).select(*CELL, F.col("fault_class").alias("predicted_class"))
    art = fault.artefacts(x).withColumn("true_class", F.lit("meteorological_artefact"))
    return pred.join(art, CELL, "left").fillna({"true_class": "none"})


@query("l7_confusion_matrix", "SELECT * FROM conf")
def l7(spark, sf):
    return fault.confusion(judged(spark, sf), spark)


@query("l7_class_metrics", """SELECT c AS fault_class, coalesce(round(tp / nullif(p, 0), 4), 0) AS precision, coalesce(round(tp / nullif(t, 0), 4), 0) AS recall, t AS support FROM (SELECT c, (SELECT sum(n) FROM conf WHERE true_class = c)::BIGINT AS t,
  (SELECT sum(n) FROM conf WHERE predicted_class = c)::BIGINT AS p, (SELECT sum(n) FROM conf WHERE predicted_class = c AND true_class = c)::BIGINT AS tp FROM classes)""")
def l7m(spark, sf):
    return fault.class_metrics(fault.confusion(judged(spark, sf), spark))


O.cte(
    sigrec="""SELECT signature, count(*) AS total, count(*) FILTER (p = CASE signature WHEN 'drift' THEN 'calibration_drift' WHEN 'gain' THEN 'physically_impossible' WHEN 'flatline' THEN 'frozen' END) AS hits FROM (
  SELECT DISTINCT l.station_id, l.parameter, l.timestamp_utc, signature, coalesce(rc.fault_class, 'none') AS p FROM labelled l JOIN res USING (station_id, parameter, timestamp_utc) LEFT JOIN rulec rc USING (station_id, parameter, timestamp_utc)
  WHERE signature IS NOT NULL AND signature <> 'dropout') GROUP BY ALL
  UNION ALL SELECT 'dropout', count(*), count(*) FILTER (g) FROM (SELECT l.station_id, l.parameter, bool_or(r.timestamp_utc IS NOT NULL) AS g FROM labelled l LEFT JOIN r02 r USING (station_id, parameter, timestamp_utc) WHERE signature = 'dropout' GROUP BY ALL)"""
)


@query("l8_signature_recall", "SELECT signature, total, hits, round(hits / total, 4) AS recall FROM sigrec WHERE total > 0")
def l8(spark, sf):
    # against the untouched readings: what the rules alone see of the planted places
    s, x = fault_inputs(spark, sf)
    pred = fault.classify(x, s.defects.where("reason_code <> 'R02'"))
    marks = fault.labelled(s.readings, s.cov.n_rows)
    first = s.cov.series.agg(F.min("start")).scalar()
    return fault.signature_recall(marks, pred, fault.gap_starts(s.defects), first)
