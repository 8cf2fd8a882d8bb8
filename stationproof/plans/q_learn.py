"""Catalogue: trained models and explanations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stationproof import config as C
from stationproof.functions.columns import CELL
from stationproof.functions.state import checkpoint_dir, cut
from stationproof.operators import canonical, coverage, cv, deweather, explain, fault, features, labels, learn, shapley
from stationproof.plans import oracle as O
from stationproof.plans.catalog import query
from stationproof.plans.q_models import CAL, MET, fault_inputs, feed, series_residuals
from stationproof.plans.q_ops import once
from stationproof.plans.shared import store

def matrix(spark, sf):
    return once(spark, sf, "matrix", lambda: features.matrix(store(spark, sf).readings, feed(spark, sf)))


def columns():
    return features.available(has_weather=True)


def r(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


_TRAINED: dict = {}


def trained(spark, sf):
    """All deweathering models of the data set, trained once in a session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _TRAINED:
        cells = deweather.cells(store(spark, sf).readings, matrix(spark, sf), columns())
        _TRAINED[key] = deweather.train(cells, columns())
    return _TRAINED[key]


O.cte(
    dwcell=f"SELECT station_id, parameter, timestamp_utc, avg(value) AS y FROM rd WHERE value IS NOT NULL AND parameter IN {C.POLLUTANTS} GROUP BY ALL",
    dwblock=f"SELECT parameter, timestamp_utc, ntile({C.CV_FOLDS + 1}) OVER (PARTITION BY parameter ORDER BY timestamp_utc) AS block FROM (SELECT DISTINCT parameter, timestamp_utc FROM dwcell)",
    dwcount=f"""SELECT parameter, fold, count(*) FILTER (block <= fold) AS n_train, count(*) FILTER (block = fold + 1) AS n_test
  FROM dwcell JOIN dwblock USING (parameter, timestamp_utc), range(1, {C.CV_FOLDS + 1}) t(fold) GROUP BY ALL""",
)


@query("m10_deweather_training")
def m10(spark, sf):
    """Fold metrics of the boosted trees of every carried pollutant; counts and coherence have a twin below."""
    return r(deweather.metrics(trained(spark, sf)), "r2", "mae")


@query(
    "m10_fold_counts",
    f"SELECT parameter, fold, n_train, n_test, {deweather.PARAMS.rounds}::BIGINT AS n_rounds, true AS learned FROM dwcount",
)
def m10_counts(spark, sf):
    """Cells and rounds of every fold's model, and whether its trees reduce the squared error of the cells that they were grown on."""
    t = trained(spark, sf)
    seen = t.cells.join(t.splits.where("role = 'train'").drop("role"), ["parameter", "timestamp_utc"])
    number = deweather.model_number(F.col("parameter"), F.col("fold"), t.pollutants, t.folds)
    fit = deweather.fit_metrics(t.forest.predict(seen.withColumn("model", number), "y_hat"), ["parameter", "fold"])
    out = deweather.metrics(t).select("parameter", "fold", "n_train", "n_test").join(fit.select("parameter", "fold", F.col("r2").alias("own")), ["parameter", "fold"])
    return out.select("parameter", "fold", "n_train", "n_test", F.lit(len(t.forest.feature)).cast("bigint").alias("n_rounds"), (F.coalesce("own", F.lit(1.0)) > 0).alias("learned"))


@query("m11_r2_band_gate")
def m11(spark, sf):
    return r(deweather.in_band(deweather.metrics(trained(spark, sf))), "r2", "mae")


@query("m12_residuals")
def m12(spark, sf):
    return r(deweather.residuals(trained(spark, sf)), "actual", "predicted", "residual")


@query(
    "m12_residual_cells",
    "SELECT station_id, parameter, timestamp_utc, round(y + 1e-9, 6) AS actual, 0.0::DOUBLE AS gap FROM dwcell",
)
def m12_cells(spark, sf):
    """Every present cell with its target and how far prediction and residual are from adding up to it."""
    gap = F.round(F.abs(F.col("actual") - F.col("predicted") - F.col("residual")), 6)
    return deweather.residuals(trained(spark, sf)).select("station_id", "parameter", "timestamp_utc", F.round(F.col("actual") + 1e-9, 6).alias("actual"), gap.alias("gap"))


@query(
    "m18_model_record",
    f"""SELECT 'deweather' AS name, 'v1-' || checksum[1:8] AS version, checksum AS data_checksum, lo AS window_start, hi AS window_end, n_cells, n_models, {deweather.PARAMS.rounds}::BIGINT AS n_rounds,
  '{",".join(columns())}' AS features, true AS same_predictions
  FROM digest, (SELECT min(timestamp_utc) AS lo, max(timestamp_utc) AS hi, count(*) AS n_cells, count(DISTINCT parameter) * {C.CV_FOLDS + 1} AS n_models FROM dwcell)""",
)
def m18(spark, sf):
    """The models stored with their record, found again as the latest of their name, and predicting the same."""
    t, root = trained(spark, sf), f"{checkpoint_dir(spark)}/models-{uuid.uuid4().hex}"
    learn.save(spark, t.forest, root, deweather.record(t, canonical.checksum(store(spark, sf).readings)))
    forest, record = learn.load(spark, root, learn.latest(spark, root, "deweather"))
    both = forest.predict(deweather.predicted(t), "again")
    same = both.agg(F.bool_and(F.col("again") == F.col("y_hat")).alias("x")).scalar()
    named = record.select("name", "version", "data_checksum", "window_start", "window_end", "n_cells", "n_models", "n_rounds", "features")
    return named.withColumn("same_predictions", same)


def corpus(spark, sf):
    """Planted corpus with its features and flags."""
    from stationproof.operators import detectors
    from stationproof.plans import views

    s = store(spark, sf)
    marks = once(spark, sf, "marks", lambda: fault.labelled(s.readings, s.cov.n_rows))
    kept = marks.where("NOT removed").select(*CELL, "value", "ingest_seq")
    more = s.readings.select(*CELL, "ingest_seq", "unit", "source_file")
    planted = cut(kept.join(more, [*CELL, "ingest_seq"]))
    x = once(spark, sf, "corpus_x", lambda: fault.residual_features(series_residuals(planted), s.cov.n_rows))

    def flags():
        return detectors.run_all(coverage.build(planted), unit_rules=views.UNIT_RULES, floors=views.FLOORS)

    return marks, x, once(spark, sf, "corpus_flags", flags)


FOLDS = 4


def weakly_labelled(spark, sf):
    """All cells of all series that no rule claims, with the label model's class and their time block."""

    def make():
        s, x = fault_inputs(spark, sf)
        return labels.blocked(labels.weak_labels(x, s.defects), FOLDS)

    return once(spark, sf, "weak_labels", make)


_CLASSIFIERS: dict = {}


def cross_fitted(spark, sf):
    """The classifier on the label model's labels: one model of all blocks and one without each block."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _CLASSIFIERS:
        _CLASSIFIERS[key] = learn.fit(weakly_labelled(spark, sf), folds=FOLDS)
    return _CLASSIFIERS[key]


_DAY, _TREND = "abs(resid_roll_mean_24) / nullif(abs(residual) / nullif(resid_abs_z, 0), 0)", "abs(resid_trend) / nullif(abs(residual) / nullif(resid_abs_z, 0), 0)"
O.cte(
    free="SELECT * FROM fx WHERE (station_id, parameter, timestamp_utc) NOT IN (SELECT (station_id, parameter, timestamp_utc) FROM rulec)",
    stepped="SELECT DISTINCT station_id, parameter, timestamp_utc, true AS step FROM defect WHERE reason_code = 'R14'",
    voted=f"""SELECT station_id, parameter, timestamp_utc, concat(CASE WHEN step THEN 2 ELSE 0 END, CASE WHEN {_DAY} > 1.0 THEN 2 WHEN {_DAY} < 0.4 THEN 1 ELSE 0 END, CASE WHEN {_TREND} > 1.0 THEN 2 WHEN {_TREND} < 0.3 THEN 1 ELSE 0 END,
  CASE WHEN raw_z > {C.METEO_RAW_Z} AND resid_abs_z < {C.METEO_RESID_ABS_Z} THEN 3 WHEN raw_z < 1.0 THEN 1 ELSE 0 END, CASE WHEN raw_z > 1.0 AND explained_ratio > 0.6 THEN 3 ELSE 0 END,
  CASE WHEN abs(raw_z) < 1.0 AND resid_abs_z < 1.0 THEN 1 ELSE 0 END) AS votes FROM free LEFT JOIN stepped USING (station_id, parameter, timestamp_utc)""",
)


@query("l6_vote_patterns", "SELECT votes, count(*) AS n FROM voted GROUP BY ALL")
def l6_patterns(spark, sf):
    """Cells of every pattern of votes that the label model is fitted on."""
    s, x = fault_inputs(spark, sf)
    return labels.patterns(labels.votes(x, s.defects)).select(F.array_join(F.col("votes").cast("array<string>"), "").alias("votes"), "n")


@query("l6_weak_labels")
def l6_labels(spark, sf):
    """Label and certainty of every cell."""
    return r(weakly_labelled(spark, sf), "certainty").select(*CELL, "block", "label_class", "certainty")


@query("l6_cross_fitted")
def l6_cross(spark, sf):
    """Labels against the classes that the model without the cell's block predicts."""
    table = weakly_labelled(spark, sf)
    out = learn.predictor(cross_fitted(spark, sf), F.col("block"))(table)
    return out.groupBy("block", "label_class", F.col("fault_class").alias("predicted_class")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "l4_hybrid_cells",
    """SELECT station_id, parameter, timestamp_utc, CASE WHEN fault_class IS NULL THEN 'ml' ELSE 'rule' END AS source, fault_class AS forced_class, true AS sure FROM res LEFT JOIN rulec USING (station_id, parameter, timestamp_utc)
  UNION ALL SELECT DISTINCT station_id, parameter, timestamp_utc, 'rule', 'communication_failure', true FROM r02""",
)
def l4_cells(spark, sf):
    """Who decides every cell of the readings as they are, the class where a rule forces it, and whether the confidence is one of a best class."""
    s, x = fault_inputs(spark, sf)
    x = x.join(cv.time_blocks(x, FOLDS), "timestamp_utc")
    out = fault.classify(x, s.defects, learn.predictor(cross_fitted(spark, sf), F.col("block")))
    sure = F.col("confidence").between(1.0 / 3, 1.0) & F.col("fault_class").isin(*C.FAULT_CLASSES)
    return out.select(*CELL, "source", F.when(F.col("source") == "rule", F.col("fault_class")).alias("forced_class"), sure.alias("sure"))


@query("l6_fault_training")
def l6(spark, sf):
    marks, x, _ = corpus(spark, sf)
    t = learn.training_table(x, marks)
    model, _ = learn.train(x, marks)
    out = learn.predictor(model)(t).groupBy("label_class", F.col("fault_class").alias("predicted_class"))
    return out.agg(F.count(F.lit(1)).alias("n"))


@query("l4_hybrid_classification")
def l4(spark, sf):
    marks, x, flags = corpus(spark, sf)
    model, _ = learn.train(x, marks)
    return r(fault.classify(x, flags, learn.predictor(model)), "confidence")


@query("l9_quality_floors")
def l9(spark, sf):
    from stationproof.operators import cv

    marks, x, flags = corpus(spark, sf)
    _, held = learn.train(x, marks)
    b = cv.time_blocks(x, 5).where("block = 5")
    test = x.join(b.select("timestamp_utc"), "timestamp_utc", "left_semi")
    pred = cut(fault.classify(test, flags, learn.predictor(held)))
    truth = marks.where("signature IS NOT NULL").select(*CELL, F.col("fault_class").alias("true_class")).distinct()
    art = fault.artefacts(test).withColumn("_a", F.lit("meteorological_artefact"))
    judged = (
        test.select(*CELL)
        .join(pred.select(*CELL, F.col("fault_class").alias("predicted_class")), CELL)
        .join(truth, CELL, "left")
        .join(art, CELL, "left")
        .withColumn("true_class", F.coalesce("true_class", "_a", F.lit("none")))
    )
    metrics = fault.class_metrics(fault.confusion(judged, spark))
    since = b.agg(F.min("timestamp_utc")).scalar()
    recall = fault.signature_recall(marks, pred, fault.gap_starts(flags), since)
    return fault.floors_met(recall, metrics)


def attributed(spark, sf):
    """Every present cell with its prediction and what each feature adds to it."""
    t = trained(spark, sf)
    return shapley.attributions(deweather.predicted(t), t.forest)


@query(
    "x1_additive_attributions",
    f"SELECT station_id, parameter, timestamp_utc, {len(columns())}::BIGINT AS n_features, 0.0::DOUBLE AS gap FROM dwcell",
)
def x1(spark, sf):
    """How far base and attributions are from adding up to the prediction of every cell."""
    total = F.aggregate("attributions", F.col("base"), lambda a, x: a + x["value"])
    return attributed(spark, sf).select("station_id", "parameter", "timestamp_utc", F.size("attributions").cast("bigint").alias("n_features"), F.round(F.abs(F.col("y_hat") - total), 6).alias("gap"))


@query("x1_prediction_sentences")
def x1_sentences(spark, sf):
    """Every cell's prediction in words, from the Shapley values of its pollutant's trees."""
    said = explain.sentence(attributed(spark, sf)).withColumnRenamed("y_hat", "predicted")
    return r(said.select("station_id", "parameter", "timestamp_utc", "predicted", "base", "explanation"), "predicted", "base")


# --- sentences and routing: checked on deviations from the network mean -------------------------
XCOLS = MET + CAL
P = explain.PHRASES
O.cte(
    xrow="SELECT station_id, timestamp_utc, unnest([" + ", ".join(f"'{c}'" for c in XCOLS) + "]) AS feature, unnest([" + ", ".join(map(str, range(len(XCOLS)))) + "]) AS position, unnest(["
    + ", ".join(f"{c} - {0.5 if c in CAL else 1.0}" for c in XCOLS)
    + "]) AS value FROM met2 JOIN cal USING (timestamp_utc)",
    xph="SELECT *, " + O.case("feature", P) + " AS phrase, row_number() OVER (PARTITION BY station_id, timestamp_utc ORDER BY round(abs(value), 9) DESC, position) AS rk, row_number() OVER (PARTITION BY station_id, timestamp_utc ORDER BY round(abs(value), 9), position) AS lk FROM xrow",
    xtop="SELECT station_id, timestamp_utc, phrase, min(rk) AS rk, arg_min(CASE WHEN value > 0 THEN 'raised' ELSE 'lowered' END, rk) AS way FROM xph WHERE rk <= 3 AND round(abs(value), 9) > 0 GROUP BY ALL",
    xlist="SELECT station_id, timestamp_utc, list(phrase || ' (' || way || ')' ORDER BY rk) AS said, list(phrase) AS names FROM xtop GROUP BY ALL",
)


@query(
    "x2_operator_sentences",
    """SELECT station_id, timestamp_utc, 'Driven primarily by ' || said[1] || CASE len(said) WHEN 1 THEN '' WHEN 2 THEN ', then ' || said[2] ELSE ', then ' || said[2] || ' and ' || said[3] END ||
  CASE WHEN list_contains(names, phrase) THEN '' ELSE '; not ' || phrase END || '.' AS explanation FROM xlist JOIN (SELECT station_id, timestamp_utc, phrase FROM xph WHERE lk = 1) USING (station_id, timestamp_utc)""",
)
def x2(spark, sf):
    m = matrix(spark, sf)
    means = [0.5 if c in CAL else 1.0 for c in XCOLS]
    rows = explain.linear_attributions(m, list(XCOLS), [1.0] * len(XCOLS), means)
    return explain.sentence(rows).select("station_id", "timestamp_utc", "explanation")


@query(
    "x3_explanation_routing",
    """SELECT d.station_id, d.parameter, d.timestamp_utc, d.reason_code, CASE WHEN m THEN 'model' ELSE 'rule' END AS method, CASE WHEN m THEN round(residual + 1e-9, 6) END AS residual, CASE WHEN residual IS NOT NULL THEN coalesce(fault_class, 'none') ELSE g END AS fault_class
  FROM (SELECT *, reason_code NOT IN ('R10', 'R11') AND parameter IN ('PM10', 'NO2', 'O3', 'CO', 'CO2') AND timestamp_utc IN (SELECT timestamp_utc FROM hrs) AS m FROM defect) d
  LEFT JOIN res USING (station_id, parameter, timestamp_utc) LEFT JOIN rulec USING (station_id, parameter, timestamp_utc)
  LEFT JOIN (SELECT DISTINCT station_id, parameter, timestamp_utc, 'communication_failure' AS g FROM r02) USING (station_id, parameter, timestamp_utc)""",
)
def x3(spark, sf):
    s = store(spark, sf)
    res = once(spark, sf, "netres", lambda: series_residuals(s.readings))
    classes = fault.classify(fault.residual_features(res, s.cov.n_rows), s.defects)
    out = explain.route(s.defects, res, features.grid(s.readings), classes)
    return out.drop("sentence").withColumn("residual", F.round(F.col("residual") + 1e-9, 6))
