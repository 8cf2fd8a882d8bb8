"""Fault classes: deterministic rules first, a learned model for what rules cannot see."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stationproof import config as C
from stationproof.functions import scan
from stationproof.functions.columns import CELL, SERIES, literal_table, lookup

FEATURES = (
    "residual",
    "resid_z",
    "resid_abs_z",
    "resid_roll_mean_6",
    "resid_roll_mean_24",
    "resid_trend",
    "resid_roll_std_6",
    "raw_z",
    "explained_ratio",
)
SUBTLE = ("none", "calibration_drift", "meteorological_artefact")


def residual_features(residuals: DataFrame, at_most: int | None = None) -> DataFrame:
    """Nine features per cell: size, sign, trend and noise of the residual in its own series.

    `residuals` has one row per cell: station_id, parameter, timestamp_utc, actual, residual.
    """
    a, r = F.col("actual"), F.col("residual")
    stats = residuals.groupBy(*SERIES).agg(
        F.when(F.min(r) == F.max(r), 0.0).otherwise(F.stddev_pop(r)).alias("_rs"),
        F.when(F.min(a) == F.max(a), 0.0).otherwise(F.stddev_pop(a)).alias("_as"),
    )
    med = scan.exact_median(residuals, SERIES, "actual", "_med", at_most)
    blocked = scan.assign_blocks(residuals, SERIES, seq=None, at_most=at_most)
    rows = scan.ordered_scan(blocked, SERIES, ["timestamp_utc"], sums={"_rn": F.lit(1).cast("bigint")})
    rows, part = scan.rolling_frame(scan.drop_blocks(rows), SERIES, "_rn", 24)
    w = W.partitionBy(*part).orderBy("_rn")
    six, day = w.rowsBetween(-5, 0), w.rowsBetween(-23, 0)
    spread6 = F.when(F.min(r).over(six) == F.max(r).over(six), 0.0).otherwise(F.stddev_pop(r).over(six))
    rows = rows.withColumns(
        {"resid_roll_mean_6": F.avg(r).over(six), "resid_roll_mean_24": F.avg(r).over(day), "resid_roll_std_6": spread6}
    ).where("NOT _halo")
    one = lambda c: F.coalesce(F.nullif(F.col(c), F.lit(0.0)), F.lit(1.0))
    rows = rows.join(stats, SERIES).join(med, SERIES)
    away = F.abs(a - F.col("_med"))
    ratio = 1.0 - F.abs(r) / (away + 1e-9)
    return rows.withColumns(
        {
            "resid_z": r / one("_rs"),
            "resid_abs_z": F.abs(r / one("_rs")),
            "resid_trend": F.col("resid_roll_mean_6") - F.col("resid_roll_mean_24"),
            "raw_z": (a - F.col("_med")) / one("_as"),
            "explained_ratio": F.least(F.greatest(ratio, F.lit(0.0)), F.lit(1.0)),
        }
    ).select(*CELL, *FEATURES)


def artefacts(features: DataFrame) -> DataFrame:
    """High readings that the weather explains."""
    return features.where(
        (F.col("raw_z") > C.METEO_RAW_Z) & (F.col("resid_abs_z") < C.METEO_RESID_ABS_Z)
    ).select(*CELL)


def rule_classes(defects: DataFrame) -> DataFrame:
    """The class that deterministic flags force on a present cell; the strongest wins."""
    rank = lookup({c: p for c, (_, p) in C.RULE_CLASSES.items()}, F.col("reason_code"))
    name = lookup({c: n for c, (n, _) in C.RULE_CLASSES.items()}, F.col("reason_code"))
    forced = defects.where(F.col("reason_code").isin(list(C.RULE_CLASSES)) & (F.col("reason_code") != "R02"))
    return forced.groupBy(*CELL).agg(F.min_by(name, rank).alias("fault_class"))


def gap_starts(defects: DataFrame) -> DataFrame:
    return defects.where("reason_code = 'R02'").select(*CELL).distinct()


def classify(features: DataFrame, defects: DataFrame, model=None) -> DataFrame:
    """One row per assessed cell: rule class with confidence 1, else the model's best class.

    `model` maps a feature frame to the same rows with fault_class and confidence; without one
    every cell no rule speaks for is `none`. Outages are appended at their start.
    """
    rules = rule_classes(defects)
    by_rule = features.select(*CELL).join(rules, CELL).withColumns(
        {"source": F.lit("rule"), "confidence": F.lit(1.0)}
    )
    rest = features.join(rules.select(*CELL), CELL, "left_anti")
    if model is None:
        learned = rest.select(*CELL).withColumns(
            {"fault_class": F.lit("none"), "source": F.lit("rule"), "confidence": F.lit(1.0)}
        )
    else:
        learned = model(rest).select(*CELL, "fault_class", F.lit("ml").alias("source"), "confidence")
    gone = gap_starts(defects).withColumns(
        {"fault_class": F.lit("communication_failure"), "source": F.lit("rule"), "confidence": F.lit(1.0)}
    )
    return by_rule.unionByName(learned).unionByName(gone)


# Kind, instance, of how many, station index, parameter.
SIGNATURES = (
    ("drift", 0, 5, 0, "PM10"),
    ("drift", 1, 5, 2, "NO2"),
    ("drift", 2, 5, 4, "O3"),
    ("drift", 3, 5, 1, "CO"),
    ("drift", 4, 5, 3, "PM10"),
    ("gain", 0, 3, 1, "PM10"),
    ("gain", 1, 3, 3, "NO2"),
    ("gain", 2, 3, 5, "O3"),
    ("dropout", 0, 3, 2, "CO"),
    ("dropout", 1, 3, 4, "PM10"),
    ("dropout", 2, 3, 0, "NO2"),
    ("flatline", 0, 2, 5, "PM10"),
    ("flatline", 1, 2, 3, "O3"),
)
SIGNATURE_CLASS = {
    "drift": "calibration_drift",
    "gain": "physically_impossible",
    "dropout": "communication_failure",
    "flatline": "frozen",
}
DRIFT_ROWS, DROPOUT_ROWS, DROPOUT_MARGIN, GAIN = 60, 10, 16, 100.0


def signature_table(spark: SparkSession) -> DataFrame:
    return literal_table(
        spark, SIGNATURES, "kind string, instance bigint, n_instances bigint, station_ix bigint, parameter string"
    )


def labelled(readings: DataFrame, at_most: int | None = None) -> DataFrame:
    """The readings with known faults planted: drift ramps, gain errors, dropouts and flatlines.

    Every row keeps `clean_value`, the `signature` that touched it and `removed` for dropouts;
    drop the removed rows to get the training corpus. The three free gain rows are those with
    the smallest hash of their position, so the choice needs no random state.
    """
    spark = readings.sparkSession
    ids = readings.select("station_id").distinct()
    ix = W.orderBy("station_id")
    targets = (
        ids.withColumn("station_ix", (F.row_number().over(ix) - 1).cast("bigint"))
        .join(signature_table(spark), "station_ix")
        .drop("station_ix")
    )
    n_hours = readings.select("timestamp_utc").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    hit = readings.join(targets, SERIES)
    hit = scan.assign_blocks(hit, SERIES, at_most=at_most)
    hit = scan.drop_blocks(
        scan.ordered_scan(hit, SERIES, ["timestamp_utc", "ingest_seq"], sums={"_rn": F.lit(1).cast("bigint")})
    ).withColumn("_row", F.col("_rn") - 1)
    size = hit.groupBy(*SERIES).agg(
        F.max("_rn").alias("_n"), F.min_by("value", "_rn").alias("_first")
    )
    hit = hit.join(size, SERIES).withColumn("_hours", n_hours)
    window = F.when(F.col("kind") == "drift", DRIFT_ROWS).otherwise(DROPOUT_ROWS)
    margin = F.when(F.col("kind") == "dropout", DROPOUT_MARGIN).otherwise(0)
    room = F.greatest(F.lit(0), F.col("_hours") - window - margin)
    start = F.round(F.col("instance") * room / F.greatest(F.lit(1), F.col("n_instances") - 1))
    start = F.when(F.col("kind") == "dropout", F.greatest(F.lit(1), start)).otherwise(start).cast("bigint")
    hit = hit.withColumn("_start", start).withColumn("_j", F.col("_row") - F.col("_start"))
    long_enough = (
        F.when(F.col("kind") == "drift", F.col("_n") >= DRIFT_ROWS + 2)
        .when(F.col("kind") == "gain", F.col("_n") >= 6)
        .when(F.col("kind") == "dropout", F.col("_n") >= DROPOUT_ROWS + 2)
        .otherwise(F.col("_n") >= 2)
    )
    hit = hit.where(long_enough)
    inner = (F.col("_row") >= 1) & (F.col("_row") <= F.col("_n") - 2)
    draw = F.when((F.col("kind") == "gain") & inner, F.md5(F.concat_ws(":", *SERIES, F.col("_row").cast("string"))))
    lots = (
        hit.where(draw.isNotNull())
        .select(*SERIES, "_row", draw.alias("_draw"))
        .withColumn("_lot", F.row_number().over(W.partitionBy(*SERIES).orderBy("_draw")))
        .where("_lot <= 3")
        .select(*SERIES, "_row", F.lit(True).alias("_drawn"))
    )
    hit = hit.join(lots, [*SERIES, "_row"], "left")
    inside = F.col("_j").between(0, window - 1)
    touched = (
        F.when(F.col("kind").isin("drift", "dropout"), inside)
        .when(F.col("kind") == "gain", F.coalesce("_drawn", F.lit(False)) | (F.col("_row") == F.col("_n") - 2))
        .otherwise(True)
    )
    hit = hit.withColumn("_on", touched)
    base = hit.where("_on AND kind = 'drift'").groupBy(*SERIES).agg(F.avg("value").alias("_base"))
    hit = hit.join(base, SERIES, "left")
    v = F.col("value")
    planted = (
        F.when(~F.col("_on"), v)
        .when(F.col("kind") == "drift", v + F.col("_j") * 0.9 * F.col("_base") / DRIFT_ROWS)
        .when(F.col("kind") == "gain", v * GAIN)
        .when(F.col("kind") == "flatline", F.col("_first"))
        .otherwise(v)
    )
    marks = hit.select(
        "ingest_seq",
        *SERIES,
        planted.alias("_planted"),
        F.when(F.col("_on"), F.col("kind")).alias("signature"),
        (F.col("_on") & (F.col("kind") == "dropout")).alias("_removed"),
    )
    return readings.join(marks, [*SERIES, "ingest_seq"], "left").select(
        *CELL,
        "ingest_seq",
        v.alias("clean_value"),
        F.when(F.col("_removed").isNotNull(), F.col("_planted")).otherwise(v).alias("value"),
        "signature",
        lookup(SIGNATURE_CLASS, F.col("signature")).alias("fault_class"),
        F.coalesce("_removed", F.lit(False)).alias("removed"),
    )


def confusion(judged: DataFrame, spark: SparkSession) -> DataFrame:
    """Counts for every (true, predicted) pair of classes, zero pairs included."""
    names = literal_table(spark, [(c,) for c in C.FAULT_CLASSES], "true_class string")
    frame = names.withColumn("predicted_class", F.explode(F.array(*[F.lit(c) for c in C.FAULT_CLASSES])))
    n = judged.groupBy("true_class", "predicted_class").agg(F.count(F.lit(1)).alias("n"))
    return frame.join(n, ["true_class", "predicted_class"], "left").fillna({"n": 0})


def class_metrics(matrix: DataFrame) -> DataFrame:
    """Precision, recall and support per class; 0 where there is nothing to divide by."""
    side = lambda c: matrix.groupBy(F.col(c).alias("fault_class")).agg(F.sum("n").alias(c))
    tp = matrix.where("true_class = predicted_class").select(F.col("true_class").alias("fault_class"), F.col("n").alias("tp"))
    j = tp.join(side("true_class"), "fault_class").join(side("predicted_class"), "fault_class")
    share = lambda c: F.coalesce(F.round(F.col("tp") / F.nullif(F.col(c), F.lit(0)), 4), F.lit(0.0))
    return j.select(
        "fault_class",
        share("predicted_class").alias("precision"),
        share("true_class").alias("recall"),
        F.col("true_class").alias("support"),
    )


def signature_recall(marks: DataFrame, predicted: DataFrame, gaps: DataFrame, since) -> DataFrame:
    """Recall per planted signature after `since`: by cell, but by outage for dropouts."""
    m = marks.where(F.col("signature").isNotNull() & (F.col("timestamp_utc") >= since))
    cells = (
        m.where("signature <> 'dropout'")
        .select(*CELL, "signature", "fault_class")
        .distinct()
        .join(predicted.select(*CELL, F.col("fault_class").alias("_p")), CELL)
        .groupBy("signature")
        .agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("_p") == F.col("fault_class")).alias("hits"))
    )
    drops = m.where("signature = 'dropout'").select(*CELL, "signature").distinct()
    found = drops.join(gaps.select(*CELL, F.lit(1).alias("_g")), CELL, "left")
    outages = (
        found.groupBy(*SERIES, "signature")
        .agg(F.max("_g").alias("_g"))
        .groupBy("signature")
        .agg(F.count(F.lit(1)).alias("total"), F.count("_g").alias("hits"))
    )
    return cells.unionByName(outages).withColumn("recall", F.round(F.col("hits") / F.col("total"), 4))


def floors_met(recall: DataFrame, metrics: DataFrame) -> DataFrame:
    """Each quality floor with its measured value."""
    need = lookup(C.RECALL_FLOORS, F.col("signature"))
    r = recall.select(F.col("signature").alias("measure"), F.col("recall").alias("value"), need.alias("floor"))
    p = metrics.where("fault_class = 'meteorological_artefact'").select(
        F.lit("artefact_precision").alias("measure"),
        F.col("precision").alias("value"),
        F.lit(C.ARTEFACT_PRECISION_FLOOR).alias("floor"),
    )
    return r.unionByName(p).withColumn("met", F.col("value") >= F.col("floor"))
