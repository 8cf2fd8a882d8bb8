"""From flags to findings: the defect rate, its breakdowns and what deserves attention."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stationproof import __version__
from stationproof import config as C
from stationproof import registry
from stationproof.functions import state
from stationproof.functions.columns import CELL, iso, lookup
from stationproof.operators import canonical, coverage, detectors
from stationproof.operators.coverage import Coverage

# Code -> (category, how many are kept, priority).
NOTABLE = {
    "R07": ("physical_exceedance", 5, 0),
    "R09": ("cross_parameter", 5, 1),
    "R02": ("communication_outage", 5, 2),
    "R12": ("frozen_sensor", 5, 3),
    "R14": ("step_change", 5, 4),
    "R21": ("dead_sensor", 3, 5),
}


def defective_cells(defects: DataFrame) -> DataFrame:
    return defects.where(registry.counts("reason_code")).select(*CELL).distinct()


def defect_rate(defects: DataFrame, series: DataFrame) -> DataFrame:
    """Distinct cells with a counting flag over covered cells."""
    covered = series.agg(F.coalesce(F.sum("n_expected"), F.lit(0)).alias("x")).scalar()
    n = defective_cells(defects).agg(F.count(F.lit(1)).alias("n_defective_cells"))
    out = n.withColumn("n_covered_cells", covered)
    rate = F.when(
        F.col("n_covered_cells") > 0, F.col("n_defective_cells") / F.col("n_covered_cells")
    ).otherwise(0.0)
    return out.withColumn("defect_rate", F.round(rate, 6))


def rate_violations(rate: DataFrame) -> DataFrame:
    """Cells flagged off the grid can exceed the covered cells; such a rate is no rate."""
    return rate.where("n_defective_cells > n_covered_cells")


def defect_rate_by_station(defects: DataFrame, series: DataFrame) -> DataFrame:
    covered = series.groupBy("station_id").agg(F.sum("n_expected").alias("n_covered_cells"))
    bad = defective_cells(defects).groupBy("station_id").agg(
        F.count(F.lit(1)).alias("n_defective_cells")
    )
    return covered.join(bad, "station_id", "left").fillna({"n_defective_cells": 0}).withColumn(
        "defect_rate", F.round(F.col("n_defective_cells") / F.col("n_covered_cells"), 6)
    )


def breakdowns(defects: DataFrame) -> DataFrame:
    """Flag counts by code (all flags) and by station, parameter and day (counting flags)."""
    counting = registry.counts("reason_code")
    dim = lambda name, key: F.struct(F.lit(name).alias("dimension"), key.alias("key"))
    dims = F.concat(
        F.array(dim("code", F.col("reason_code"))),
        F.when(
            counting,
            F.array(
                dim("station", F.col("station_id")),
                dim("parameter", F.col("parameter")),
                dim("day", F.date_format("timestamp_utc", "yyyy-MM-dd")),
            ),
        ).otherwise(F.array().cast("array<struct<dimension:string,key:string>>")),
    )
    return (
        defects.select(F.inline(dims)).groupBy("dimension", "key").agg(F.count(F.lit(1)).alias("n_flags"))
    )


def coverage_summary(cov: Coverage, structural: DataFrame) -> DataFrame:
    s = cov.series.agg(
        F.count_distinct("station_id").alias("n_stations"),
        F.count_distinct("parameter").alias("n_parameters"),
        F.count(F.lit(1)).alias("n_covered_pairs"),
        F.sum("n_rows").alias("_rows"),
        F.sum("n_values").alias("_values"),
        F.min("start").alias("window_start"),
        F.max("end").alias("window_end"),
    )
    t = coverage.totals(cov, structural)
    both = s.withColumn("_k", F.lit(1)).join(t.withColumn("_k", F.lit(1)), "_k").drop("_k")
    pct = lambda a, b: F.when(F.col(b) > 0, F.round(100.0 * F.col(a) / F.col(b), 4)).otherwise(0.0)
    return both.withColumns(
        {
            "conventional_completeness_pct": pct("_values", "_rows"),
            "grid_completeness_pct": pct("n_observed_cells", "n_covered_cells"),
        }
    ).drop("_rows", "_values")


def network_wide(defects: DataFrame, cov: Coverage, min_fraction: float = C.NETWORK_WIDE_FRACTION) -> DataFrame:
    """A counting code that hits every carrier of a parameter on nearly all its readings."""
    flagged = (
        defects.where(registry.counts("reason_code")).select("reason_code", *CELL).distinct()
    )
    present = (
        cov.readings.where(F.col("value").isNotNull())
        .select(*CELL)
        .distinct()
        .withColumn("_here", F.lit(1))
    )
    hits = (
        flagged.join(present, CELL, "left")
        .groupBy("reason_code", "parameter")
        .agg(
            F.count(F.lit(1)).alias("flagged_readings"),
            F.count_distinct("station_id").alias("station_count"),
            F.count_if(F.col("_here").isNull()).alias("_gone"),
        )
        .where("_gone = 0")
    )
    total = cov.series.groupBy("parameter").agg(
        F.count(F.lit(1)).alias("_carriers"), F.sum("n_values").alias("total_readings")
    )
    fraction = F.col("flagged_readings") / F.col("total_readings")
    return (
        hits.join(total, "parameter")
        .where((F.col("station_count") == F.col("_carriers")) & (F.col("total_readings") > 0))
        .where(fraction >= min_fraction)
        .select(
            "reason_code",
            "parameter",
            "station_count",
            "flagged_readings",
            "total_readings",
            F.round(fraction, 6).alias("fraction"),
        )
    )


def notable_events(defects: DataFrame) -> DataFrame:
    """The few largest defects of each category, ranked by category and size."""
    col = lambda i: lookup({k: v[i] for k, v in NOTABLE.items()}, F.col("reason_code"))
    best = W.partitionBy("reason_code").orderBy(
        F.col("rank_value").desc(), "station_id", "parameter", "timestamp_utc"
    )
    top = (
        defects.where(F.col("reason_code").isin(list(NOTABLE)))
        .withColumn("_rn", F.row_number().over(best))
        .where(F.col("_rn") <= max(v[1] for v in NOTABLE.values()))
        .where(F.col("_rn") <= col(1))
    )
    key = W.partitionBy("reason_code", *CELL).orderBy("_rn")
    once = top.withColumn("_dup", F.row_number().over(key)).where("_dup = 1")
    order = W.orderBy(col(2), F.col("rank_value").desc(), "station_id", "parameter", "timestamp_utc")
    sentence = lookup(registry.SENTENCE, F.col("reason_code"))
    return once.select(
        F.row_number().over(order).cast("bigint").alias("rank"),
        col(0).alias("category"),
        "reason_code",
        *CELL,
        "severity",
        "rank_value",
        "evidence",
        registry.render(sentence, F.col("evidence"), F.col("parameter")).alias("headline"),
    )


def defect_sentences(defects: DataFrame) -> DataFrame:
    sentence = lookup(registry.SENTENCE, F.col("reason_code"))
    return defects.withColumn(
        "sentence", registry.render(sentence, F.col("evidence"), F.col("parameter"))
    )


def defect_records(defects: DataFrame) -> DataFrame:
    return defects.select(
        "station_id",
        "parameter",
        iso("timestamp_utc").alias("timestamp_utc"),
        "reason_code",
        "severity",
        F.to_json("evidence").alias("evidence"),
    )


def config_hash() -> str:
    """Hash of every threshold and weight a run depends on."""
    values = {k: v for k, v in vars(C).items() if k.isupper()}
    text = json.dumps(values, sort_keys=True, ensure_ascii=False, default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def run_meta(hashed: DataFrame, config: str | None = None) -> DataFrame:
    """One row that identifies a run: code, configuration, data and size."""
    return canonical.checksum(hashed).select(
        F.lit(__version__).alias("code_version"),
        F.lit(config or config_hash()).alias("config_hash"),
        F.col("checksum").alias("data_checksum"),
        "n_rows",
        F.concat(F.lit("ar_"), "checksum", F.lit("_"), F.lit((config or config_hash())[:8])).alias("audit_run_id"),
    )


def run_audit(readings: DataFrame, materialise: bool = True, **rules) -> dict[str, DataFrame]:
    """The whole audit as lazy frames; with `materialise` the shared parts are written once.

    Lineage is cut behind the series table and the defect frame, the two frames that every
    section reads, so neither a lost executor nor the next section recomputes them.
    """
    cov = coverage.build(readings)
    absences = coverage.structural_absences(cov.readings, cov.series, cov.n_rows)
    defects = detectors.run_all(cov, **rules)
    if materialise:
        defects = state.cut(defects)
    return {
        "series": cov.series,
        "defects": defects,
        "defect_rate": defect_rate(defects, cov.series),
        "coverage": coverage_summary(cov, absences),
        "breakdowns": breakdowns(defects),
        "structural_absences": absences,
        "notable_events": notable_events(defects),
        "network_wide": network_wide(defects, cov),
    }
