"""Maximal runs: of equal values, of consecutive instants, of flagged cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationproof import config as C
from stationproof.functions import scan
from stationproof.functions.columns import SERIES, secs

ORDER = ["timestamp_utc", "ingest_seq"]


def equal_value_rows(
    df: DataFrame, keys: list[str], value: str, order=None, at_most: int | None = None
) -> DataFrame:
    """Rows with `_run`, the number of their run of equal values; a null is a run of its own."""
    v = F.col(value)
    blocked = scan.assign_blocks(df, keys, at_most=at_most)
    return scan.islands(
        blocked,
        keys,
        order or ORDER,
        lambda: v.isNull() | F.col("_pv").isNull() | (v != F.col("_pv")),
        {"_pv": v},
    )


def equal_value_runs(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    rows = equal_value_rows(df, keys, value)
    return rows.groupBy(*keys, "_run").agg(
        F.min("timestamp_utc").alias("start_utc"),
        F.max("timestamp_utc").alias("end_utc"),
        F.count(F.lit(1)).alias("run_length"),
        F.min(value).alias(value),
    )


def consecutive_runs(
    points: DataFrame, keys: list[str], cadence_s: str = "cadence_s", at_most: int | None = None
) -> DataFrame:
    """Runs of distinct instants spaced exactly one cadence; needs a cadence column."""
    blocked = scan.assign_blocks(points, keys, seq=None, at_most=at_most)
    rows = scan.islands(
        blocked,
        keys,
        ["timestamp_utc"],
        lambda: F.col("_ps").isNull()
        | (secs("timestamp_utc") - F.col("_ps") != F.col(cadence_s)),
        {"_ps": secs("timestamp_utc")},
    )
    return rows.groupBy(*keys, "_run").agg(
        F.min("timestamp_utc").alias("start_utc"),
        F.max("timestamp_utc").alias("end_utc"),
        F.count(F.lit(1)).alias("n_cells"),
    )


def with_cadence(df: DataFrame, series: DataFrame) -> DataFrame:
    return df.join(series.select(*SERIES, "cadence_s"), SERIES, "left").fillna(
        {"cadence_s": C.DEFAULT_CADENCE_S}
    )


def episodes(defects: DataFrame, series: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Defects collapsed to one row per outage: per code, a run at the series cadence."""
    keys = [*SERIES, "reason_code", "severity", *(extra or [])]
    points = defects.select(*keys, "timestamp_utc").distinct()
    return consecutive_runs(with_cadence(points, series), keys).drop("_run")


def range_runs(ranges: DataFrame, at_most: int | None = None) -> DataFrame:
    """Runs of absent ticks from tick ranges: neighbours merge where no grid tick was observed."""
    keys = [*SERIES, "start_s", "cadence_s"]
    pts = ranges.withColumn(
        "timestamp_utc",
        F.timestamp_seconds(F.col("start_s") + F.col("k_lo") * F.col("cadence_s")).cast("timestamp_ntz"),
    )
    rows = scan.islands(
        scan.assign_blocks(pts, SERIES, seq=None, at_most=at_most),
        SERIES,
        ["timestamp_utc"],
        lambda: F.col("_ph").isNull() | (F.col("k_lo") != F.col("_ph") + 1),
        {"_ph": F.col("k_hi")},
    )
    return rows.groupBy(*keys, "_run").agg(
        F.min("k_lo").alias("k_lo"),
        F.max("k_hi").alias("k_hi"),
        F.sum(F.col("k_hi") - F.col("k_lo") + 1).alias("n_ticks"),
    )
