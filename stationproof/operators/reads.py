"""Read queries over the stored tables: filters, keyset pages and per-station summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationproof import registry
from stationproof.functions.columns import CELL

MAX_PAGE = 500


def between(df: DataFrame, ts: str = "timestamp_utc", start=None, end=None) -> DataFrame:
    if start is not None:
        df = df.where(F.col(ts) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        df = df.where(F.col(ts) <= F.lit(end).cast("timestamp_ntz"))
    return df


def page(df: DataFrame, keys: list[str], after: tuple | None = None, limit: int = 100) -> DataFrame:
    """The next rows after a cursor in key order: a bounded top-k, not a sort of the table."""
    if not 0 < limit <= MAX_PAGE:
        raise ValueError(f"a page holds 1 to {MAX_PAGE} rows, not {limit}; go on from the last key with `after`")
    if after is not None:
        types = dict(df.dtypes)
        here = F.struct(*[F.col(k) for k in keys])
        cursor = F.struct(*[F.lit(v).cast(types[k]).alias(k) for k, v in zip(keys, after)])
        df = df.where(here > cursor)
    return df.orderBy(*keys).limit(limit)


def readings_page(stored: DataFrame, station=None, parameter=None, start=None, end=None, after=None, limit=100) -> DataFrame:
    for col, v in (("station_id", station), ("parameter", parameter)):
        if v is not None:
            stored = stored.where(F.col(col) == v)
    return page(between(stored, start=start, end=end), ["timestamp_utc", "row_hash"], after, limit)


def annotate(rows: DataFrame, defects: DataFrame) -> DataFrame:
    """Readings with the reason codes of their cell; at most one entry per code."""
    codes = defects.select(*CELL, "reason_code").distinct().groupBy(*CELL).agg(
        F.sort_array(F.collect_list("reason_code")).alias("reason_codes")
    )
    empty = F.array().cast("array<string>")
    return rows.join(codes, CELL, "left").withColumn("reason_codes", F.coalesce("reason_codes", empty))


def defects_page(defects: DataFrame, code=None, station=None, severity=None, start=None, end=None, after=None, limit=100) -> DataFrame:
    for col, v in (("reason_code", code), ("station_id", station), ("severity", severity)):
        if v is not None:
            defects = defects.where(F.col(col) == v)
    return page(between(defects, start=start, end=end), ["timestamp_utc", "station_id", "parameter", "reason_code"], after, limit)


def last_reading(stored: DataFrame) -> DataFrame:
    return stored.groupBy("station_id").agg(F.max("timestamp_utc").alias("last_reading_at"))


def latest_trust(scores: DataFrame) -> DataFrame:
    rest = [c for c in scores.columns if c not in ("station_id", "timestamp_utc")]
    return scores.groupBy("station_id").agg(
        F.max("timestamp_utc").alias("timestamp_utc"),
        *[F.max_by(c, "timestamp_utc").alias(c) for c in rest],
    )


def trust_series(scores: DataFrame, station: str, start=None, end=None, after=None, limit: int | None = None) -> DataFrame:
    """Scores of a station in time order: whole, or a page after the instant `after`."""
    out = between(scores.where(F.col("station_id") == station), start=start, end=end)
    if limit is None and after is None:
        return out.orderBy("timestamp_utc")
    return page(out, ["timestamp_utc"], None if after is None else (after,), MAX_PAGE if limit is None else limit)


def quality_summary(
    stations: DataFrame, defects: DataFrame, readings: DataFrame, scores: DataFrame, start=None, end=None
) -> DataFrame:
    """Per station: health, trust, flags, parameters, last reading and uptime in the window.

    `stations` has station_id, zone_type and n_parameters. Without both window ends there is
    nothing to divide by and the uptime stays null.
    """
    flags = defects.where(registry.counts("reason_code")).groupBy("station_id").agg(
        F.count(F.lit(1)).alias("flag_count")
    )
    w = between(defects, start=start, end=end).groupBy("station_id").agg(
        F.count_if(F.col("reason_code") == "R01").alias("absent_cells"),
        F.max(F.when(F.col("reason_code") == "R15", F.col("timestamp_utc"))).alias("last_calibration_at"),
    )
    t = latest_trust(scores.select("station_id", "timestamp_utc", "trust", "components", "reason_codes"))
    health = F.element_at(F.filter("components", lambda c: c["name"] == "HealthConf"), 1)["value"]
    t = t.select("station_id", "trust", health.alias("health"), "reason_codes")
    out = (
        stations.join(flags, "station_id", "left")
        .join(w, "station_id", "left")
        .join(t, "station_id", "left")
        .join(last_reading(readings), "station_id", "left")
        .fillna({"flag_count": 0, "absent_cells": 0})
    )
    if start is None or end is None:
        return out.withColumn("uptime_pct", F.lit(None).cast("double"))
    hours = F.timestamp_diff("SECOND", F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")) / 3600.0
    expected = hours * F.col("n_parameters")
    up = F.when(expected > 0, F.greatest(F.lit(0.0), 100.0 * (1 - F.col("absent_cells") / expected)))
    return out.withColumn("uptime_pct", up)


def appendix(signoffs: DataFrame, dispatched: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sign-offs and dispatches that concern the events of one run."""
    ids = events.select("event_id").distinct()
    return signoffs.join(ids, "event_id", "left_semi"), dispatched.join(ids, "event_id", "left_semi")
