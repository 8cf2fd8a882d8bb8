"""What each series should have delivered, what it delivered and what it never could.

Absent ticks are kept as ranges of tick numbers between neighbouring readings, so counting
them, finding outages and clipping them to windows is arithmetic; ticks are enumerated only
where a row per tick is the result.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationproof import config as C
from stationproof.functions import scan
from stationproof.functions.columns import CELL, SERIES, at_secs, micros, secs
from stationproof.functions.state import cut

TICK_CHUNK = 10_000


class Coverage(NamedTuple):
    readings: DataFrame
    series: DataFrame
    gap_ranges: DataFrame
    n_rows: int | None = None


def cells(readings: DataFrame) -> DataFrame:
    """One row per (station, parameter, instant) with its number of readings."""
    return readings.groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("n_readings"), F.count("value").alias("n_values")
    )


def gaps(points: DataFrame, keys: list[str], at_most: int | None = None) -> DataFrame:
    """Distances between neighbouring distinct instants in seconds: keys, prev_s, ts_s.

    Instants may lie within one second; such a pair has prev_s = ts_s.
    """
    distinct = points.select(*keys, "timestamp_utc").distinct()
    blocked = scan.assign_blocks(distinct, keys, seq=None, at_most=at_most)
    out = scan.ordered_scan(
        blocked, keys, ["timestamp_utc"], lags={"prev_us": micros("timestamp_utc")}
    )
    out = out.where(F.col("prev_us") < micros("timestamp_utc"))
    return out.select(*keys, F.expr("prev_us div 1000000").alias("prev_s"), secs("timestamp_utc").alias("ts_s"))


def infer_cadence(gap: DataFrame, keys: list[str]) -> DataFrame:
    """Most frequent gap of whole seconds, the smallest on ties; every distinct instant counts as observed."""
    freq = gap.groupBy(*keys, (F.col("ts_s") - F.col("prev_s")).alias("gap_s")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return freq.groupBy(*keys).agg(
        F.min_by(F.when(F.col("gap_s") > 0, F.col("gap_s")), F.struct(F.col("gap_s") <= 0, -F.col("n"), F.col("gap_s"))).alias("cadence_s"),
        (F.sum("n") + 1).alias("n_observed"),
    )


def cadence(readings: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Cadence of every series; the default where a series has one instant only."""
    keys = keys or SERIES
    found = infer_cadence(gaps(readings, keys), keys).drop("n_observed")
    return (
        readings.select(*keys)
        .distinct()
        .join(found, keys, "left")
        .fillna({"cadence_s": C.DEFAULT_CADENCE_S})
    )


def series_grid(readings: DataFrame, gap: DataFrame | None = None) -> DataFrame:
    """Per series: cadence, span, expected and observed instants, and value statistics."""
    gap = gaps(readings, SERIES) if gap is None else gap
    v = F.col("value")
    first = F.struct("timestamp_utc", "ingest_seq")
    stats = readings.groupBy(*SERIES).agg(
        F.min("timestamp_utc").alias("start"),
        F.max("timestamp_utc").alias("end"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count(v).alias("n_values"),
        F.min(v).alias("v_min"),
        F.max(v).alias("v_max"),
        F.stddev_pop(v).alias("v_std"),
        F.min_by("unit", first).alias("unit"),
    )
    out = stats.join(infer_cadence(gap, SERIES), SERIES, "left").fillna(
        {"n_observed": 1, "cadence_s": C.DEFAULT_CADENCE_S}
    )
    span = secs("end") - secs("start")
    return out.withColumns(
        {
            "n_expected": (F.floor(span / F.col("cadence_s")) + 1).cast("bigint"),
            # a constant series has no spread, whatever the accumulated rounding says
            "v_std": F.when(F.col("n_values") < 2, 0.0)
            .when(F.col("v_min") == F.col("v_max"), 0.0)
            .otherwise(F.col("v_std")),
        }
    )


def gap_ranges(gap: DataFrame, series: DataFrame) -> DataFrame:
    """Grid ticks strictly between two neighbouring readings, as tick-number ranges.

    Ticks count from the series start, so this holds for readings off the grid too.
    """
    g = gap.join(
        series.select(*SERIES, "cadence_s", secs("start").alias("start_s")), SERIES
    )
    lo = F.floor((F.col("prev_s") - F.col("start_s")) / F.col("cadence_s")) + 1
    hi = F.ceil((F.col("ts_s") - F.col("start_s")) / F.col("cadence_s")) - 1
    return g.select(
        *SERIES,
        "start_s",
        "cadence_s",
        lo.cast("bigint").alias("k_lo"),
        hi.cast("bigint").alias("k_hi"),
    ).where("k_hi >= k_lo")


def build(readings: DataFrame, keep: bool = True) -> Coverage:
    """Coverage of a network. The series table, one row per series, is computed once and kept:
    every detector reads it. So do all of them read the readings, which are written once instead of
    being derived from their sources a dozen times; `keep` off for readings that are a stored table already."""
    readings = cut(readings) if keep else readings
    n = readings.count()
    gap = gaps(readings, SERIES, n)
    series = cut(series_grid(readings, gap))
    return Coverage(readings, series, gap_ranges(gap, series), n)


def absent_ticks(ranges: DataFrame) -> DataFrame:
    """One row per absent tick. Long ranges are expanded in chunks, never as one array."""
    chunks = ranges.withColumn(
        "_from",
        F.explode(F.sequence(F.col("k_lo"), F.col("k_hi"), F.lit(TICK_CHUNK).cast("bigint"))),
    )
    upto = F.least(F.col("k_hi"), F.col("_from") + TICK_CHUNK - 1)
    ticks = chunks.withColumn("k", F.explode(F.sequence(F.col("_from"), upto)))
    return ticks.select(
        *SERIES,
        at_secs(F.col("start_s") + F.col("k") * F.col("cadence_s")).alias("timestamp_utc"),
    )


def n_stations(readings: DataFrame) -> Column:
    return readings.agg(F.count_distinct("station_id")).scalar()


def bounds(readings: DataFrame) -> DataFrame:
    """One row: first and last instant of the whole network."""
    return readings.agg(
        F.min("timestamp_utc").alias("global_start"), F.max("timestamp_utc").alias("global_end")
    )


def standard_parameters(series: DataFrame, majority: float = C.STANDARD_MAJORITY) -> DataFrame:
    """Parameters carried by at least half of the stations."""
    need = F.ceil(F.lit(majority) * n_stations(series))
    return (
        series.groupBy("parameter")
        .agg(F.count_distinct("station_id").alias("n_carriers"))
        .where(F.col("n_carriers") >= need)
    )


def domain_of(source: Column) -> Column:
    out = F
    for token, domain in C.FILE_DOMAINS:
        out = out.when(source.contains(token), domain)
    for word in C.DOMAIN_WORDS:
        out = out.when(F.lower(source).contains(word), word)
    return out.otherwise("unknown")


def parameter_domain(readings: DataFrame) -> DataFrame:
    """Domain of a parameter, read from the name of the first file that carries it."""
    first = F.struct("station_id", "timestamp_utc", "ingest_seq")
    src = readings.groupBy("parameter").agg(F.min_by("source_file", first).alias("source_file"))
    return src.select("parameter", domain_of(F.col("source_file")).alias("domain"))


def structural_absences(
    readings: DataFrame, series: DataFrame, at_most: int | None = None
) -> DataFrame:
    """Standard parameters a station never carried: R19 if its whole domain is missing, else R18."""
    net = infer_cadence(gaps(readings, ["parameter"], at_most), ["parameter"])
    b = bounds(series.select(F.col("start").alias("timestamp_utc")).union(series.select("end")))
    start, end = (secs(b.select(c).scalar()) for c in ("global_start", "global_end"))
    standard = (
        standard_parameters(series)
        .join(parameter_domain(readings), "parameter")
        .join(net, "parameter", "left")
        .fillna({"cadence_s": C.DEFAULT_CADENCE_S})
        .withColumn(
            "excluded_cells", (F.floor((end - start) / F.col("cadence_s")) + 1).cast("bigint")
        )
    )
    # parameters are a closed list, so this array is short
    listed = standard.agg(
        F.collect_list(F.struct("parameter", "domain", "excluded_cells")).alias("a")
    ).scalar()
    wanted = (
        series.select("station_id")
        .distinct()
        .withColumn("_all", listed)
        .select("station_id", F.inline("_all"))
    )
    missing = wanted.join(series.select(*SERIES), SERIES, "left_anti")
    size = standard.groupBy("domain").agg(F.count(F.lit(1)).alias("_size"))
    lacking = missing.groupBy("station_id", "domain").agg(F.count(F.lit(1)).alias("_lack"))
    whole = (F.col("_lack") == F.col("_size")) & (F.col("_size") > 1)
    return (
        missing.join(lacking, ["station_id", "domain"])
        .join(size, "domain")
        .select(
            *SERIES,
            "domain",
            F.when(whole, "R19").otherwise("R18").alias("reason_code"),
            "excluded_cells",
        )
    )


def coverage_matrix(readings: DataFrame, parameters: list[str]) -> DataFrame:
    return (
        readings.groupBy("station_id").pivot("parameter", parameters).agg(F.count("value")).na.fill(0)
    )


def totals(cov: Coverage, structural: DataFrame) -> DataFrame:
    """Observed, absent, covered, excluded and expected cells of the network."""
    seen = cov.series.agg(
        F.sum("n_observed").alias("n_observed_cells"), F.sum("n_expected").alias("n_covered_cells")
    )
    absent = cov.gap_ranges.agg(
        F.coalesce(F.sum(F.col("k_hi") - F.col("k_lo") + 1), F.lit(0)).alias("x")
    ).scalar()
    out = structural.agg(F.coalesce(F.sum("excluded_cells"), F.lit(0)).alias("x")).scalar()
    return (
        seen.withColumn("n_absent_cells", absent)
        .withColumn("n_excluded_cells", out)
        .withColumn("n_expected_cells", F.col("n_covered_cells") + F.col("n_excluded_cells"))
    )


def covered_in_window(series: DataFrame, instants: DataFrame, hours: int = C.WINDOW_HOURS) -> DataFrame:
    """Expected cells per (station, instant) in the trailing window, by arithmetic."""
    at = secs("at")
    pairs = with_instants(series, instants)
    lo = F.greatest(secs("start"), at - hours * 3600 + F.col("cadence_s"))
    hi = F.least(secs("end"), at)
    n = F.when(hi >= lo, F.floor((hi - lo) / F.col("cadence_s")) + 1).otherwise(0)
    return pairs.groupBy("station_id", "at").agg(F.sum(n).cast("bigint").alias("covered"))


def with_instants(df: DataFrame, instants: DataFrame) -> DataFrame:
    """Every row once per scoring instant (at most a fixed number of instants exists)."""
    arr = instants.agg(F.collect_list("at").alias("a")).scalar()
    return df.withColumn("_at", arr).withColumn("at", F.explode("_at")).drop("_at")
