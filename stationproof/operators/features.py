"""The (station, instant) feature matrix and where each column comes from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stationproof import config as C
from stationproof.functions import scan
from stationproof.functions.columns import dense, literal_table

KEY = ["station_id", "timestamp_utc"]

# Feature -> (origin, available without optional feeds).
FEATURES = {
    "temperature": ("weather_feed", False),
    "precipitation": ("weather_feed", False),
    "wind_speed": ("measured", True),
    "wind_dir_sin": ("measured", True),
    "wind_dir_cos": ("measured", True),
    "humidity": ("measured", True),
    "pressure": ("measured", True),
    "boundary_layer_proxy": ("proxy", True),
    "hour_sin": ("derived", True),
    "hour_cos": ("derived", True),
    "dow_sin": ("derived", True),
    "dow_cos": ("derived", True),
    "season_sin": ("derived", True),
    "season_cos": ("derived", True),
    "traffic_flow": ("traffic", False),
}
MEASURED = {"wind_speed": "Wind_Speed", "humidity": "Humidity", "pressure": "Pressure"}


def grid(readings: DataFrame) -> DataFrame:
    """Every station at every observed instant."""
    return dense(
        readings.select("station_id").distinct(), readings.select("timestamp_utc").distinct(), "station_id"
    )


def measured_cells(readings: DataFrame) -> DataFrame:
    """Mean weather measurements per (station, instant), wind direction as sine and cosine."""
    mean = lambda p: F.avg(F.when(F.col("parameter") == p, F.col("value")))
    wide = (
        readings.where(F.col("parameter").isin([*MEASURED.values(), "Wind_Direction"]))
        .groupBy(*KEY)
        .agg(*[mean(p).alias(n) for n, p in MEASURED.items()], mean("Wind_Direction").alias("_deg"))
    )
    return wide.withColumns(
        {"wind_dir_sin": F.sin(F.radians("_deg")), "wind_dir_cos": F.cos(F.radians("_deg"))}
    ).drop("_deg")


def impute(g: DataFrame, cells: DataFrame, columns: list[str]) -> DataFrame:
    """Fill gaps with the network's mean of that instant, then the mean of what is filled, then 0.

    The mean of the filled column follows from counts per instant, so the dense matrix is
    joined once and never aggregated as a whole.
    """
    hourly = cells.groupBy("timestamp_utc").agg(
        *[F.avg(c).alias(f"_h_{c}") for c in columns],
        *[F.sum(c).alias(f"_s_{c}") for c in columns],
        *[F.count(c).alias(f"_n_{c}") for c in columns],
    )
    stations = g.select("station_id").distinct().agg(F.count(F.lit(1)).alias("x")).scalar()
    filled = hourly.withColumn("_st", stations).agg(
        *[
            (
                F.sum(F.col(f"_s_{c}") + (F.col("_st") - F.col(f"_n_{c}")) * F.col(f"_h_{c}"))
                / F.nullif(F.sum(F.when(F.col(f"_n_{c}") > 0, F.col("_st"))), F.lit(0))
            ).alias(f"_g_{c}")
            for c in columns
        ]
    )
    out = g.join(cells.select(*KEY, *columns), KEY, "left").join(
        hourly.select("timestamp_utc", *[f"_h_{c}" for c in columns]), "timestamp_utc", "left"
    )
    out = out.withColumns({f"_g_{c}": filled.select(f"_g_{c}").scalar() for c in columns})
    return out.select(
        *KEY, *[F.coalesce(c, f"_h_{c}", f"_g_{c}", F.lit(0.0)).alias(c) for c in columns]
    )


def _cycle(x: Column, period: float, name: str) -> dict[str, Column]:
    r = 2.0 * F.pi() * x / period
    return {f"{name}_sin": F.sin(r), f"{name}_cos": F.cos(r)}


def calendar(hours: DataFrame, ts: str = "timestamp_utc") -> DataFrame:
    """Hour, weekday (Monday first) and season as circles, and the mixing-layer proxy."""
    hour = F.hour(ts).cast("double")
    doy = F.dayofyear(ts).cast("double")
    day = 0.5 * (1.0 + F.cos(2.0 * F.pi() * (hour - 15.0) / 24.0))
    year = 0.5 * (1.0 + F.cos(2.0 * F.pi() * (doy - 172.0) / 365.25))
    proxy = 0.15 + 0.85 * (0.65 * day + 0.35 * year)
    return hours.withColumns(
        {
            **_cycle(hour, 24.0, "hour"),
            **_cycle(F.weekday(ts).cast("double"), 7.0, "dow"),
            **_cycle(doy, 365.25, "season"),
            "boundary_layer_proxy": F.least(F.greatest(proxy, F.lit(0.0)), F.lit(1.0)),
        }
    )


def weather(hours: DataFrame, feed: DataFrame | None) -> DataFrame:
    """Temperature carried forward, then backward, over the instants; precipitation 0 when absent."""
    if feed is None:
        return hours.select(
            "timestamp_utc",
            F.lit(C.IMPUTED_TEMPERATURE).alias("temperature"),
            F.lit(0.0).alias("precipitation"),
        )
    j = hours.select("timestamp_utc").distinct().join(feed, "timestamp_utc", "left")
    known = F.when(F.col("temperature").isNotNull(), F.struct("timestamp_utc", "temperature"))
    # the latest known value is a running maximum by time, the next one a running minimum
    b = scan.assign_blocks(j, [], seq=None)
    j = scan.ordered_scan(b, [], ["timestamp_utc"], maxs={"_prev": known})
    first = j.agg(F.min(known)["temperature"].alias("x")).scalar()
    return scan.drop_blocks(j).withColumn("_first", first).select(
        "timestamp_utc",
        F.coalesce("temperature", F.col("_prev")["temperature"], "_first", F.lit(C.IMPUTED_TEMPERATURE)).alias("temperature"),
        F.coalesce("precipitation", F.lit(0.0)).alias("precipitation"),
    )


def matrix(readings: DataFrame, feed: DataFrame | None = None, traffic: DataFrame | None = None) -> DataFrame:
    """All features of every (station, instant)."""
    g = grid(readings)
    columns = [*MEASURED, "wind_dir_sin", "wind_dir_cos"]
    out = impute(g, measured_cells(readings), columns)
    hours = readings.select("timestamp_utc").distinct()
    per_hour = calendar(hours).join(weather(hours, feed), "timestamp_utc")
    if traffic is None:
        per_hour = per_hour.withColumn("traffic_flow", F.lit(0.0))
    else:
        per_hour = per_hour.join(traffic, "timestamp_utc", "left").fillna({"traffic_flow": 0.0})
    return out.join(per_hour, "timestamp_utc").select(*KEY, *FEATURES)


def feature_spec(spark: SparkSession, has_weather: bool = False, has_traffic: bool = False) -> DataFrame:
    """Origin of every feature; models train on the available ones."""
    ok = {"weather_feed": has_weather, "traffic": has_traffic}
    rows = [(i, n, p, ok.get(p, a)) for i, (n, (p, a)) in enumerate(FEATURES.items())]
    return literal_table(spark, rows, "position bigint, feature string, origin string, available boolean")


def available(has_weather: bool = False, has_traffic: bool = False) -> list[str]:
    ok = {"weather_feed": has_weather, "traffic": has_traffic}
    return [n for n, (p, a) in FEATURES.items() if ok.get(p, a)]
