"""Sensor-shaped views over the driver's tables, as DataFrames.

`oracle.py` holds the same definitions in SQL. Fixed values such as declared units follow the
views, not the vendor's files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationproof.functions.columns import at_secs, literal_table, secs

UNIT_RULES = {"CO2": ("ug/m3", "ppm", 300.0, 10000.0)}
FLOORS = {"NO": (0.7, "ug/m3")}
PARAMETERS = [
    "PM10", "CO2", "PM2.5", "O3", "NO", "NO2", "Wind_Direction", "Humidity", "Wind_Speed", "Pressure",
]
TICK_S = 21600
# event type, user group -> parameter, unit, and value = base + v * mul / div
CHANNELS = (
    ("view", 0, "PM10", "ug/m3", 0, 10, 1),
    ("view", 1, "CO2", "ppm", 400, 5, 1),
    ("click", 0, "PM2.5", "ug/m3", 0, 2, 1),
    ("click", 1, "O3", "ug/m3", 0, 1, 1),
    ("purchase", 0, "NO", "ug/m3", 0, 1, 5),
    ("purchase", 1, "NO2", "ug/m3", 0, 1, 1),
    ("signup", 0, "Wind_Direction", "degrees", 0, 7, 1),
    ("signup", 1, "Humidity", "percent", 0, 1, 3),
    ("error", 0, "Wind_Speed", "m/s", 0, 1, 10),
    ("error", 1, "Pressure", "mbar", 1000, 1, 10),
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def readings(spark: SparkSession, sf: str) -> DataFrame:
    """Ten stations, ten parameters at 6 h, with every kind of fault planted."""
    prepare(spark)
    e = table(spark, sf, "events")
    t = F.col("ts").cast("timestamp_ntz")
    late = F.when(F.col("event_id") % 97 == 0, 43200).otherwise(0)
    tick = at_secs((F.floor((secs(t) - late) / TICK_S) * TICK_S).cast("bigint"))
    b = e.select(
        "event_id",
        (F.col("user_id") % 10).cast("int").alias("i"),
        (F.floor(F.col("user_id") / 10) % 2).cast("int").alias("g"),
        F.col("event_type").alias("e"),
        F.col("value").alias("v"),
        tick.alias("timestamp_utc"),
    )
    # Some stations lack a channel, or lose it: their events count for the channel's neighbour instead.
    moved = (
        F.when((F.col("i") == 2) & (F.col("e") == "purchase"), 1)
        .when((F.col("i") == 3) & F.col("e").isin("signup", "error"), 1)
        .when((F.col("i") == 4) & (F.col("e") == "error") & (F.col("timestamp_utc") >= F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")), 0)
        .otherwise(F.col("g"))
    )
    b = b.withColumn("g", moved)
    b = b.join(literal_table(spark, CHANNELS, "e string, g int, parameter string, unit string, base double, mul double, div double"), ["e", "g"])
    p, i, v, ts = F.col("parameter"), F.col("i"), F.col("v"), F.col("timestamp_utc")
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    value = (
        F.when((p == "PM10") & (i == 3), F.lit(30.0) + v * 0.001)
        .when((p == "PM2.5") & (F.col("event_id") % 53 == 0), -1.0)
        .when((p == "O3") & (i == 1) & (ts >= day("2024-01-16 00:00:00")), v + 150)
        .when((p == "NO") & (v < 10), 0.7)
        .when((p == "NO2") & (i == 0), 5.0)
        .when(p == "Wind_Direction", (v * 7) % 360)
        .when((p == "Humidity") & (F.col("event_id") % 41 == 0), None)
        .otherwise(F.col("base") + v * F.col("mul") / F.col("div"))
    )
    unit = F.when((p == "CO2") & (i == 1), "ug/m3").otherwise(F.col("unit"))
    station = F.concat(F.lit("STA-"), F.lpad((i + 1).cast("string"), 2, "0"))
    wind = p.isin("Wind_Direction", "Wind_Speed")
    return b.select(
        station.alias("station_id"),
        p,
        ts,
        value.cast("double").alias("value"),
        unit.alias("unit"),
        F.lit(None).cast("string").alias("instrument_id"),
        F.concat(station, F.when(wind, "_soil.csv").otherwise("_air.csv")).alias("source_file"),
        F.col("event_id").cast("bigint").alias("ingest_seq"),
    )


def stations(r: DataFrame) -> DataFrame:
    i = F.substring("station_id", 5, 2).cast("int") - 1
    return (
        r.select("station_id")
        .distinct()
        .select(
            "station_id",
            (F.lit(47.577175) - F.floor(i / 5).cast("double") * F.lit(0.018)).alias("lat"),
            (F.lit(21.502204) + (i % 5).cast("double") * F.lit(0.018)).alias("lon"),
        )
    )


def stops(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    frac = lambda m: ((k * m) % 1000).cast("double") / F.lit(1000.0)
    return c.select(
        k.cast("string").alias("stop_id"),
        (F.lit(47.53) + frac(37) * F.lit(0.06)).cast("string").alias("stop_lat"),
        F.when(k % 101 == 0, "n/a")
        .otherwise((F.lit(21.48) + frac(91) * F.lit(0.12)).cast("string"))
        .alias("stop_lon"),
    )


def stop_times(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_custkey").cast("string").alias("stop_id"), F.col("o_orderkey").alias("trip_id")
    )


def trips(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("trip_id"), (F.col("o_orderkey") % 12).alias("route_id"))


def counters(spark: SparkSession, sf: str) -> DataFrame:
    """Cumulative counters: a total that wraps at 5000, steps back on line 3 and repeats days."""
    prepare(spark)
    li = table(spark, sf, "lineitem")
    day = F.floor(secs(F.col("l_shipdate").cast("timestamp_ntz")) / 86400).cast("bigint")
    one = li.groupBy(
        (F.col("l_suppkey") % 10).alias("c"),
        day.alias("d"),
        "l_orderkey",
        "l_linenumber",
    ).agg(F.sum("l_quantity").alias("q"))
    d, ln = F.col("d"), F.col("l_linenumber")
    total = (d * 29 + ln * 3) % 5000 + F.floor(F.col("q") / 10)
    late = F.when(ln == 7, 3).otherwise(0)
    return one.select(
        F.concat(F.lit("TC-"), F.col("c").cast("string")).alias("counter_id"),
        F.lit("qty").alias("parameter"),
        at_secs(d * 86400).alias("timestamp_utc"),
        F.when(F.col("c") == 9, 100)
        .otherwise(total - F.when(ln == 3, 60).otherwise(0))
        .cast("double")
        .alias("cumulative"),
        ((d + late) * F.lit(1 << 38) + F.col("l_orderkey") * 16 + ln).cast("bigint").alias("ingest_seq"),
    )
