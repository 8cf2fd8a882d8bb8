"""Small corpora with known faults, generated by Spark from formulas."""

from __future__ import annotations

from pyspark.sql import functions as F

SERIES = [
    # parameter, unit, mean, amplitude, domain
    ("PM10", "µg/m3", 30.0, 12.0, "air"),
    ("PM2.5", "µg/m3", None, None, "air"),
    ("CO2", "ppm", 450.0, 30.0, "air"),
    ("NO", "µg/m3", 12.0, 4.0, "air"),
    ("WaterTemp", "celsius", 13.0, 0.5, "water"),
    ("WaterLevel", "m", 5.0, 0.3, "water"),
]
START = "2026-05-01 00:00:00"


def golden(spark, inject=True, hours=336, stations=4):
    """Four stations, six parameters, hourly; with `inject`, every fault a known number of times."""
    base = (
        spark.range(hours).withColumnRenamed("id", "t")
        .withColumn("s", F.explode(F.array(*[F.lit(i) for i in range(stations)])))
        .withColumn("p", F.explode(F.array(*[F.lit(x[0]) for x in SERIES])))
    )
    wave = lambda m, a: F.round(m + a * F.sin(2 * F.pi() * F.col("t") / 12 + 0.7 * F.col("s")), 4)
    s, t, p = F.col("s"), F.col("t"), F.col("p")
    v = F.when(p == "PM2.5", F.round(0.45 * wave(30.0, 12.0), 4))
    for name, _, m, a, _ in SERIES:
        if m is not None:
            v = v.when(p == name, wave(m, a))
    unit = F.create_map(*[F.lit(x) for n, u, *_ in SERIES for x in (n, u)])
    domain = F.create_map(*[F.lit(x) for n, _, _, _, d in SERIES for x in (n, d)])
    df = base.withColumn("v", v).withColumn("unit", unit[p]).withColumn("domain", domain[p])
    if inject:
        on = lambda n, i: (p == n) & (s == i)
        df = df.where(~(on("CO2", 0) & t.isin(30, 60, 90, 120, 150)) & ~(on("NO", 3) & t.between(204, 215)))
        df = df.where(~on("NO", 2) & ~((s == 3) & (F.col("domain") == "water")))
        df = df.withColumn(
            "v",
            F.when(on("PM10", 2) & t.isin(12, 36, 300), 3000.0)
            .when(on("WaterTemp", 2) & t.isin(100, 220), -10.0)
            .when(on("PM2.5", 0) & t.isin(10, 70, 130, 190), wave(30.0, 12.0) + 5)
            .when(on("NO", 0) & t.between(50, 57), 0.7)
            .when(on("WaterLevel", 0), 5.0)
            .when(on("PM10", 3), F.round(30 + 0.05 * F.sin(2 * F.pi() * t / 12), 4))
            .when(on("NO", 1) & (t >= 168), F.col("v") + 15)
            .otherwise(F.col("v")),
        ).withColumn("unit", F.when(on("CO2", 1), "µg/m3").otherwise(F.col("unit")))
    station = F.concat(F.lit("STA-0"), (s + 1).cast("string"))
    order = {n: i for i, (n, *_) in enumerate(SERIES)}
    pos = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])[p]
    out = df.select(
        station.alias("station_id"),
        p.alias("parameter"),
        (F.lit(START).cast("timestamp_ntz") + F.make_dt_interval(hours=t.cast("int"))).alias("timestamp_utc"),
        F.col("v").alias("value"),
        "unit",
        F.lit(None).cast("string").alias("instrument_id"),
        F.concat(station, F.lit("_"), "domain", F.lit(".csv")).alias("source_file"),
        ((s * 10 + pos) * 100000 + t * 10).cast("bigint").alias("ingest_seq"),
    )
    if inject:
        extra = out.where(
            "station_id = 'STA-01' AND parameter = 'WaterTemp' AND timestamp_utc IN (TIMESTAMP_NTZ '2026-05-02 00:00:00', TIMESTAMP_NTZ '2026-05-03 00:00:00')"
        ).withColumns(
            {"value": F.when(F.dayofmonth("timestamp_utc") == 2, 13.9).otherwise(12.1), "ingest_seq": F.col("ingest_seq") + 1}
        )
        out = out.unionByName(extra)
    return out


PLUME_STATIONS = [("SCEN-SRC", 47.53, 21.55), ("SCEN-N1", 47.53, 21.59), ("SCEN-N2", 47.53, 21.63), ("SCEN-UP", 47.53, 21.51)]


def plume(spark, rising=("SCEN-N1", "SCEN-N2")):
    """72 hours of 30 everywhere, west wind, a spike at the source and rises where asked."""
    from stationproof.functions import geo

    st = spark.createDataFrame(PLUME_STATIONS, "station_id string, lat double, lon double")
    d = geo.haversine_km(F.lit(47.53), F.lit(21.55), "lat", "lon")
    rise = F.round(30 + 2970 * F.exp(-d / 5), 4)
    h = st.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(71))))
    pm = (
        F.when((F.col("station_id") == "SCEN-SRC") & (F.col("h") == 60), 3000.0)
        .when(F.col("station_id").isin(*rising) & (F.col("h") == 61), rise)
        .otherwise(30.0)
    )
    rows = F.array(
        *[F.struct(F.lit(n).alias("parameter"), x.alias("value"), F.lit(u).alias("unit")) for n, x, u in (("PM10", pm, "µg/m3"), ("Wind_Direction", F.lit(270.0), "degrees"), ("Wind_Speed", F.lit(5.0), "m/s"))]
    )
    r = h.select("station_id", "h", F.inline(rows)).select(
        "station_id",
        "parameter",
        (F.lit("2026-06-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("h"))).alias("timestamp_utc"),
        "value",
        "unit",
        F.col("h").cast("bigint").alias("ingest_seq"),
    )
    return st, r
