"""Who lives with the readings: transit service near a station as an exposure factor."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stationproof import config as C
from stationproof.functions import geo
from stationproof.functions.columns import sized_broadcast
from stationproof.functions.state import cut


def stop_points(stops: DataFrame) -> DataFrame:
    """Stops with numeric coordinates; others are dropped."""
    num = lambda c: F.col(c).try_cast("double")
    return stops.select(
        "stop_id", num("stop_lat").alias("stop_lat"), num("stop_lon").alias("stop_lon")
    ).where("stop_lat IS NOT NULL AND stop_lon IS NOT NULL")


def stops_with_routes(
    stops: DataFrame, stop_times: DataFrame | None, trips: DataFrame | None
) -> DataFrame:
    """Distinct routes per stop; a stop no trip calls at counts as one route."""
    points = stop_points(stops)
    if stop_times is None or trips is None:
        return points.withColumn("n_routes", F.lit(1).cast("bigint"))
    calls = stop_times.select("stop_id", "trip_id").distinct().join(trips, "trip_id", "left")
    n = calls.groupBy("stop_id").agg(F.count_distinct("route_id").alias("n_routes"))
    return points.join(n, "stop_id", "left").fillna({"n_routes": 1})


def service_intensity(
    stations: DataFrame, stops: DataFrame, radius_km: float = C.EXPOSURE_RADIUS_KM
) -> DataFrame:
    """Routes of all stops within the radius of each station; stations without coordinates drop out.

    Stops at one spot are added up first, so copies of a stop never multiply the join.
    """
    at = stations.where("lat IS NOT NULL AND lon IS NOT NULL").select("station_id", "lat", "lon")
    spots = stops.groupBy("stop_lat", "stop_lon").agg(F.sum("n_routes").alias("n_routes"))
    near = geo.radius_join(
        at, spots, radius_km, ("lat", "lon"), ("stop_lat", "stop_lon"), C.EARTH_EXPOSURE_KM
    )
    total = near.groupBy("station_id").agg(F.sum("n_routes").cast("double").alias("service"))
    return at.select("station_id").join(total, "station_id", "left").fillna({"service": 0.0})


def exposure_layer(service: DataFrame, band=C.EXPOSURE_BAND, floor=C.EXPOSURE_MIN_SERVICE) -> DataFrame:
    """Service scaled into the exposure band; too little service is unmeasured and neutral."""
    lo_b, hi_b = band
    measured = F.col("service") >= floor
    ends = service.where(measured)
    lo = ends.agg(F.min("service").alias("x")).scalar()
    hi = ends.agg(F.max("service").alias("x")).scalar()
    out = service.withColumn("_lo", lo).withColumn("_hi", hi)
    scaled = lo_b + (hi_b - lo_b) * (F.col("service") - F.col("_lo")) / F.nullif(
        F.col("_hi") - F.col("_lo"), F.lit(0.0)
    )
    return out.select(
        "station_id",
        "service",
        measured.alias("measured"),
        F.when(measured, F.coalesce(F.round(scaled, 6), F.lit(1.0))).otherwise(1.0).alias("exposure"),
    )


def exposure_for(stations, stops, stop_times, trips) -> DataFrame | None:
    """The whole layer, or None when stations or stops are missing."""
    if stations is None or stops is None:
        return None
    return exposure_layer(service_intensity(stations, stops_with_routes(stops, stop_times, trips)))


def _levels(first_km: float) -> int:
    """Levels of the pyramid: cells of the last one are wider than the globe."""
    return math.ceil(math.log2(2.0 * C.EARTH_KM / first_km)) + 1


def _in_level(base: list, level) -> Column:
    """Cell of a base cell at a level of the pyramid."""
    x, y, z = (F.call_function("shiftright", c, level) for c in base)
    return F.struct(level.alias("level"), x.alias("x"), y.alias("y"), z.alias("z"))


def _around(df: DataFrame, level: Column, keep: list[str]) -> DataFrame:
    """One row per cell at a level that touches the own one or is it, as `cell`."""
    out = df.withColumn("_at", _in_level([F.col("_x"), F.col("_y"), F.col("_z")], level))
    steps = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]
    at = lambda s: F.struct(F.col("_at.level").alias("level"), *[(F.col(f"_at.{a}") + d).alias(a) for a, d in zip("xyz", s)])
    return out.select(*keep, F.explode(F.array(*[at(s) for s in steps])).alias("cell"))


def _ring(asked: DataFrame, points: DataFrame, level: str, k: int) -> DataFrame:
    """The k nearest points of every station among those in the cells around it at its level."""
    cells = _around(asked, F.col(level), ["station_id", "lat", "lon"])
    wanted = cut(cells.select("cell").distinct())
    used = [r[0] for r in wanted.select("cell.level").distinct().collect()]
    base = [F.col("_x"), F.col("_y"), F.col("_z")]
    own = F.explode(F.array(*[_in_level(base, F.lit(i)) for i in used])) if used else F.lit(None).cast("struct<level:int,x:bigint,y:bigint,z:bigint>")
    placed = points.select("point_id", "p_lat", "p_lon", own.alias("cell")).join(sized_broadcast(wanted), "cell", "left_semi")
    near = cells.join(placed, "cell").withColumn("distance_km", geo.haversine_km("lat", "lon", "p_lat", "p_lon"))
    w = W.partitionBy("station_id").orderBy(F.round("distance_km", 9), "point_id")
    ranked = near.select("station_id", "point_id", "distance_km", F.row_number().over(w).cast("bigint").alias("rank"))
    return ranked.where(F.col("rank") <= k)


def nearest(
    stations: DataFrame, points: DataFrame, k: int = C.ROAD_K, first_km: float = 0.25
) -> DataFrame:
    """The k nearest points (point_id, p_lat, p_lon) of every station, ties by id.

    A pyramid of lattice cells, each level twice as wide, holds the number of points of every cell. A station starts at the
    lowest level at which the cells around it hold k points; the distance of the k-th of those bounds the true one, and the
    cells around it that are as wide as that bound hold the answer. So points are read twice, whatever the density.
    """
    st = geo.with_base_cell(stations.select("station_id", "lat", "lon").where("lat IS NOT NULL AND lon IS NOT NULL"), "lat", "lon", first_km)
    pt = geo.with_base_cell(points.select("point_id", "p_lat", "p_lon").where("p_lat IS NOT NULL AND p_lon IS NOT NULL"), "p_lat", "p_lon", first_km)
    top = _levels(first_km)
    least = min(k, pt.limit(k).count())
    every = F.explode(F.sequence(F.lit(0), F.lit(top)))
    level = pt.select("_x", "_y", "_z", every.alias("_level")).groupBy(_in_level([F.col("_x"), F.col("_y"), F.col("_z")], F.col("_level")).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    around = _around(st.withColumn("_level", every), F.col("_level"), ["station_id"])
    start = around.join(level, "cell").groupBy("station_id", F.col("cell.level").alias("_level")).agg(F.sum("n").alias("n"))
    start = start.where(F.col("n") >= max(least, 1)).groupBy("station_id").agg(F.min("_level").alias("_level"))
    first = cut(_ring(cut(st.join(start, "station_id")), pt, "_level", least))
    bound = first.groupBy("station_id").agg(F.max("distance_km").alias("_far"))
    wide = F.ceil(F.log2(F.greatest(F.col("_far") * (1 + 1e-9), F.lit(first_km)) / first_km)).cast("int")
    return _ring(cut(st.join(bound, "station_id").withColumn("_level", F.least(wide, F.lit(top)))), pt, "_level", least)


def corridors(stops: DataFrame, max_cells: int = C.CORRIDORS_MAX) -> DataFrame:
    """Stops gathered into a square grid of at most `max_cells` cells over their envelope."""
    side = max(1, int(max_cells**0.5))
    ends = {
        n: stops.agg(fn(c).alias("x")).scalar()
        for n, fn, c in (
            ("_a0", F.min, "stop_lat"),
            ("_a1", F.max, "stop_lat"),
            ("_b0", F.min, "stop_lon"),
            ("_b1", F.max, "stop_lon"),
        )
    }
    s = stops.withColumns(ends)

    def cell(v: str, lo: str, hi: str):
        share = (F.col(v) - F.col(lo)) / F.nullif(F.col(hi) - F.col(lo), F.lit(0.0))
        return F.least(F.coalesce(F.floor(share * side), F.lit(0)), F.lit(side - 1)).cast("bigint")

    cells = s.groupBy(
        cell("stop_lat", "_a0", "_a1").alias("_a"), cell("stop_lon", "_b0", "_b1").alias("_b")
    ).agg(
        F.round(F.avg("stop_lat"), 6).alias("lat"),
        F.round(F.avg("stop_lon"), 6).alias("lon"),
        F.count(F.lit(1)).alias("n_stops"),
    )
    two = lambda c: F.lpad(F.col(c).cast("string"), 2, "0")
    return cells.select(
        F.concat(F.lit("BC-"), two("_a"), F.lit("-"), two("_b")).alias("corridor_id"),
        "lat",
        "lon",
        "n_stops",
    )


def weather_node(stations: DataFrame) -> DataFrame:
    return stations.agg(
        F.lit("WEATHER-00").alias("node_id"),
        F.round(F.avg("lat"), 6).alias("lat"),
        F.round(F.avg("lon"), 6).alias("lon"),
    )
