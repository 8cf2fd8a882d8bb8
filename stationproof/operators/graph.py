"""Wind field and the wind-conditioned neighbour graph, for all hours at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationproof import config as C
from stationproof.functions import geo, scan
from stationproof.functions.columns import dense, union_all
from stationproof.functions.state import cut

AT = ("lat", "lon")
#: Instants of one bucket in which gaps and runs of the city's wind meet.
SPAN = 256


def station_wind(readings: DataFrame) -> DataFrame:
    """Wind per station and instant where both direction and speed were measured."""
    mean = lambda p: F.avg(F.when(F.col("parameter") == p, F.col("value")))
    return (
        readings.where(F.col("parameter").isin("Wind_Direction", "Wind_Speed"))
        .groupBy("station_id", "timestamp_utc")
        .agg(mean("Wind_Direction").alias("from_deg"), mean("Wind_Speed").alias("speed"))
        .where("from_deg IS NOT NULL AND speed IS NOT NULL")
        .withColumn("from_deg", geo.wrap360("from_deg"))
    )


def city_wind(local: DataFrame) -> DataFrame:
    """Circular mean direction and mean speed of the stations that measured."""
    unit = lambda fn: F.avg(fn(F.radians("from_deg")))
    return local.groupBy("timestamp_utc").agg(
        geo.wrap360(F.degrees(F.atan2(unit(F.sin), unit(F.cos))) + 360.0).alias("city_deg"),
        F.avg("speed").alias("city_speed"),
        F.count(F.lit(1)).alias("station_count"),
    )


def wind_lookup(requests: DataFrame, local: DataFrame, city: DataFrame) -> DataFrame:
    """Wind for (station, instant): the station's own, else the city's, else none."""
    j = requests.join(local, ["station_id", "timestamp_utc"], "left").join(city, "timestamp_utc", "left")
    own = F.col("from_deg").isNotNull() & F.col("speed").isNotNull()
    far = F.col("city_deg").isNotNull()
    return j.withColumns(
        {
            "wind_origin": F.when(own, "station-local").when(far, "city-fallback").otherwise("unavailable"),
            "from_deg": F.coalesce("from_deg", "city_deg"),
            "speed": F.coalesce("speed", "city_speed"),
        }
    ).drop("city_deg", "city_speed", "station_count")


def wind_weight(from_deg, speed, distance_km, bearing) -> Column:
    """How strongly the wind carries from source to target; 0 when calm or too far."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    off = geo.angle_diff(bearing, geo.travel_bearing(from_deg))
    w = (
        F.exp(-off / C.WIND_SIGMA_DEG)
        * (c(speed) / (c(speed) + C.WIND_HALF_SATURATION))
        * F.exp(-c(distance_km) / C.DISTANCE_DECAY_KM)
    )
    none = (c(speed) < C.CALM_SPEED) | (c(distance_km) > C.CUTOFF_KM)
    return F.when(none, 0.0).otherwise(w)


def pairs(stations: DataFrame, cutoff_km: float = C.CUTOFF_KM) -> DataFrame:
    """Ordered station pairs within the cutoff with distance and bearing."""
    src = stations.select(F.col("station_id").alias("src"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    dst = stations.select(F.col("station_id").alias("dst"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    near = geo.radius_join(src, dst, cutoff_km, ("lat1", "lon1"), ("lat2", "lon2"))
    return near.where("src <> dst").select(
        "src", "dst", "distance_km", geo.bearing_deg("lat1", "lon1", "lat2", "lon2").alias("bearing_deg")
    )


def inverse_distance(d: Column) -> Column:
    return 1.0 / (d + C.SPATIAL_OFFSET_KM)


def spatial_edges(p: DataFrame) -> DataFrame:
    return p.select(
        "src",
        "dst",
        F.round(inverse_distance(F.col("distance_km")), 6).alias("weight"),
        F.round("distance_km", 6).alias("distance_km"),
    )


def wind_edges(p: DataFrame, stations: DataFrame, local: DataFrame, city: DataFrame) -> DataFrame:
    """One edge per pair and instant, weighted by the wind at its source."""
    hours = city.select("timestamp_utc")
    asked = dense(stations.select("station_id"), hours, "station_id")
    wind = wind_lookup(asked, local, city).withColumnRenamed("station_id", "src")
    return p.join(wind, "src").select(
        "timestamp_utc",
        "src",
        "dst",
        wind_weight("from_deg", "speed", "distance_km", "bearing_deg").alias("weight"),
        "distance_km",
        "bearing_deg",
        "wind_origin",
    )

def wind_runs(stations: DataFrame, local: DataFrame, city: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ranges of network instants with one wind, and the instants with their numbers.

    Rows: station_id, lo, hi (numbers of instants, from 1), from_deg, speed, wind_origin. Where a station has no wind of its own, the
    city's runs are cut to the gaps; instants without any wind are in no range. Rows follow changes of the wind, not instants.
    """
    hours = cut(scan.global_rank(city.select("timestamp_utc").distinct(), [F.col("timestamp_utc")], "i"))
    wind = ["from_deg", "speed"]
    own = local.where("from_deg IS NOT NULL AND speed IS NOT NULL").select("station_id", "timestamp_utc", *wind).join(hours, "timestamp_utc")
    own = scan.assign_seq_blocks(own.join(stations.select("station_id").distinct(), "station_id", "left_semi"), ["station_id"], "i")
    own = cut(scan.ordered_scan(own, ["station_id"], ["i"], lags={"_pi": F.col("i"), "_pd": F.col("from_deg"), "_ps": F.col("speed")}))
    parted = F.col("_pi").isNull() | (F.col("i") != F.col("_pi") + 1) | (F.col("from_deg") != F.col("_pd")) | (F.col("speed") != F.col("_ps"))
    runs = _numbered(own, ["station_id"], parted).groupBy("station_id", "_run").agg(F.min("i").alias("lo"), F.max("i").alias("hi"), *[F.first(c).alias(c) for c in wind])
    # before the first, between two neighbours and after the last instant with a wind of the station's own
    n = hours.agg(F.coalesce(F.max("i"), F.lit(0)).alias("x")).scalar()
    between = own.select("station_id", (F.coalesce("_pi", F.lit(0)) + 1).alias("lo"), (F.col("i") - 1).alias("hi"))
    ends = stations.select("station_id").distinct().join(own.groupBy("station_id").agg(F.max("i").alias("_last")), "station_id", "left")
    tail = ends.select("station_id", (F.coalesce("_last", F.lit(0)) + 1).alias("lo"), n.alias("hi"))
    gaps = between.unionByName(tail).where("lo <= hi")
    c = city.where("city_deg IS NOT NULL AND city_speed IS NOT NULL").join(hours, "timestamp_utc").select("i", F.col("city_deg").alias("from_deg"), F.col("city_speed").alias("speed"))
    c = scan.ordered_scan(scan.assign_seq_blocks(c, [], "i"), [], ["i"], lags={"_pi": F.col("i"), "_pd": F.col("from_deg"), "_ps": F.col("speed")})
    far = _numbered(scan.drop_blocks(c), [], parted).groupBy("_run").agg(F.min("i").alias("clo"), F.max("i").alias("chi"), *[F.first(x).alias(x) for x in wind])
    spans = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / SPAN), F.floor(F.col(b) / SPAN))).alias("_span")
    met = gaps.select("*", spans("lo", "hi")).join(far.select("*", spans("clo", "chi")), "_span").where("lo <= chi AND clo <= hi")
    met = met.withColumns({"_a": F.greatest("lo", "clo"), "_b": F.least("hi", "chi")}).where(F.floor(F.col("_a") / SPAN) == F.col("_span"))
    fallback = met.select("station_id", F.col("_a").alias("lo"), F.col("_b").alias("hi"), *wind, F.lit("city-fallback").alias("wind_origin"))
    mine = runs.select("station_id", "lo", "hi", *wind, F.lit("station-local").alias("wind_origin"))
    return mine.unionByName(fallback), hours


def _numbered(rows: DataFrame, keys: list[str], parted: Column) -> DataFrame:
    """Add `_run`, counting the rows at which a run begins."""
    blocked = scan.assign_seq_blocks(scan.drop_blocks(rows), keys, "i")
    return scan.drop_blocks(scan.ordered_scan(blocked, keys, ["i"], sums={"_run": F.when(parted, 1).otherwise(0).cast("bigint")}))


def wind_edge_ranges(p: DataFrame, stations: DataFrame, local: DataFrame, city: DataFrame) -> DataFrame:
    """Edges of positive weight per pair and range of instants with one wind; `expand_edges` gives them per instant."""
    runs, hours = wind_runs(stations, local, city)
    e = p.join(runs.withColumnRenamed("station_id", "src"), "src").withColumn("weight", wind_weight("from_deg", "speed", "distance_km", "bearing_deg"))
    e = e.where("weight > 0")
    at = lambda i, name: hours.select(F.col("i").alias(i), F.col("timestamp_utc").alias(name))
    return e.join(at("lo", "start_utc"), "lo").join(at("hi", "end_utc"), "hi").select(
        "src", "dst", "start_utc", "end_utc", "lo", "hi", "weight", "distance_km", "bearing_deg", "wind_origin"
    )


def expand_edges(ranges: DataFrame, hours: DataFrame) -> DataFrame:
    """One row per edge and instant; `hours` are the numbered instants, or those that are asked for."""
    numbered = ranges.withColumn("i", F.explode(F.sequence("lo", "hi")))
    return numbered.join(hours, "i").drop("i", "lo", "hi", "start_utc", "end_utc")


def corridor_edges(stations: DataFrame, corridors: DataFrame) -> DataFrame:
    c = corridors.select("corridor_id", F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"), "n_stops")
    near = geo.radius_join(stations, c, C.CUTOFF_KM, AT, ("c_lat", "c_lon"))
    return near.select(
        F.col("corridor_id").alias("src"),
        F.col("station_id").alias("dst"),
        F.round(inverse_distance(F.col("distance_km")) * F.col("n_stops"), 6).alias("weight"),
        F.round("distance_km", 6).alias("distance_km"),
    )


def road_edges(near: DataFrame) -> DataFrame:
    return near.select(
        F.col("point_id").alias("src"),
        F.col("station_id").alias("dst"),
        F.round(inverse_distance(F.col("distance_km")), 6).alias("weight"),
        F.round("distance_km", 6).alias("distance_km"),
    )


def weather_edges(stations: DataFrame) -> DataFrame:
    return stations.select(
        F.lit("WEATHER-00").alias("src"),
        F.col("station_id").alias("dst"),
        F.lit(1.0).alias("weight"),
        F.lit(0.0).alias("distance_km"),
    )


def edge_table(**kinds: DataFrame) -> DataFrame:
    """All edges in one table with their type."""
    return union_all([df.withColumn("edge_type", F.lit(kind)) for kind, df in kinds.items()])


def not_finite(edges: DataFrame) -> DataFrame:
    w = F.col("weight")
    return edges.where(w.isNull() | F.isnan(w) | (F.abs(w) == float("inf")))


def summary(edges: DataFrame) -> DataFrame:
    return edges.groupBy("edge_type").agg(
        F.count(F.lit(1)).alias("n_edges"),
        F.count_distinct("src").alias("n_sources"),
        F.count_distinct("dst").alias("n_targets"),
    )
