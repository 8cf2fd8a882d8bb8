"""Great-circle columns and joins on distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationproof import config as C


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def haversine_km(lat1, lon1, lat2, lon2, radius: float = C.EARTH_KM) -> Column:
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    dp, dl = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(dp), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dl), 2)
    return 2.0 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def wrap360(deg) -> Column:
    return F.pmod(_c(deg), F.lit(360.0))


def bearing_deg(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = (F.radians(_c(x)) for x in (lat1, lon1, lat2, lon2))
    y = F.sin(lon2 - lon1) * F.cos(lat2)
    x = F.cos(lat1) * F.sin(lat2) - F.sin(lat1) * F.cos(lat2) * F.cos(lon2 - lon1)
    return wrap360(F.degrees(F.atan2(y, x)) + 360.0)


def angle_diff(a, b) -> Column:
    """Unsigned difference of two directions, 0..180."""
    d = F.pmod(F.abs(_c(a) - _c(b)), F.lit(360.0))
    return F.least(d, F.lit(360.0) - d)


def travel_bearing(from_deg) -> Column:
    return wrap360(_c(from_deg) + 180.0)


def _cube(lat, lon, size_km: float, radius: float) -> list[Column]:
    """Cell of a point on the sphere in a cubic lattice: no poles, no date line."""
    la, lo = F.radians(_c(lat)), F.radians(_c(lon))
    xyz = (F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la))
    return [F.floor(v * (radius / size_km)).cast("bigint") for v in xyz]


def with_cell(df: DataFrame, lat: str, lon: str, size_km: float, radius: float) -> DataFrame:
    return df.withColumn("_cell", F.struct(*_cube(lat, lon, size_km, radius)))


def with_base_cell(df: DataFrame, lat: str, lon: str, size_km: float, radius: float = C.EARTH_KM) -> DataFrame:
    """Add the lattice cell of a point as `_x`, `_y` and `_z`."""
    return df.withColumns(dict(zip(("_x", "_y", "_z"), _cube(lat, lon, size_km, radius))))


def with_near_cells(
    df: DataFrame, lat: str, lon: str, size_km: float, radius: float
) -> DataFrame:
    """One row per lattice cell that can hold a point within `size_km` of this one."""
    x, y, z = _cube(lat, lon, size_km, radius)
    out = df.withColumns({"_x": x, "_y": y, "_z": z})
    for a in ("_x", "_y", "_z"):
        out = out.withColumn(a, F.explode(F.array(*[F.col(a) + d for d in (-1, 0, 1)])))
    return out.withColumn("_cell", F.struct(*[F.col(a).alias(f"col{i + 1}") for i, a in enumerate(("_x", "_y", "_z"))])).drop("_x", "_y", "_z")


def radius_join(
    left: DataFrame,
    right: DataFrame,
    radius_km: float,
    left_at: tuple[str, str],
    right_at: tuple[str, str],
    earth_km: float = C.EARTH_KM,
) -> DataFrame:
    """All (left, right) pairs within `radius_km`, with `distance_km`.

    An equi-join on lattice cells of the radius, then the exact test; never a nested loop.
    """
    a = with_near_cells(left, *left_at, radius_km, earth_km)
    b = with_cell(right, *right_at, radius_km, earth_km)
    d = haversine_km(*left_at, *right_at, radius=earth_km)
    return (
        a.join(b, "_cell")
        .drop("_cell")
        .withColumn("distance_km", d)
        .where(F.col("distance_km") <= radius_km)
    )
