"""Readers. Every reader declares its schema, and an adapter table picks one by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationproof import config as C
from stationproof.functions.columns import lookup
from stationproof.operators import canonical


def canonical_table(spark: SparkSession, path: str) -> DataFrame:
    """Stored canonical readings: declared columns, NaN made null, hash added when missing."""
    df = spark.read.parquet(path)
    wanted = [c for c in canonical.COLUMNS if c != "row_hash" or c in df.columns]
    canonical.check_columns(df, wanted)
    v = F.col("value")
    df = df.select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in canonical.SCHEMA.fields if f.name in wanted],
        *(["ingest_seq"] if "ingest_seq" in df.columns else [F.monotonically_increasing_id().alias("ingest_seq")]),
    ).withColumn("value", F.when(~F.isnan(v), v))
    return df if "row_hash" in df.columns else canonical.add_row_hash(df)


def vendor_rows(raw: DataFrame, parameters: list[str] | None = None) -> DataFrame:
    """Raw vendor rows (all text, plus `file_name` and `ingest_seq`) to canonical readings.

    Station comes from the file name, bad numbers become missing, units are kept as declared.
    """
    canonical.check_columns(raw, [*C.VENDOR_COLUMNS, "file_name"])
    ts, _, par, val, unit = C.VENDOR_COLUMNS
    return raw.select(
        F.upper(F.regexp_extract("file_name", C.VENDOR_STATION_PATTERN, 1)).alias("station_id"),
        F.col(par).alias("parameter"),
        F.try_to_timestamp(F.col(ts), F.lit(C.VENDOR_TIME_FORMAT)).cast("timestamp_ntz").alias("timestamp_utc"),
        canonical.to_number(F.col(val)).alias("value"),
        F.col(unit).alias("unit"),
        F.lit(None).cast("string").alias("instrument_id"),
        F.col("file_name").alias("source_file"),
        "ingest_seq",
    )


def vendor_export(spark: SparkSession, path: str) -> DataFrame:
    """A folder of vendor CSV files. Unknown columns or parameters are refused by name."""
    raw = spark.read.option("header", True).csv(path)
    canonical.check_columns(raw, list(C.VENDOR_COLUMNS))
    raw = raw.select("*", F.col("_metadata.file_name").alias("file_name"), F.monotonically_increasing_id().alias("ingest_seq"))
    out = vendor_rows(raw)
    unknown = [r[0] for r in canonical.unknown_parameters(out, list(C.BOUNDS)).limit(20).collect()]
    if unknown:
        raise canonical.SchemaDriftError(f"unknown parameters {sorted(unknown)}")
    return canonical.add_row_hash(out)


def parse_location(text) -> dict:
    """Name, latitude and longitude out of `name (lat, lon)`; null where the text has another shape."""
    part = lambda i: F.nullif(F.regexp_extract(F.trim(text), C.LOCATION_PATTERN, i), F.lit(""))
    return {"name": F.trim(part(1)), "lat": part(2).try_cast("double"), "lon": part(3).try_cast("double")}


def site_metadata(raw: DataFrame) -> DataFrame:
    """Name and coordinates per station from its first row; `malformed` marks other shapes."""
    station = F.upper(F.regexp_extract("file_name", C.VENDOR_STATION_PATTERN, 1))
    first = raw.groupBy(station.alias("station_id")).agg(
        F.min_by(C.VENDOR_COLUMNS[1], "ingest_seq").alias("location")
    )
    return first.withColumns(parse_location(F.col("location"))).withColumn(
        "malformed", F.col("lat").isNull() | F.col("lon").isNull()
    )


def station_sidecar(spark: SparkSession, path: str) -> DataFrame:
    """JSON sidecar `{station: {name, lat, lon}}`."""
    site = T.StructType(
        [T.StructField("name", T.StringType()), T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())]
    )
    text = spark.read.text(path, wholetext=True)
    m = F.from_json("value", T.MapType(T.StringType(), site))
    return text.select(F.explode(m).alias("station_id", "s")).select("station_id", "s.name", "s.lat", "s.lon")


def counter_archive(spark: SparkSession, path: str) -> DataFrame:
    """Wide counter CSV files to one row per counter, class and instant."""
    schema = T.StructType(
        [T.StructField(c, T.StringType()) for c in C.COUNTER_IDS]
        + [T.StructField(c, T.DoubleType()) for c in C.COUNTER_MEASURES]
    )
    wide = spark.read.option("header", True).schema(schema).csv(path)
    return counter_rows(wide.withColumn("ingest_seq", F.monotonically_increasing_id()))


def counter_rows(wide: DataFrame, measures: list[str] | None = None) -> DataFrame:
    measures = measures or list(C.COUNTER_MEASURES)
    ids = wide.select(
        F.col("uuid").alias("counter_id"),
        F.to_timestamp("time").cast("timestamp_ntz").alias("timestamp_utc"),
        "ingest_seq",
        *[F.col(f"`{m}`").cast("double").alias(m) for m in measures],
    )
    keys = ["counter_id", "timestamp_utc", "ingest_seq"]
    return ids.unpivot(keys, [F.col(f"`{m}`") for m in measures], "parameter", "cumulative").where(
        F.col("cumulative").isNotNull()
    )


def counter_locations(wide: DataFrame) -> DataFrame:
    """First row with numeric coordinates per counter."""
    num = wide.select(
        F.col("uuid").alias("counter_id"),
        F.col("nick").alias("name"),
        F.col("lat").try_cast("double").alias("lat"),
        F.col("lng").try_cast("double").alias("lon"),
        "ingest_seq",
    ).where("lat IS NOT NULL AND lon IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon)")
    first = num.groupBy("counter_id").agg(F.min_by(F.struct("name", "lat", "lon"), "ingest_seq").alias("s"))
    return first.select("counter_id", "s.name", "s.lat", "s.lon")


def counter_readings(steps: DataFrame) -> DataFrame:
    """Repaired counts in canonical form: counter as station, class as parameter."""
    return steps.select(
        F.col("counter_id").alias("station_id"),
        "parameter",
        "timestamp_utc",
        F.col("increment").alias("value"),
        F.lit(C.COUNTER_UNIT).alias("unit"),
        F.lit(None).cast("string").alias("instrument_id"),
        F.concat("counter_id", F.lit(".csv")).alias("source_file"),
    )


def weather_feed(spark: SparkSession, path: str) -> DataFrame:
    schema = "timestamp_utc timestamp_ntz, temperature double, precipitation double"
    return spark.read.option("header", True).schema(schema).csv(path)


def transit_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)


def with_zones(stations: DataFrame, zones: dict[str, str] | None = None) -> DataFrame:
    """Curated land-use zone; a station that was never classified stays null."""
    return stations.withColumn("zone_type", lookup(zones or C.STATION_ZONES, F.col("station_id")))


def station_frame(stored: DataFrame, station_id: str) -> DataFrame:
    return stored.where(F.col("station_id") == station_id).select(*[c for c in canonical.COLUMNS if c in stored.columns])


def network_frame(stored: DataFrame, start=None, end=None) -> DataFrame:
    out = stored
    if start is not None:
        out = out.where(F.col("timestamp_utc") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        out = out.where(F.col("timestamp_utc") <= F.lit(end).cast("timestamp_ntz"))
    return out


ADAPTERS = {
    "canonical": ("readings", canonical_table),
    "vendor": ("readings", vendor_export),
    "counters": ("readings", counter_archive),
    "weather": ("covariate", weather_feed),
    "transit": ("covariate", transit_table),
    "sites": ("reference", station_sidecar),
}


def load(spark: SparkSession, source: str, path: str) -> DataFrame:
    """Read `path` with the adapter registered for `source`."""
    if source not in ADAPTERS:
        raise KeyError(f"unknown source {source!r}; known: {', '.join(sorted(ADAPTERS))}")
    return ADAPTERS[source][1](spark, path)


