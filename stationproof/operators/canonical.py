"""The canonical readings table: schema, coercion, row hash, checks, profile and checksum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationproof import config as C
from stationproof.functions.columns import iso, micros

SCHEMA = T.StructType(
    [
        T.StructField("station_id", T.StringType(), False),
        T.StructField("parameter", T.StringType(), False),
        T.StructField("timestamp_utc", T.TimestampNTZType(), False),
        T.StructField("value", T.DoubleType(), True),
        T.StructField("unit", T.StringType(), False),
        T.StructField("instrument_id", T.StringType(), True),
        T.StructField("source_file", T.StringType(), False),
        T.StructField("row_hash", T.StringType(), False),
    ]
)
COLUMNS = [f.name for f in SCHEMA.fields]
REQUIRED = [f.name for f in SCHEMA.fields if not f.nullable]


class SchemaDriftError(ValueError):
    """The input's columns differ from the declared ones."""


def to_number(text: Column) -> Column:
    """Bad text and NaN both become missing."""
    x = text.try_cast("double")
    return F.when(~F.isnan(x), x)


def value_text(v: Column) -> Column:
    """Fixed-point text, so that the hash does not depend on how an engine prints doubles.

    Values that do not fit are written as the double's own text.
    """
    return F.coalesce(v.try_cast("decimal(28,6)").cast("string"), v.cast("string"), F.lit("NaN"))


def instant_text(ts: str) -> Column:
    """ISO seconds, with microseconds only where there are any."""
    part = F.pmod(micros(ts), F.lit(1_000_000))
    return F.concat(iso(ts), F.when(part == 0, F.lit("")).otherwise(F.concat(F.lit("."), F.lpad(part.cast("string"), 6, "0"))))


def row_hash() -> Column:
    return F.sha1(
        F.concat_ws(
            "\u001f",
            "station_id",
            "parameter",
            instant_text("timestamp_utc"),
            value_text(F.col("value")),
            "unit",
            "source_file",
        )
    )


def add_row_hash(df: DataFrame) -> DataFrame:
    return df.withColumn("row_hash", row_hash())


def check_columns(df: DataFrame, expected: list[str] | None = None) -> None:
    """Refuse missing and unknown columns by name, before any data is read."""
    expected = expected or COLUMNS
    have = set(df.columns) - {"ingest_seq"}
    missing, extra = sorted(set(expected) - have), sorted(have - set(expected))
    if missing or extra:
        raise SchemaDriftError(f"missing columns {missing}, unknown columns {extra}")


def violations(df: DataFrame, parameters: list[str] | None = None) -> DataFrame:
    """How many rows break each rule of the canonical table (zero everywhere when valid)."""
    known = list(parameters or C.BOUNDS)
    rules = {f"null_{c}": F.col(c).isNull() for c in REQUIRED if c in df.columns}
    rules["unknown_parameter"] = ~F.col("parameter").isin(known)
    rules["nan_value"] = F.isnan("value")
    one = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])
    return one.unpivot([], list(rules), "rule", "n_rows")


def unknown_parameters(df: DataFrame, known: list[str]) -> DataFrame:
    return df.where(~F.col("parameter").isin(known)).select("parameter").distinct()


def profile(df: DataFrame) -> DataFrame:
    """Observed schema per parameter: units, counts, distinct values and range."""
    return df.groupBy("parameter").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("value").alias("n_values"),
        F.count_distinct("value").alias("n_distinct"),
        F.min("value").alias("v_min"),
        F.max("value").alias("v_max"),
        F.concat_ws("|", F.sort_array(F.collect_set("unit"))).alias("units"),
    )


def profile_overall(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("station_id").alias("n_stations"),
        F.count_distinct("parameter").alias("n_parameters"),
        F.count_distinct("unit").alias("n_units"),
        F.min("timestamp_utc").alias("first_utc"),
        F.max("timestamp_utc").alias("last_utc"),
    )


def checksum(df: DataFrame, col: str = "row_hash") -> DataFrame:
    """Order-independent digest of a multiset of sha1 hex strings.

    The five 32-bit words of every hash are summed and the sums hashed: addition commutes, so
    partial sums combine before the shuffle and no task ever holds the hashes of the corpus.
    """
    word = lambda i: F.conv(F.substring(col, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")
    sums = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.coalesce(F.sum(word(i)), F.lit(0).cast("decimal(38,0)")).alias(f"_w{i}") for i in range(5)],
    )
    text = F.concat_ws("-", F.col("n_rows").cast("string"), *[F.col(f"_w{i}").cast("string") for i in range(5)])
    return sums.select("n_rows", F.substring(F.sha2(text, 256), 1, 16).alias("checksum"))
