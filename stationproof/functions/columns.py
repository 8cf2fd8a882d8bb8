"""Column helpers shared by all operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SERIES = ["station_id", "parameter"]
CELL = ["station_id", "parameter", "timestamp_utc"]


def secs(c) -> Column:
    """Epoch seconds of a naive UTC timestamp (the session time zone is UTC)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.unix_seconds(c.cast("timestamp"))


def micros(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.unix_micros(c.cast("timestamp"))


def at_secs(c) -> Column:
    """Naive UTC timestamp of epoch seconds."""
    c = F.col(c) if isinstance(c, str) else c
    return F.timestamp_seconds(c).cast("timestamp_ntz")


def iso(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")


def steps_for_hours(hours: int, cadence: Column) -> Column:
    """Ticks that span `hours` at a cadence in seconds, at least one."""
    return F.greatest(F.lit(1), F.ceil(F.lit(hours * 3600) / cadence)).cast("bigint")


def humanise(seconds: Column) -> Column:
    """`3d 4h`, `3d` or `12h` for a duration in seconds."""
    h = F.floor(seconds / 3600).cast("bigint")
    d = F.floor(h / 24).cast("bigint")
    rest = h - d * 24
    days = F.concat(d.cast("string"), F.lit("d"))
    return (
        F.when(h < 24, F.concat(h.cast("string"), F.lit("h")))
        .when(rest == 0, days)
        .otherwise(F.concat(days, F.lit(" "), rest.cast("string"), F.lit("h")))
    )


def is_close(v: Column, target: Column) -> Column:
    """Absolute 1e-9 plus relative 1e-5 tolerance."""
    return F.abs(v - target) <= F.lit(1e-9) + F.lit(1e-5) * F.abs(target)


def lookup(mapping: dict, key: Column, default=None) -> Column:
    """Constant lookup, folded into the expression: no join."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    got = F.try_element_at(m, key)
    return got if default is None else F.coalesce(got, F.lit(default))


def literal_table(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A small constant table with known size (planner can broadcast it by its own check)."""
    cols = [c.strip().rsplit(" ", 1) for c in schema.split(",")]

    def lit(v, typ):
        if v is None:
            return f"cast(null as {typ})"
        text = str(v).replace("\\", "\\\\").replace("'", "\\'")
        return f"cast('{text}' as {typ})"

    body = ", ".join("(" + ", ".join(lit(v, t) for v, (_, t) in zip(r, cols)) + ")" for r in rows)
    names = ", ".join(f"`{n}`" for n, _ in cols)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({names})")


def union_all(frames) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def sized_broadcast(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """Broadcast hint only after counting: beyond `max_rows` the plain shuffled join stays."""
    if df.count() <= max_rows:
        return F.broadcast(df)
    return df


def dense(left: DataFrame, right: DataFrame, key: str, shards: int | None = None) -> DataFrame:
    """Every left row with every right row, for results that are defined as that.

    The right side is repeated over shards of the left side, by default as many as the session has
    shuffle partitions, so this is a hash join whose tasks each hold one shard.
    """
    shards = shards or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = left.withColumn("_shard", F.pmod(F.xxhash64(key), F.lit(shards)))
    b = right.withColumn("_shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))))
    return a.join(b, "_shard").drop("_shard")


def one_row(df: DataFrame, other: DataFrame) -> DataFrame:
    """Attach the columns of a one-row frame."""
    cols = {c: other.select(c).scalar() for c in other.columns}
    return df.withColumns(cols)
