"""What the neighbours say a station should read, and how well they say it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stationproof import config as C
from stationproof.functions.columns import one_row


def target_values(readings: DataFrame, parameter: str) -> DataFrame:
    """Mean of the readings of each cell."""
    return (
        readings.where((F.col("parameter") == parameter) & F.col("value").isNotNull())
        .groupBy("station_id", "timestamp_utc")
        .agg(F.avg("value").alias("y"))
    )


def attention(edges: DataFrame, values: DataFrame, beta: float = C.WIND_BIAS) -> DataFrame:
    """Incoming edges of every (destination, instant) with their softmax share.

    The shares are formed from sums per destination and instant, so nothing but partial sums
    is shuffled to a destination with many neighbours.
    """
    src = values.withColumnRenamed("station_id", "src").withColumnRenamed("y", "y_src")
    e = edges.join(src, ["src", "timestamp_utc"]).withColumn("_e", F.exp(beta * F.col("weight")))
    total = e.groupBy("dst", "timestamp_utc").agg(F.sum("_e").alias("_sum"))
    return e.join(total, ["dst", "timestamp_utc"]).withColumn("alpha", F.col("_e") / F.col("_sum")).drop("_e", "_sum")


def reconstruct(edges: DataFrame, values: DataFrame, beta: float = C.WIND_BIAS) -> DataFrame:
    """Predict each cell from its neighbours only, weighted by wind; also their plain mean."""
    stats = values.agg(
        F.avg("y").alias("_mean"), F.stddev_pop("y").alias("_sd"), F.min("y").alias("_lo"), F.max("y").alias("_hi")
    )
    sd = F.when((F.col("_lo") == F.col("_hi")) | (F.col("_sd") <= 1e-8), 1.0).otherwise(F.col("_sd"))
    stats = stats.select("_mean", sd.alias("_sd"))
    src = one_row(values, stats).select(
        F.col("station_id").alias("src"),
        "timestamp_utc",
        F.col("y").alias("y_src"),
        ((F.col("y") - F.col("_mean")) / F.col("_sd")).alias("z"),
    )
    e = edges.join(src, ["src", "timestamp_utc"])
    w = F.exp(beta * F.col("weight"))
    out = e.groupBy("dst", "timestamp_utc").agg(
        (F.sum(w * F.col("z")) / F.sum(w)).alias("_z"),
        F.avg("y_src").alias("y_mean"),
        F.count(F.lit(1)).alias("n_neighbours"),
    )
    out = one_row(out, stats).withColumn("y_hat", F.col("_z") * F.col("_sd") + F.col("_mean"))
    own = values.select(F.col("station_id").alias("dst"), "timestamp_utc", "y")
    return out.join(own, ["dst", "timestamp_utc"], "left").select(
        F.col("dst").alias("station_id"), "timestamp_utc", "y", "y_hat", "y_mean", "n_neighbours"
    )


def with_sigma(pred: DataFrame, blocks: DataFrame, last_block: int) -> DataFrame:
    """Residual spread per station, learned on all blocks but the last."""
    b = pred.join(blocks, "timestamp_utc")
    r = F.col("y") - F.col("y_hat")
    train = b.where((F.col("block") < last_block) & F.col("y").isNotNull())
    sd = train.groupBy("station_id").agg(
        F.when(F.min(r) == F.max(r), 0.0).otherwise(F.stddev_pop(r)).alias("sigma")
    )
    return b.join(sd, "station_id", "left")


def held_out_metrics(scored: DataFrame, last_block: int) -> DataFrame:
    """Gaussian likelihood and error on the last block."""
    r = F.col("y") - F.col("y_hat")
    rm = F.col("y") - F.col("y_mean")
    var = F.pow(F.greatest("sigma", F.lit(1e-6)), 2)
    nll = 0.5 * (F.log(2 * F.pi() * var) + r * r / var)
    return scored.where(
        (F.col("block") == last_block) & F.col("y").isNotNull() & F.col("sigma").isNotNull()
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(nll).alias("nll"),
        F.sqrt(F.avg(r * r)).alias("rmse"),
        F.sqrt(F.avg(rm * rm)).alias("rmse_mean"),
    )


def influence(shares: DataFrame, top: int | None = None) -> DataFrame:
    """Incoming neighbours of a destination by influence."""
    w = W.partitionBy("dst", "timestamp_utc").orderBy(F.round("alpha", 9).desc(), "src")
    out = shares.withColumn("position", F.row_number().over(w).cast("bigint"))
    return out if top is None else out.where(F.col("position") <= top)
