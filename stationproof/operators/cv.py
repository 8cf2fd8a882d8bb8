"""Time blocks for honest evaluation: train on the past, test on what follows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationproof.functions import scan


def time_blocks(df: DataFrame, n_blocks: int) -> DataFrame:
    """Distinct instants numbered and cut into near-equal consecutive blocks, larger ones first."""
    ts = df.select("timestamp_utc").distinct()
    ranked = scan.ordered_scan(
        scan.assign_blocks(ts, [], seq=None), [], ["timestamp_utc"], sums={"_i": F.lit(1).cast("bigint")}
    )
    n = ts.agg(F.count(F.lit(1)).alias("n")).scalar()
    r = scan.drop_blocks(ranked).withColumn("_n", n)
    q = F.floor(F.col("_n") / n_blocks)
    extra = F.col("_n") - q * n_blocks
    head = extra * (q + 1)
    i = F.col("_i")
    block = F.when(i <= head, F.ceil(i / (q + 1))).otherwise(
        extra + F.ceil((i - head) / F.greatest(q, F.lit(1)))
    )
    return r.select("timestamp_utc", block.cast("bigint").alias("block"))


def splits(df: DataFrame, n_splits: int) -> DataFrame:
    """Fold k trains on blocks up to k and tests on block k+1: one row per instant and role."""
    b = time_blocks(df, n_splits + 1)
    roles = F.transform(
        F.sequence(F.lit(1), F.lit(n_splits)),
        lambda k: F.struct(
            k.cast("bigint").alias("fold"),
            F.when(F.col("block") <= k, "train").when(F.col("block") == k + 1, "test").alias("role"),
        ),
    )
    return b.select("timestamp_utc", F.inline(roles)).where("role IS NOT NULL")


def enough_instants(df: DataFrame, n_splits: int) -> None:
    n = df.select("timestamp_utc").distinct().count()
    if n < n_splits + 1:
        raise ValueError(f"{n} instants cannot make {n_splits} folds")


def leakage(folds: DataFrame) -> DataFrame:
    """Folds whose training reaches into their test block; must be empty."""
    end = lambda role, fn: fn(F.when(F.col("role") == role, F.col("timestamp_utc")))
    return (
        folds.groupBy("fold")
        .agg(end("train", F.max).alias("train_end"), end("test", F.min).alias("test_start"))
        .where(F.col("train_end") >= F.col("test_start"))
    )
