"""Calibrated intervals from held-out errors, exact order statistics included."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationproof import config as C
from stationproof.functions import scan
from stationproof.functions.columns import one_row


def quantile(scores: DataFrame, keys: list[str], alpha: float = C.CONFORMAL_ALPHA) -> DataFrame:
    """The k-th smallest score, k = ceil((n + 1)(1 - alpha)); infinite when k exceeds n."""
    if not 0.0 < alpha < 1.0:
        raise ValueError("alpha must lie strictly between 0 and 1")
    n = F.col("_n")
    k = F.ceil((n + 1) * F.lit(1.0 - alpha))
    out = scan.order_statistics(scores, keys, "score", {"_q": k})
    return out.select(
        *keys, n.alias("n"), F.when(k > n, float("inf")).otherwise(F.col("_q")).alias("q")
    )


def with_scores(df: DataFrame, normalised: bool = False) -> DataFrame:
    """|y - y_hat|, divided by the predicted spread when normalised."""
    r = F.abs(F.col("y") - F.col("y_hat"))
    return df.withColumn("score", r / F.greatest("sigma", F.lit(1e-12)) if normalised else r)


def calibrate(
    df: DataFrame, keys: list[str], alpha: float = C.CONFORMAL_ALPHA, min_n: int = C.CONFORMAL_MIN_N, normalised: bool = False
) -> DataFrame:
    """Quantile per group; groups with too few points get none."""
    return quantile(with_scores(df, normalised), keys, alpha).where(F.col("n") >= min_n)


def intervals(df: DataFrame, q: DataFrame, keys: list[str], normalised: bool = False) -> DataFrame:
    half = F.col("q") * (F.greatest("sigma", F.lit(1e-12)) if normalised else F.lit(1.0))
    j = df.join(q.select(*keys, "q"), keys) if keys else df.withColumn("q", q.select("q").scalar())
    lo, hi = F.col("y_hat") - half, F.col("y_hat") + half
    return j.withColumns({"lower": lo, "upper": hi}).withColumn(
        "covered", (F.col("y") >= F.col("lower")) & (F.col("y") <= F.col("upper"))
    )


def coverage(inside: DataFrame, keys: list[str]) -> DataFrame:
    g = inside.groupBy(*keys) if keys else inside.groupBy()
    return g.agg(F.count(F.lit(1)).alias("n_test"), F.avg(F.col("covered").cast("double")).alias("coverage"))


def calibrate_then_score(
    df: DataFrame, keys: list[str], last_block: int, alpha: float = C.CONFORMAL_ALPHA, normalised: bool = False
) -> DataFrame:
    """Quantile from the block before the last, coverage on the last block."""
    q = calibrate(df.where(F.col("block") == last_block - 1), keys, alpha, normalised=normalised)
    test = intervals(df.where(F.col("block") == last_block), q, keys, normalised)
    cov = coverage(test, keys)
    out = q.withColumnRenamed("n", "n_calibration")
    return out.join(cov, keys) if keys else one_row(out, cov)
