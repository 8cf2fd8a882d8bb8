"""Weather-adjusted residuals: one boosted-tree regressor per pollutant and fold, all trained together.

A pollutant's folds and its final model are models of one table: a cell stands once for each model that it trains, and one fit
grows all of them. Predictions of a fold's test cells come from that fold's model, residuals from the final ones.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationproof import config as C
from stationproof.functions.columns import lookup, union_all
from stationproof.functions.state import cut
from stationproof.operators import boosting, cv
from stationproof.operators.boosting import Forest, Params

#: Rounds, learning rate, leaves, rows of a leaf and share of the features of a tree.
PARAMS = Params(rounds=300, rate=0.05, leaves=31, min_rows=30, column_share=0.9)


class Trained(NamedTuple):
    """Models are numbered pollutant by pollutant: the final one first, then the folds from 1."""

    forest: Forest
    pollutants: list[str]
    folds: int
    cells: DataFrame  # one row a cell: station_id, parameter, timestamp_utc, y, features
    splits: DataFrame  # parameter, timestamp_utc, fold, role


def targets(readings: DataFrame, pollutants=C.POLLUTANTS) -> DataFrame:
    """Mean reading per cell of the modelled pollutants."""
    return (
        readings.where(F.col("parameter").isin(list(pollutants)) & F.col("value").isNotNull())
        .groupBy("station_id", "parameter", "timestamp_utc")
        .agg(F.avg("value").alias("y"))
    )


def fit_metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    """R2 and MAE per group from sums, so a group never has to fit anywhere.

    The squared deviations are taken around the group mean, not as a difference of squares.
    """
    y, r = F.col("y"), F.col("y") - F.col("y_hat")
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(r * r).alias("_sse"),
        (F.var_pop(y) * F.count(F.lit(1))).alias("_sst"),
        F.min(y).alias("_lo"),
        F.max(y).alias("_hi"),
        F.avg(F.abs(r)).alias("mae"),
    )
    r2 = F.when(F.col("_lo") < F.col("_hi"), 1.0 - F.col("_sse") / F.nullif(F.col("_sst"), F.lit(0.0)))
    return out.select(*keys, "n", r2.alias("r2"), "mae")


def model_number(parameter, fold, pollutants: list[str], folds: int):
    """Number of a pollutant's model; null for a pollutant that has none."""
    return (lookup({p: i * (folds + 1) for i, p in enumerate(pollutants)}, parameter) + fold).cast("int")


def cells(readings: DataFrame, matrix: DataFrame, columns: list[str], pollutants=C.POLLUTANTS) -> DataFrame:
    """Target and features of every present cell of the modelled pollutants."""
    return targets(readings, pollutants).join(matrix.select("station_id", "timestamp_utc", *columns), ["station_id", "timestamp_utc"])


def pollutant_splits(table: DataFrame, pollutants: list[str], folds: int) -> DataFrame:
    """Forward-chaining folds over the instants of each pollutant."""
    parts = []
    for p in pollutants:
        own = table.where(F.col("parameter") == p)
        cv.enough_instants(own, folds)
        parts.append(cv.splits(own, folds).select(F.lit(p).alias("parameter"), "timestamp_utc", "fold", "role"))
    return union_all(parts)


def train(table: DataFrame, columns: list[str], folds: int = C.CV_FOLDS, params: Params = PARAMS, order=C.POLLUTANTS) -> Trained:
    """Fit the final and the fold models of every pollutant that `table` (see `cells`) holds.

    Pollutants come in the order given; the driver holds their names, of which there are as many as `order` has.
    """
    table = cut(table)
    present = {r[0] for r in table.select("parameter").distinct().collect()}
    pollutants = [p for p in order if p in present]
    if not pollutants:
        raise ValueError("no modelled pollutant has readings")
    splits = cut(pollutant_splits(table, pollutants, folds))
    own = table.where(F.col("parameter").isin(pollutants))
    final = own.withColumn("fold", F.lit(0))
    past = own.join(splits.where("role = 'train'").drop("role"), ["parameter", "timestamp_utc"]).select(final.columns)
    rows = final.unionByName(past).withColumn("model", model_number(F.col("parameter"), F.col("fold"), pollutants, folds))
    forest = boosting.fit(rows.select("model", "y", *columns), columns, len(pollutants) * (folds + 1), params)
    return Trained(forest, pollutants, folds, own, splits)


def held_out(t: Trained) -> DataFrame:
    """Test cells of every fold with the prediction of that fold's model."""
    test = t.cells.join(t.splits.where("role = 'test'").drop("role"), ["parameter", "timestamp_utc"])
    numbered = test.withColumn("model", model_number(F.col("parameter"), F.col("fold"), t.pollutants, t.folds))
    return t.forest.predict(numbered, "y_hat").select("station_id", "parameter", "timestamp_utc", "fold", "y", "y_hat")


def metrics(t: Trained) -> DataFrame:
    """R2 and MAE of every pollutant and fold on cells that its model did not see, and the cells it was trained on."""
    trained = t.cells.join(t.splits.where("role = 'train'"), ["parameter", "timestamp_utc"]).groupBy("parameter", "fold").agg(F.count(F.lit(1)).alias("n_train"))
    return fit_metrics(held_out(t), ["parameter", "fold"]).withColumnRenamed("n", "n_test").join(trained, ["parameter", "fold"])


def in_band(fold_metrics: DataFrame, band=C.R2_BAND) -> DataFrame:
    """Mean R2 of each pollutant over its folds and whether it lies in the credible band."""
    m = fold_metrics.groupBy("parameter").agg(F.count(F.lit(1)).alias("n_folds"), F.avg("r2").alias("r2"), F.avg("mae").alias("mae"))
    return m.withColumn("in_band", F.col("r2").between(*band))


def predicted(t: Trained) -> DataFrame:
    """Every present cell with the number and the prediction of its pollutant's final model."""
    return t.forest.predict(t.cells.withColumn("model", model_number(F.col("parameter"), F.lit(0), t.pollutants, t.folds)), "y_hat")


def residuals(t: Trained) -> DataFrame:
    """Actual minus predicted for every present cell."""
    return predicted(t).select(
        "station_id",
        "parameter",
        "timestamp_utc",
        F.col("y").alias("actual"),
        F.col("y_hat").alias("predicted"),
        (F.col("y") - F.col("y_hat")).alias("residual"),
    )


def record(t: Trained, checksum: DataFrame) -> DataFrame:
    """What the models were fitted on, one row; `checksum` is the readings' (see `canonical.checksum`)."""
    span = t.cells.agg(F.min("timestamp_utc").alias("window_start"), F.max("timestamp_utc").alias("window_end"), F.count(F.lit(1)).alias("n_cells"))
    return span.withColumn("data_checksum", checksum.select("checksum").scalar()).select(
        F.lit("deweather").alias("name"),
        F.concat(F.lit("v1-"), F.substring("data_checksum", 1, 8)).alias("version"),
        "data_checksum",
        "window_start",
        "window_end",
        "n_cells",
        F.lit(len(t.forest.base)).cast("bigint").alias("n_models"),
        F.lit(len(t.forest.feature)).cast("bigint").alias("n_rounds"),
        F.lit(",".join(t.forest.columns)).alias("features"),
        F.lit(f"{t.folds} forward-chaining folds over the instants of each pollutant").alias("scheme"),
        F.lit("a fold's metrics speak for instants after its training only; what the features lack stays in the residual").alias("limitations"),
    )
