"""Why a prediction or a flag came out as it did.

Attributions travel as one short array per row (one entry per feature), so ranking them and
writing the sentence needs no shuffle at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationproof import config as C
from stationproof import registry
from stationproof.functions.columns import CELL, lookup

# Feature -> what an operator calls it.
PHRASES = {
    "temperature": "air temperature",
    "precipitation": "precipitation",
    "wind_speed": "wind speed",
    "wind_dir_sin": "wind direction",
    "wind_dir_cos": "wind direction",
    "wind_dir_deg": "wind direction",
    "humidity": "humidity",
    "pressure": "barometric pressure",
    "boundary_layer_proxy": "the shallow overnight mixing layer",
    "hour_sin": "time of day",
    "hour_cos": "time of day",
    "dow_sin": "day of week",
    "dow_cos": "day of week",
    "season_sin": "the seasonal cycle",
    "season_cos": "the seasonal cycle",
    "traffic_flow": "road traffic",
    "residual": "the weather-adjusted residual",
    "resid_z": "how far the residual sits from normal",
    "resid_abs_z": "the size of the residual anomaly",
    "resid_roll_mean_6": "a 6-hour residual shift",
    "resid_roll_mean_24": "a day-long residual shift",
    "resid_trend": "a sustained multi-day trend deviation",
    "resid_roll_std_6": "short-term residual noise",
    "raw_z": "how high the raw reading sits above its own normal",
    "explained_ratio": "how well weather explains the rise",
}
NOTHING = "No single feature stands out; the prediction sits near its baseline."
METADATA_ONLY = ("R10", "R11")


def linear_attributions(
    rows: DataFrame, columns: list[str], coefficients: list[float], means: list[float]
) -> DataFrame:
    """coef x (value - mean) per feature: with the mean prediction they add up to the prediction."""
    parts = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(c).alias("feature"),
            (F.lit(float(w)) * (F.col(c) - F.lit(float(m)))).alias("value"),
        )
        for i, (c, w, m) in enumerate(zip(columns, coefficients, means))
    ]
    return rows.withColumn("attributions", F.array(*parts))


def by_size(a: Column) -> Column:
    """Attributions from largest to smallest, feature order on ties."""
    keyed = F.transform(
        a,
        lambda x: F.struct(
            (-F.round(F.abs(x["value"]), 9)).alias("k"), x["position"].alias("position"), x["feature"].alias("feature"), x["value"].alias("value")
        ),
    )
    return F.array_sort(keyed)


def top(a: Column, k: int = 3) -> Column:
    return F.slice(by_size(a), 1, k)


def phrase(feature: Column) -> Column:
    return F.coalesce(lookup(PHRASES, feature), F.replace(feature, F.lit("_"), F.lit(" ")))


def sentence(df: DataFrame, k: int = 3) -> DataFrame:
    """One line that names the drivers, their direction and what did not matter."""
    said = F.transform(
        F.filter(top(F.col("attributions"), k), lambda x: x["k"] != 0),
        lambda x: F.struct(
            phrase(x["feature"]).alias("phrase"), F.when(x["value"] > 0, "raised").otherwise("lowered").alias("way")
        ),
    )
    d = df.withColumn("_said", said)
    names = F.transform("_said", lambda x: x["phrase"])
    d = d.withColumn("_names", names).withColumn(
        "_said", F.filter("_said", lambda x, i: F.array_position("_names", x["phrase"]) == i + 1)
    )
    d = d.withColumn("_said", F.transform("_said", lambda x: F.concat(x["phrase"], F.lit(" ("), x["way"], F.lit(")"))))
    least = F.element_at(
        F.array_sort(
            F.transform(
                "attributions",
                lambda x: F.struct(F.round(F.abs(x["value"]), 9).alias("k"), x["position"].alias("p"), x["feature"].alias("f")),
            )
        ),
        1,
    )["f"]
    n = F.size("_said")
    item = lambda i: F.element_at("_said", i)
    tail = (
        F.when(n == 2, F.concat(F.lit(", then "), item(2)))
        .when(
            n > 2,
            F.concat(F.lit(", then "), F.array_join(F.slice("_said", F.lit(2), F.greatest(n - 2, F.lit(0))), ", "), F.lit(" and "), item(-1)),
        )
        .otherwise("")
    )
    contrast = F.when(
        F.array_contains(F.col("_names"), phrase(least)), ""
    ).otherwise(F.concat(F.lit("; not "), phrase(least)))
    text = F.concat(F.lit("Driven primarily by "), F.try_element_at("_said", F.lit(1)), tail, contrast, F.lit("."))
    return d.withColumn("explanation", F.when(n < 1, F.lit(NOTHING)).otherwise(text)).drop("_said", "_names")


def route(
    defects: DataFrame,
    residuals: DataFrame | None,
    instants: DataFrame | None,
    classes: DataFrame | None,
    covered: tuple = C.POLLUTANTS,
) -> DataFrame:
    """How every defect is explained: by the model where it covers the cell, else by its rule.

    Without residuals there is no model and the answer is marked degraded. `instants` holds the
    (station, instant) pairs that have a feature row.
    """
    d = defects.withColumn(
        "sentence",
        registry.render(lookup(registry.SENTENCE, F.col("reason_code")), F.col("evidence"), F.col("parameter")),
    )
    if residuals is None:
        return d.select(
            *CELL,
            "reason_code",
            F.lit("degraded").alias("method"),
            "sentence",
            F.lit(None).cast("double").alias("residual"),
            F.lit(None).cast("string").alias("fault_class"),
        )
    rows = instants.select("station_id", "timestamp_utc", F.lit(True).alias("_row"))
    j = (
        d.join(rows, ["station_id", "timestamp_utc"], "left")
        .join(residuals.select(*CELL, "residual"), CELL, "left")
        .join(classes.select(*CELL, "fault_class"), CELL, "left")
    )
    model = (
        ~F.col("reason_code").isin(*METADATA_ONLY)
        & F.col("parameter").isin(*covered)
        & F.coalesce("_row", F.lit(False))
    )
    method = F.when(model, "model").otherwise("rule")
    return j.select(
        *CELL,
        "reason_code",
        method.alias("method"),
        "sentence",
        F.when(model, F.col("residual")).alias("residual"),
        "fault_class",
    )
