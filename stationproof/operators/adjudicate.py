"""Is a spike a real plume or a broken sensor? All candidates against all neighbours, one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stationproof import config as C
from stationproof.functions import geo, prefix, scan
from stationproof.functions.columns import CELL, SERIES, at_secs, secs, sized_broadcast
from stationproof.functions.state import cut
from stationproof.operators import graph

#: Rows that requests and the histories of their series may make when they are joined.
MOST_ROWS = 20_000_000
AMBIGUOUS, GENUINE, FAULT = "AMBIGUOUS", "GENUINE_EVENT", "LIKELY_FAULT"


def last_values(readings: DataFrame) -> DataFrame:
    """The last delivered reading of every cell."""
    return readings.groupBy(*CELL).agg(
        F.max_by("value", "ingest_seq").alias("value"), F.max_by("unit", "ingest_seq").alias("unit")
    )


def baselines(
    asked: DataFrame,
    keys: list[str],
    values: DataFrame,
    hours: int = C.BASELINE_HOURS,
    whole_series: bool = False,
    most_rows: int = MOST_ROWS,
) -> DataFrame:
    """Median of a series before an instant: trailing window, else everything earlier, else
    (on request) the whole series.

    `asked` has keys, station_id, parameter and timestamp_utc. The window is met by an equality
    on half-window buckets; only requests without any reading in it look further back.
    """
    width = hours * 3600
    v = values.where(F.col("value").isNotNull()).select(
        *SERIES, secs("timestamp_utc").alias("_s"), F.col("value").alias("_val")
    )
    q = asked.select(*keys, *SERIES, secs("timestamp_utc").alias("_t"))
    bucket = lambda s: F.floor(s / width).cast("bigint")
    b = bucket(F.col("_t"))
    wide = q.withColumn("_b", F.explode(F.array(b - 1, b)))
    near = wide.join(v.withColumn("_b", bucket(F.col("_s"))), [*SERIES, "_b"]).where(
        (F.col("_s") >= F.col("_t") - width) & (F.col("_s") < F.col("_t"))
    )
    out = cut(scan.exact_median(near, keys, "_val", "baseline"))
    open_q = cut(q.join(out.select(*keys), keys, "left_anti"))
    if open_q.isEmpty():
        return out
    second = cut(earlier_baselines(open_q, keys, v, most_rows))
    found = out.unionByName(second)
    if whole_series:
        rest = open_q.join(second.select(*keys), keys, "left_anti")
        of_series = scan.exact_median(v.join(sized_broadcast(rest.select(*SERIES).distinct()), SERIES, "left_semi"), SERIES, "_val", "baseline")
        found = found.unionByName(rest.join(of_series, SERIES).select(*keys, "baseline"))
    return found


def earlier_baselines(asked: DataFrame, keys: list[str], values: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """Median of everything before each request.

    Where requests times the rows of their series stay within `most_rows`, they are joined; beyond that the medians come from
    counts over a tree of days. The results are the same.
    """
    per_series = asked.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("_q")).join(values.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("_n")), SERIES)
    if (per_series.agg(F.sum(F.col("_q") * F.col("_n"))).first()[0] or 0) <= most_rows:
        earlier = asked.join(values, SERIES).where(F.col("_s") < F.col("_t"))
        return scan.exact_median(earlier, keys, "_val", "baseline")
    return prefix.earlier_medians(asked, keys, values, SERIES, "baseline")


def candidates(events: DataFrame, values: DataFrame, hours: int = C.BASELINE_HOURS) -> DataFrame:
    """Events with their value, baseline and excess; those whose series does not exist drop out.

    `events`: event_id, station_id, parameter, timestamp_utc, fallback_value, audit_rank.
    """
    carried = events.join(values.select(*SERIES).distinct(), SERIES, "left_semi")
    at = carried.join(values.select(*CELL, "value", "unit"), CELL, "left").withColumn(
        "value", F.coalesce("value", "fallback_value")
    )
    at = cut(at.where(F.col("value").isNotNull()))
    base = baselines(at, ["event_id"], values, hours, whole_series=True)
    return cut(
        at.join(base, "event_id", "left")
        .fillna({"baseline": 0.0})
        .withColumn("excess", F.col("value") - F.col("baseline"))
    )


def rank(cands: DataFrame, limit: int | None = None) -> DataFrame:
    """Largest excess first, then the audit's rank, then station."""
    order = [F.round("excess", 9).desc(), F.col("audit_rank"), F.col("station_id")]
    return scan.global_rank(cands if limit is None else cands.orderBy(*order).limit(limit), order, "rank")


def arrival(cands: DataFrame, neighbours: DataFrame) -> DataFrame:
    """When and how strongly a plume should reach each downwind neighbour."""
    j = cands.join(neighbours, F.col("station_id") == F.col("src")).drop("src")
    j = j.withColumn("edge_weight", graph.wind_weight("from_deg", "speed", "distance_km", "bearing_deg"))
    j = j.where(F.col("edge_weight") >= C.WEIGHT_FLOOR)
    align = F.cos(F.radians(geo.angle_diff("bearing_deg", geo.travel_bearing("from_deg"))))
    along = F.col("speed") * align
    delay = F.col("distance_km") * 1000.0 / F.greatest(along, F.lit(C.SPEED_FLOOR)) / 60.0
    decay = F.when(F.col("distance_km") > C.CUTOFF_KM, 0.0).otherwise(
        F.exp(-F.col("distance_km") / C.DISTANCE_DECAY_KM)
    )
    reach = F.greatest(decay, F.lit(C.ATTENUATION_FLOOR))
    return j.withColumns(
        {
            "along_wind_speed": along,
            "arrival_delay_min": delay,
            "attenuation": reach,
            "expected_excess": F.col("excess") * reach,
            "within_horizon": delay <= C.HORIZON_MAX_MIN,
            "expectation_origin": F.lit("analytic"),
        }
    )


def learned_expectation(
    asked: DataFrame, forecast: DataFrame, values: DataFrame, step_s: int = C.EVALUATION_S, hours: int = C.BASELINE_HOURS
) -> DataFrame:
    """What the model expects above each neighbour's own baseline at the evaluation hour.

    `asked`: event_id, parameter and timestamp_utc of the events on the model's target; `forecast`:
    station_id, timestamp_utc, y_hat, sigma. A neighbour without forecast or baseline has no row.
    """
    later = forecast.select(F.col("station_id").alias("dst"), F.col("timestamp_utc").alias("_at"), "y_hat", "sigma")
    at = asked.select("event_id", "parameter", "timestamp_utc").withColumn("_at", at_secs(secs("timestamp_utc") + step_s)).join(later, "_at")
    base = baselines(at.withColumn("station_id", F.col("dst")), ["event_id", "dst"], values, hours)
    return (
        at.where(F.col("y_hat").isNotNull())
        .join(base, ["event_id", "dst"])
        .select("event_id", "dst", (F.col("y_hat") - F.col("baseline")).alias("learned_excess"), "sigma")
    )


def with_learned(expected: DataFrame, learned: DataFrame, q: float | None = None) -> DataFrame:
    """Replace the analytic expectation by a learned one where one exists.

    `learned`: event_id, dst, learned_excess, sigma. With a calibrated `q` a learned expectation
    carries the interval of q sigma on either side; otherwise the interval is null.
    """
    j = expected.join(learned, ["event_id", "dst"], "left")
    has = F.col("learned_excess").isNotNull()
    return j.withColumns(
        {
            "expected_excess": F.coalesce("learned_excess", "expected_excess"),
            "expectation_origin": F.when(has, "learned").otherwise("analytic"),
            "expected_low": F.col("learned_excess") - F.lit(q).cast("double") * F.col("sigma"),
            "expected_high": F.col("learned_excess") + F.lit(q).cast("double") * F.col("sigma"),
        }
    ).drop("learned_excess")


def neighbour_evidence(
    expected: DataFrame, values: DataFrame, step_s: int = C.EVALUATION_S, hours: int = C.BASELINE_HOURS
) -> DataFrame:
    """What each neighbour actually did at the evaluation hour, and whether it corroborates."""
    ask = expected.select(
        "event_id", F.col("dst").alias("station_id"), "parameter", "timestamp_utc"
    )
    base = baselines(ask.withColumn("dst", F.col("station_id")), ["event_id", "dst"], values, hours)
    base = base.withColumnRenamed("baseline", "_base")
    carried = values.select(F.col("station_id").alias("dst"), "parameter").distinct().withColumn(
        "_carries", F.lit(True)
    )
    later = values.select(
        F.col("station_id").alias("dst"),
        "parameter",
        F.col("timestamp_utc").alias("_at"),
        F.col("value").alias("_actual"),
    )
    j = (
        expected.withColumn("_at", at_secs(secs("timestamp_utc") + step_s))
        .join(carried, ["dst", "parameter"], "left")
        .join(base, ["event_id", "dst"], "left")
        .join(later, ["dst", "parameter", "_at"], "left")
    )
    actual = F.col("_actual") - F.col("_base")
    hit = (
        F.col("within_horizon")
        & (F.col("expected_excess") > 0)
        & (F.col("actual_excess") >= F.col("expected_excess") * (1.0 - C.CORROBORATION_TOLERANCE))
    )
    return (
        j.withColumn("carries_parameter", F.coalesce("_carries", F.lit(False)))
        .withColumn("actual_excess", actual)
        .withColumn("corroborated", F.coalesce(hit, F.lit(False)))
        .drop("_carries", "_at", "_actual", "_base")
    )


def band(confidence: Column) -> Column:
    return (
        F.when(confidence >= C.BAND_HIGH, "high")
        .when(confidence >= C.BAND_MODERATE, "moderate")
        .otherwise("low")
    )


def decide(cands: DataFrame, evidence: DataFrame) -> DataFrame:
    """Verdict, confidence and reason per candidate from the share of corroborating weight."""
    usable = F.col("carries_parameter") & F.col("actual_excess").isNotNull()
    w = F.col("edge_weight")
    tally = evidence.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("n_downwind"),
        F.count_if(usable).alias("n_usable"),
        F.sum(F.when(usable, w)).alias("_all"),
        F.sum(F.when(usable & F.col("corroborated"), w)).alias("_yes"),
    )
    j = cands.join(tally, "event_id", "left").fillna({"n_downwind": 0, "n_usable": 0})
    score = F.coalesce(F.coalesce("_yes", F.lit(0.0)) / F.nullif(F.col("_all"), F.lit(0.0)), F.lit(0.0))
    j = j.withColumn("match_score", score)
    enough = F.col("n_usable") >= C.MIN_USABLE
    m = F.round("match_score", 12)
    verdict = (
        F.when(~enough, AMBIGUOUS)
        .when(m >= C.GENUINE_AT, GENUINE)
        .when(m <= C.FAULT_AT, FAULT)
        .otherwise(AMBIGUOUS)
    )
    j = j.withColumn("verdict", verdict)
    confidence = (
        F.when(F.col("verdict") == GENUINE, F.col("match_score"))
        .when(F.col("verdict") == FAULT, 1.0 - F.col("match_score"))
        .otherwise(C.AMBIGUOUS_CAP)
    )
    code = F.when(F.col("verdict") == GENUINE, "R22").when(F.col("verdict") == FAULT, "R17").otherwise("R23")
    return j.withColumns(
        {
            "confidence": F.round(confidence, 4),
            "reason_code": code,
            "routes_to_review": F.col("verdict") == AMBIGUOUS,
        }
    ).withColumn("confidence_band", band(F.col("confidence"))).drop("_all", "_yes")


def verdict_violations(verdicts: DataFrame) -> DataFrame:
    """Ambiguous verdicts must stay capped, below high, and go to review; must be empty."""
    amb = F.col("verdict") == AMBIGUOUS
    return verdicts.where(
        (amb & ((F.col("confidence") > C.AMBIGUOUS_CAP) | (F.col("confidence_band") == "high")))
        | (amb != F.col("routes_to_review"))
        | ~F.col("confidence").between(0.0, 1.0)
    )


def overlay(cands: DataFrame, evidence: DataFrame, step_s: int = C.EVALUATION_S) -> DataFrame:
    """Expected and actual excess of the neighbourhood at the event and one step later."""
    w = F.col("edge_weight")
    total = F.nullif(F.sum(w), F.lit(0.0))
    u = evidence.where(F.col("carries_parameter") & F.col("actual_excess").isNotNull())
    mean = u.groupBy("event_id").agg(
        (F.sum(w * F.col("expected_excess")) / total).alias("_e"),
        (F.sum(w * F.col("actual_excess")) / total).alias("_a"),
    )
    j = cands.select("event_id", "timestamp_utc").join(mean, "event_id", "left")
    t1 = at_secs(secs("timestamp_utc") + step_s)
    points = F.array(
        F.struct(F.lit(0).alias("step"), F.col("timestamp_utc").alias("at"), F.lit(0.0).alias("expected"), F.lit(0.0).alias("actual")),
        F.struct(F.lit(1).alias("step"), t1.alias("at"), F.coalesce("_e", F.lit(0.0)).alias("expected"), F.col("_a").alias("actual")),
    )
    return j.select("event_id", F.inline(points))


def adjudicate(
    cands: DataFrame,
    values: DataFrame,
    pairs: DataFrame,
    stations: DataFrame,
    local: DataFrame,
    city: DataFrame,
    step_s: int = C.EVALUATION_S,
    learned: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Verdicts and neighbour evidence of every candidate.

    Without coordinates or wind (or in a calm) there is no neighbour to ask, so the tally is
    empty and the verdict falls to AMBIGUOUS.
    """
    located = cands.join(stations.select("station_id"), "station_id", "left_semi")
    windy = graph.wind_lookup(located, local, city).where(F.col("speed") >= C.CALM_SPEED)
    expected = arrival(windy, pairs)
    if learned is not None:
        expected = with_learned(expected, learned)
    evidence = neighbour_evidence(cut(expected), values, step_s)
    return decide(cands, evidence), evidence


def write_back(events: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Events with their verdict; running it again replaces the verdict, never the event."""
    keep = [c for c in events.columns if c not in ("verdict", "confidence")]
    return events.select(*keep).join(verdicts.select("event_id", "verdict", "confidence"), "event_id", "left")


def bundle_rows(evidence: DataFrame) -> DataFrame:
    """Neighbour rows of the evidence bundles in display order (heaviest edge first).

    One row per neighbour instead of one nested record per event: an event can have any number
    of neighbours.
    """
    w = W.partitionBy("event_id").orderBy(F.round("edge_weight", 9).desc(), "dst")
    return evidence.withColumn("position", F.row_number().over(w).cast("bigint"))


def wind_note(windy: DataFrame) -> DataFrame:
    """Wind at the source of each event, from `graph.wind_lookup`: whence, whither, speed and origin."""
    return windy.select(
        "event_id",
        F.round("from_deg", 2).alias("from_deg"),
        F.round(geo.travel_bearing("from_deg"), 2).alias("to_deg"),
        F.round("speed", 4).alias("speed"),
        "wind_origin",
    )
