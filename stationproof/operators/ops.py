"""Follow-up work: tickets and their lifecycle, alerts, drift, sign-offs, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stationproof import config as C
from stationproof import registry
from stationproof.functions import scan
from stationproof.functions.columns import SERIES, literal_table, lookup

TICKET = [*SERIES, "reason_code"]


def severity_weight(c: str = "severity") -> Column:
    return lookup(C.SEVERITY_WEIGHT, F.col(c), C.SEVERITY_DEFAULT)


def tickets(faults: DataFrame, importance: DataFrame | None = None) -> DataFrame:
    """One ticket per (station, parameter, code): worst severity x station importance."""
    per = faults.groupBy(*TICKET, "severity").agg(F.count(F.lit(1)).alias("n"))
    out = per.groupBy(*TICKET).agg(
        F.max_by("severity", severity_weight()).alias("severity"),
        F.sum("n").alias("n_flags"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("severity", "n")))).alias("severity_mix"),
    )
    if importance is None:
        out = out.withColumn("importance", F.lit(1.0))
    else:
        out = out.join(importance, "station_id", "left").fillna({"importance": 1.0})
    sentence = lookup(registry.SENTENCE, F.col("reason_code"))
    text = F.when(F.length(sentence) > 0, sentence).otherwise(F.col("reason_code"))
    return out.withColumns(
        {
            "priority": F.round(severity_weight() * F.col("importance"), 6),
            "headline": F.concat_ws(" · ", "station_id", "parameter", text),
        }
    )


def new_tickets(specs: DataFrame, existing: DataFrame) -> DataFrame:
    """Tickets to open; those on record keep their state untouched."""
    return specs.join(existing.select(*TICKET), TICKET, "left_anti")


def transition_check(log: DataFrame, spark: SparkSession) -> DataFrame:
    """Each step of a ticket with the status it left and whether that step is allowed."""
    blocked = scan.assign_seq_blocks(log, ["item_id"], "seq")
    rows = scan.drop_blocks(
        scan.ordered_scan(blocked, ["item_id"], ["seq"], lags={"_prev": F.col("to_status")})
    ).withColumn("from_status", F.coalesce("_prev", F.lit("open")))
    ok = literal_table(spark, C.TRANSITIONS, "from_status string, to_status string").withColumn("allowed", F.lit(True))
    return rows.drop("_prev").join(ok, ["from_status", "to_status"], "left").fillna({"allowed": False})


def current_status(log: DataFrame) -> DataFrame:
    return log.groupBy("item_id").agg(
        F.max_by("to_status", "seq").alias("status"), F.count(F.lit(1)).alias("n_steps")
    )


def queue(items: DataFrame, status: str | None = None, limit: int = 50, after: tuple | None = None) -> DataFrame:
    """A page of the queue, priority first; the cursor is (priority, id), so no row is skipped."""
    out = items if status is None else items.where(F.col("status") == status)
    if after is not None:
        p, i = after
        out = out.where((F.col("priority") < p) | ((F.col("priority") == p) & (F.col("item_id") > i)))
    return out.orderBy(F.col("priority").desc(), "item_id").limit(limit)


def importance(scores: DataFrame) -> DataFrame:
    """Exposure on the latest trust row of each station."""
    return scores.groupBy("station_id").agg(
        F.max_by("risk.population_exposure", "timestamp_utc").alias("importance")
    )


def alerts(events: DataFrame, station_importance: DataFrame | None = None) -> DataFrame:
    """Events scored by consequence: genuineness x exposure x hazard x confidence weight."""
    e = events
    if station_importance is not None:
        e = e.join(station_importance, "station_id", "left")
    else:
        e = e.withColumn("importance", F.lit(None).cast("double"))
    exposure = F.coalesce("importance", F.lit(1.0))
    genuine = lookup(C.GENUINENESS, F.col("verdict"), C.UNADJUDICATED_GENUINENESS)
    hazard = lookup(C.HAZARD, F.col("severity"), C.HAZARD_DEFAULT)
    sure = 0.5 + 0.5 * F.coalesce("confidence", F.lit(C.UNADJUDICATED_CONFIDENCE))
    return e.withColumns(
        {
            "exposure": exposure,
            "genuineness": genuine,
            "hazard": hazard,
            "confidence_weight": sure,
            "risk": F.round(genuine * exposure * hazard * sure, 6),
        }
    ).drop("importance")


def ranked_alerts(scored: DataFrame, limit: int | None = None) -> DataFrame:
    """Alerts with their `position`: highest risk first, then exposure, then the smaller event id."""
    order = [F.col("risk").desc(), F.col("exposure").desc(), F.col("event_id")]
    return scan.global_rank(scored if limit is None else scored.orderBy(*order).limit(limit), order, "position")


def drift(points: DataFrame, keys: list[str], eps: float = 1e-9) -> DataFrame:
    """Baseline, latest, change and direction of ordered points; `unknown` where no value exists."""
    g = points.groupBy(*keys) if keys else points.groupBy()
    out = g.agg(
        F.count("value").alias("n_points"),
        F.min_by("value", F.when(F.col("value").isNotNull(), F.col("at"))).alias("baseline"),
        F.max_by("value", F.when(F.col("value").isNotNull(), F.col("at"))).alias("latest"),
    ).withColumn("delta", F.col("latest") - F.col("baseline"))
    d = F.col("delta")
    way = F.when(d.isNull(), "unknown").when(d > eps, "up").when(d < -eps, "down").otherwise("flat")
    return out.withColumn("direction", way)


def defect_rate_drift(counts: DataFrame) -> DataFrame:
    """`counts`: run_id, at, station_id, n_defects, n_covered; defect rate in percent over runs."""
    rate = F.when(F.col("n_covered") > 0, 100.0 * F.col("n_defects") / F.col("n_covered")).otherwise(0.0)
    return drift(counts.withColumn("value", rate), ["station_id"])


def coverage_drift(points: DataFrame, nominal: float) -> DataFrame:
    """Interval coverage over time, read against the promised share: `points` has at and value."""
    out = drift(points, [])
    return out.withColumns({"nominal": F.lit(nominal), "off_nominal": F.col("latest") - F.lit(nominal)})


def check_dispatches(requests: DataFrame, signoffs: DataFrame) -> DataFrame:
    """Every dispatch request with the sign-off it names and why it is refused, if it is."""
    s = signoffs.select(
        "signoff_id",
        F.col("event_id").alias("_e"),
        F.col("channel").alias("_c"),
        "revoked",
        "expires_at",
    )
    j = requests.join(s, "signoff_id", "left")
    reason = (
        F.when(F.col("_e").isNull(), "missing")
        .when((F.col("_e") != F.col("event_id")) | (F.col("_c") != F.col("channel")), "mismatch")
        .when(F.col("revoked"), "revoked")
        .when(F.col("expires_at") <= F.col("requested_at"), "expired")
        .otherwise("ok")
    )
    return j.withColumn("reason", reason).drop("_e", "_c", "revoked", "expires_at")


def dispatches(checked: DataFrame) -> DataFrame:
    """One dispatch per (event, channel, sign-off): the first accepted request."""
    return (
        checked.where("reason = 'ok'")
        .groupBy("event_id", "channel", "signoff_id")
        .agg(
            F.min_by("request_id", F.struct("requested_at", "request_id")).alias("request_id"),
            F.min("requested_at").alias("dispatched_at"),
        )
    )


def status_totals(items: DataFrame) -> DataFrame:
    return items.groupBy("status").agg(F.count(F.lit(1)).alias("n_tickets"))


def recent(df: DataFrame, at: str, key: str, limit: int) -> DataFrame:
    return df.orderBy(F.col(at).desc(), F.col(key).desc()).limit(limit)
