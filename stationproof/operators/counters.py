"""Cumulative counters: from delivered totals to counts per interval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationproof import config as C
from stationproof.functions import scan
from stationproof.functions.columns import at_secs, micros, secs, sized_broadcast, union_all
from stationproof.functions.state import cut
from stationproof.registry import SEVERITY

KEYS = ["counter_id", "parameter"]
TICK = [*KEYS, "timestamp_utc"]


def unpivot_measures(wide: DataFrame, ids: list[str], measures: list[str]) -> DataFrame:
    """Wide archive (one column per vehicle class) to one row per counter, class and instant."""
    return wide.unpivot(ids, measures, "parameter", "cumulative").where(
        F.col("cumulative").isNotNull()
    )


def _place() -> Column:
    """Place of a row in delivered order, turned so that later ones are smaller; rows without a number come before all others."""
    return F.bitwise_not(F.coalesce(F.col("ingest_seq").cast("bigint"), F.lit(-(1 << 63))))


def _ticks(counts: DataFrame) -> DataFrame:
    """Of each instant, in one pass: the total delivered last, how many competed, first and last place of its rows."""
    given = F.col("cumulative").isNotNull()
    return counts.groupBy(*TICK).agg(
        F.max_by("cumulative", F.when(given, F.col("ingest_seq"))).alias("cumulative"),
        F.count_if(given).alias("n_rows"),
        F.max(_place()).alias("_first"),
        F.min(_place()).alias("_last"),
        F.count(F.lit(1)).alias("_rows"),
    )


def _late(counts: DataFrame, ticks: DataFrame) -> DataFrame:
    """Rows delivered after a row of a later instant.

    Short series are scanned in delivered order. In long ones a row is late where any later instant has a row before it, so
    instants are scanned backwards; rows of equal sequence numbers, whose order is open, do not make each other late there.
    """
    if ticks.groupBy(*KEYS).agg(F.sum("_rows").alias("_n")).where(F.col("_n") > scan.BLOCK_ROWS).isEmpty():
        seen = scan.ordered_scan(counts, KEYS, ["ingest_seq"], maxs={"_max": F.col("timestamp_utc")})
        return seen.where(F.col("timestamp_utc") < F.col("_max")).select(*counts.columns)
    back = ticks.where(F.col("timestamp_utc").isNotNull()).withColumn("_back", -micros("timestamp_utc"))
    back = scan.assign_value_blocks(back, KEYS, "_back")
    seen = scan.drop_blocks(scan.ordered_scan(back, KEYS, ["_back"], maxs={"_ahead": F.col("_first")}))
    some = seen.where(F.col("_last") < F.col("_ahead")).select(*[F.col(c).alias(f"_{c}") for c in TICK], "_ahead")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in KEYS] + [F.col("timestamp_utc") == F.col("_timestamp_utc")]
    return counts.join(sized_broadcast(cut(some)), same).where(_place() < F.col("_ahead")).select(*counts.columns)


def late_rows(counts: DataFrame) -> DataFrame:
    """Rows delivered after a row of a later instant."""
    return _late(counts, cut(_ticks(counts)))


def last_delivered(counts: DataFrame) -> DataFrame:
    """One total per instant, the last delivered one, with how many competed."""
    return counts.where(F.col("cumulative").isNotNull()).groupBy(*TICK).agg(
        F.max_by("cumulative", "ingest_seq").alias("cumulative"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def difference(totals: DataFrame) -> DataFrame:
    """Step to the previous total; the first total stays, so cumulating gives the series back."""
    blocked = scan.assign_blocks(totals, KEYS, seq=None)
    out = scan.ordered_scan(blocked, KEYS, ["timestamp_utc"], lags={"previous": F.col("cumulative")})
    return out.withColumn("delta", F.col("cumulative") - F.coalesce("previous", F.lit(0.0)))


def cumulate(deltas: DataFrame, value: str = "delta", name: str = "recumulated") -> DataFrame:
    if scan.BLK not in deltas.columns:
        deltas = scan.assign_blocks(deltas, KEYS, seq=None)
    return scan.ordered_scan(deltas, KEYS, ["timestamp_utc"], sums={name: F.col(value)})


def increments(totals: DataFrame, ratio: float = C.RESET_RATIO) -> DataFrame:
    """Counts per interval: a large drop is a restart (R05), a small one a backward tick (R06)."""
    d = scan.drop_blocks(difference(totals)).drop("delta")
    prev, cur = F.col("previous"), F.col("cumulative")
    code = F.when(cur >= prev, None).when(cur <= ratio * prev, "R05").when(cur < prev, "R06")
    return d.withColumn("reason_code", code).withColumn(
        "increment",
        F.when(prev.isNull(), 0.0)
        .when(F.col("reason_code") == "R05", cur)
        .when(F.col("reason_code") == "R06", 0.0)
        .otherwise(cur - prev),
    )


def dead_counters(totals: DataFrame, min_points: int = C.DEAD_COUNTER_POINTS) -> DataFrame:
    agg = totals.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n_points"),
        F.min("cumulative").alias("constant_value"),
        F.max("cumulative").alias("_max"),
        F.min("timestamp_utc").alias("since"),
        F.max("timestamp_utc").alias("timestamp_utc"),
    )
    alive = (F.col("n_points") < min_points) | (F.col("_max") > F.col("constant_value"))
    return agg.where(~alive).drop("_max")


def completeness(totals: DataFrame, interval_s: int = C.COUNTER_INTERVAL_S) -> DataFrame:
    n = F.count(F.lit(1))
    span = secs(F.max("timestamp_utc")) - secs(F.min("timestamp_utc"))
    share = F.when(n < 2, 1.0).otherwise(n / (F.floor(span / interval_s) + 1))
    return totals.groupBy(*KEYS).agg(
        n.alias("n_observed"), F.round(share, 6).alias("completeness")
    )


def repair_events(counts: DataFrame) -> DataFrame:
    """Everything a repair had to work around, as flags. The delivered rows are read twice, all else from one row an instant."""
    ticks = cut(_ticks(counts))
    totals = ticks.where("n_rows > 0").drop("_first", "_last", "_rows")
    steps = increments(totals).where(F.col("reason_code").isNotNull())
    mark = lambda df, code: df.select(*TICK, F.lit(code).alias("reason_code"))
    return union_all(
        [
            mark(_late(counts, ticks), "R04"),
            mark(totals.where("n_rows > 1"), "R03"),
            steps.select(*TICK, "reason_code"),
            mark(dead_counters(totals), "R21"),
        ]
    )


def repair_summary(counts: DataFrame, interval_s: int = C.COUNTER_INTERVAL_S) -> DataFrame:
    totals = last_delivered(counts)
    steps = increments(totals)
    span = secs(F.max("timestamp_utc")) - secs(F.min("timestamp_utc"))
    n = F.count(F.lit(1))
    return steps.groupBy(*KEYS).agg(
        n.alias("n_observed"),
        F.count_if(F.col("reason_code") == "R05").alias("n_resets"),
        F.count_if(F.col("reason_code") == "R06").alias("n_nonmonotonic"),
        F.sum(F.col("n_rows") - 1).alias("n_duplicates"),
        ((n >= C.DEAD_COUNTER_POINTS) & (F.min("cumulative") == F.max("cumulative"))).alias("is_dead"),
        F.round(F.when(n < 2, 1.0).otherwise(n / (F.floor(span / interval_s) + 1)), 6).alias(
            "completeness"
        ),
        F.round(F.sum("increment"), 6).alias("throughput"),
    )


def flow(steps: DataFrame, hours: DataFrame, step_s: int = 3600) -> DataFrame:
    """Counts summed per hour and aligned to `hours`; gaps take the median of the whole range.

    Hours inside the counted range that hold nothing count as zero in that median.
    """
    bucket = at_secs((F.floor(secs("timestamp_utc") / step_s) * step_s).cast("bigint"))
    summed = steps.groupBy(bucket.alias("timestamp_utc")).agg(F.sum("increment").alias("flow"))
    span = summed.agg(
        F.min(secs("timestamp_utc")).alias("lo"), F.max(secs("timestamp_utc")).alias("hi")
    )
    full = (
        span.select("lo", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("hi") - F.col("lo")) / step_s).cast("bigint"))).alias("k"))
        .select(at_secs(F.col("lo") + F.col("k") * step_s).alias("timestamp_utc"))
        .join(summed, "timestamp_utc", "left")
        .fillna({"flow": 0.0})
    )
    med = scan.exact_median(full, [], "flow", "m").select("m").scalar()
    return (
        hours.select("timestamp_utc")
        .distinct()
        .join(full, "timestamp_utc", "left")
        .withColumn("_m", med)
        .select("timestamp_utc", F.coalesce("flow", "_m").alias("traffic_flow"))
    )


def counter_defects(counts: DataFrame) -> DataFrame:
    """Repair events in the shape of the defect frame (keyed by counter and class)."""
    ev = repair_events(counts)
    sev = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    return ev.withColumn("severity", F.try_element_at(sev, F.col("reason_code")))
