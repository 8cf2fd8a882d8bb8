"""Detectors. Each returns the defect frame: cell, reason code, severity, evidence, rank value.

Detectors that judge single rows against bounds or against facts of their series share one
pass over the readings (`row_flags`); the others need an order or a second parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationproof import config as C
from stationproof.functions import scan
from stationproof.functions.columns import (
    CELL,
    SERIES,
    at_secs,
    humanise,
    is_close,
    iso,
    lookup,
    secs,
    sized_broadcast,
    steps_for_hours,
    union_all,
)
from stationproof.functions.state import cut
from stationproof.operators import coverage as cov_ops
from stationproof.operators import runs
from stationproof.operators.coverage import Coverage
from stationproof.registry import SEVERITY

COLUMNS = [*CELL, "reason_code", "severity", "evidence", "rank_value"]


def _evidence(**items) -> Column:
    pairs = [x for k, v in items.items() for x in (F.lit(k), v.cast("string"))]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")


def _defects(df: DataFrame, code: str, rank: Column | None = None, **evidence) -> DataFrame:
    return df.select(
        *CELL,
        F.lit(code).alias("reason_code"),
        F.lit(SEVERITY[code]).alias("severity"),
        _evidence(**evidence).alias("evidence"),
        (F.lit(None) if rank is None else rank).cast("double").alias("rank_value"),
    )


def row_absent(cov: Coverage) -> DataFrame:
    ticks = cov_ops.absent_ticks(cov.gap_ranges)
    return _defects(ticks, "R01", expected_at=iso("timestamp_utc"))


def communication_gaps(cov: Coverage, hours: int = C.GAP_HOURS) -> DataFrame:
    r = runs.range_runs(cov.gap_ranges, cov.n_rows)
    need = steps_for_hours(hours, F.col("cadence_s"))
    tick = lambda k: at_secs(F.col("start_s") + F.col(k) * F.col("cadence_s"))
    long = r.where(F.col("n_ticks") >= need).select(
        *SERIES, tick("k_lo").alias("timestamp_utc"), tick("k_hi").alias("_end"), "n_ticks", "cadence_s"
    )
    return _defects(
        long,
        "R02",
        F.col("n_ticks"),
        duration=humanise(F.col("n_ticks") * F.col("cadence_s")),
        missing_ticks=F.col("n_ticks"),
        gap_start=iso("timestamp_utc"),
        gap_end=iso("_end"),
    )


def duplicate_timestamps(readings: DataFrame) -> DataFrame:
    dup = cov_ops.cells(readings).where("n_readings > 1")
    return _defects(dup, "R03", n_readings=F.col("n_readings"))


def duplicate_values(readings: DataFrame) -> DataFrame:
    """The competing values of every duplicated cell, one row each: a cell may have any number."""
    dup = cov_ops.cells(readings).where("n_readings > 1").select(*CELL, "n_readings")
    return readings.select(*CELL, "value", "ingest_seq").join(dup, CELL)


def out_of_order(readings: DataFrame, at_most: int | None = None) -> DataFrame:
    blocked = scan.assign_seq_blocks(
        readings.select(*CELL, "ingest_seq"), SERIES, at_most=at_most
    )
    seen = scan.ordered_scan(
        blocked, SERIES, ["ingest_seq"], maxs={"_max": F.col("timestamp_utc")}
    )
    late = seen.where(F.col("timestamp_utc") < F.col("_max"))
    return _defects(late, "R04", previous_max=iso("_max"), this_timestamp=iso("timestamp_utc"))


def cross_parameter(readings: DataFrame, rules=C.CROSS_RULES) -> DataFrame:
    """A fine fraction above the coarse one that contains it, at the same station and instant."""
    out = []
    for fine, coarse, tolerance in rules:
        usable = readings.where(F.col("parameter").isin(fine, coarse) & F.col("value").isNotNull())
        first = lambda p: F.min_by(
            F.col("value"), F.when(F.col("parameter") == p, F.col("ingest_seq"))
        )
        pair = usable.groupBy("station_id", "timestamp_utc").agg(
            first(fine).alias("_f"), first(coarse).alias("_c")
        )
        bad = pair.where(F.col("_f") > F.col("_c") + tolerance).withColumn("parameter", F.lit(fine))
        excess = F.round(F.col("_f") - F.col("_c"), 4)
        out.append(
            _defects(bad, "R09", excess, pm25=F.col("_f"), pm10=F.col("_c"), excess=excess)
        )
    return union_all(out)


def mislabelled_units(cov: Coverage, rules: dict) -> DataFrame:
    """Series whose declared unit contradicts the range their median lies in."""
    r = cov.readings.where(F.col("parameter").isin(list(rules)))
    pick = lambda i: lookup({p: v[i] for p, v in rules.items()}, F.col("parameter"))
    declares = r.where(F.col("unit") == pick(0)).select(*SERIES).distinct()
    med = scan.exact_median(
        r.join(declares, SERIES, "left_semi"), SERIES, "value", "observed_median", cov.n_rows
    )
    return med.where(F.col("observed_median").between(pick(2), pick(3))).select(
        *SERIES,
        pick(0).alias("declared"),
        pick(1).alias("inferred"),
        F.round("observed_median", 3).alias("observed_median"),
    )


def degraded_spread(series: DataFrame) -> DataFrame:
    """Series whose spread is a small part of the median spread of moving peers."""
    peers = (
        series.where("v_std > 0")
        .groupBy("parameter")
        .agg(F.median("v_std").alias("peer_std"), F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") >= C.LOW_VARIANCE_MIN_PEERS)
    )
    low = (F.col("v_std") > 0) & (F.col("v_std") < C.LOW_VARIANCE_FRACTION * F.col("peer_std"))
    return series.join(peers, "parameter").where(low).select(*SERIES, "v_std", "peer_std")


def frozen_series(series: DataFrame) -> DataFrame:
    return series.where("n_values >= 2 AND v_min = v_max").select(
        *SERIES,
        humanise(secs("end") - secs("start") + F.col("cadence_s")).alias("frozen_for"),
        F.col("v_min").alias("frozen_value"),
        F.col("n_values").alias("frozen_n"),
    )


ROW_CODES = ("R07", "R08", "R10", "R12", "R13")


def row_flags(cov: Coverage, codes=ROW_CODES, bounds=None, unit_rules=None) -> DataFrame:
    """All flags that one reading can earn by itself or through its series, in one pass."""
    bounds = C.BOUNDS if bounds is None else bounds
    rules = C.UNIT_RULES if unit_rules is None else unit_rules
    rows = cov.readings.select(*CELL, "value", "unit")
    facts = None
    for code, frame in (
        ("R10", lambda: mislabelled_units(cov, rules)),
        ("R12", lambda: frozen_series(cov.series)),
        ("R13", lambda: degraded_spread(cov.series)),
    ):
        if code in codes:
            f = frame()
            facts = f if facts is None else facts.join(f, SERIES, "full")
    if facts is not None:
        only_series = not {"R07", "R08"} & set(codes)
        rows = rows.join(sized_broadcast(cut(facts)), SERIES, "inner" if only_series else "left")
    lo = lookup({p: b[0] for p, b in bounds.items()}, F.col("parameter"))
    hi = lookup({p: b[1] for p, b in bounds.items()}, F.col("parameter"))
    v = F.col("value")

    def flag(code: str, when: Column, rank: Column | None = None, **evidence) -> Column:
        return F.when(
            when,
            F.struct(
                F.lit(code).alias("reason_code"),
                F.lit(SEVERITY[code]).alias("severity"),
                _evidence(**evidence).alias("evidence"),
                (F.lit(None) if rank is None else rank).cast("double").alias("rank_value"),
            ),
        )

    def make(code: str) -> Column:
        if code == "R07":
            return flag("R07", v > hi, v, value=v, limit=hi, unit=F.col("unit"))
        if code == "R08":
            return flag("R08", v < lo, value=v, limit=lo, unit=F.col("unit"))
        if code == "R10":
            return flag(
                "R10",
                F.col("declared").isNotNull(),
                declared=F.col("declared"),
                inferred=F.col("inferred"),
                observed_median=F.col("observed_median"),
            )
        if code == "R12":
            return flag(
                "R12",
                F.col("frozen_n").isNotNull(),
                F.col("frozen_n"),
                duration=F.col("frozen_for"),
                frozen_value=F.col("frozen_value"),
                n_readings=F.col("frozen_n"),
            )
        return flag(
            "R13",
            F.col("peer_std").isNotNull(),
            window=F.lit("full record"),
            sensor_std=F.round("v_std", 5),
            peer_median_std=F.round("peer_std", 5),
        )

    hits = F.filter(F.array(*[make(c) for c in codes]), lambda x: x.isNotNull())
    return rows.select(*CELL, F.inline(hits)).select(*COLUMNS)


def detection_floor(cov: Coverage, floors=None, hours: int = C.FLOOR_HOURS) -> DataFrame:
    """Long runs of readings pinned at the detection limit."""
    floors = C.FLOORS if floors is None else floors
    limit = lookup({p: f[0] for p, f in floors.items()}, F.col("parameter"))
    unit = lookup({p: f[1] for p, f in floors.items()}, F.col("parameter"))
    r = cov.readings.where(F.col("parameter").isin(list(floors))).select(
        *CELL,
        "ingest_seq",
        F.coalesce(is_close(F.col("value"), limit), F.lit(False)).cast("int").alias("_at"),
    )
    rows = runs.equal_value_rows(r, SERIES, "_at", at_most=cov.n_rows)
    rows = scan.drop_blocks(rows).where("_at = 1")
    lengths = rows.groupBy(*SERIES, "_run").agg(F.count(F.lit(1)).alias("run_length"))
    long = runs.with_cadence(lengths, cov.series).where(
        F.col("run_length") >= steps_for_hours(hours, F.col("cadence_s"))
    )
    hit = rows.join(long.select(*SERIES, "_run", "run_length"), [*SERIES, "_run"])
    return _defects(hit, "R11", limit=limit, unit=unit, run_length=F.col("run_length"))


def in_scope(readings: DataFrame, bounds=None, floors=None) -> DataFrame:
    """Readings a level shift may be judged on: present, possible and not censored."""
    bounds = C.BOUNDS if bounds is None else bounds
    floors = C.FLOORS if floors is None else floors
    v = F.col("value")
    lo = lookup({p: b[0] for p, b in bounds.items()}, F.col("parameter"))
    hi = lookup({p: b[1] for p, b in bounds.items()}, F.col("parameter"))
    fl = lookup({p: f[0] for p, f in floors.items()}, F.col("parameter"))
    ok = (
        v.isNotNull()
        & F.coalesce(v >= lo, F.lit(True))
        & F.coalesce(v <= hi, F.lit(True))
        & ~F.coalesce(is_close(v, fl), F.lit(False))
    )
    return readings.where(ok).select(*CELL, "value", "ingest_seq")


def step_change(cov: Coverage, bounds=None, floors=None, k=C.CUSUM_K, h=C.CUSUM_H) -> DataFrame:
    """One sustained shift per series: a two-sided CUSUM says whether, the best split says where.

    The recursive CUSUM max(0, c + z - k) equals a running sum minus its own running minimum,
    so both sides are two ordered scans.
    """
    scope = in_scope(cov.readings, bounds, floors)
    v = F.col("value")
    stats = (
        scope.groupBy(*SERIES)
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.avg(v).alias("_mean"),
            F.stddev_pop(v).alias("_std"),
            F.sum(v).alias("_total"),
            F.min(v).alias("_lo"),
            F.max(v).alias("_hi"),
        )
        .where((F.col("_n") >= C.CUSUM_MIN_POINTS) & (F.col("_lo") < F.col("_hi")))
        .drop("_lo", "_hi")
    )
    rows = scan.assign_blocks(scope, SERIES, at_most=cov.n_rows).join(stats, SERIES)
    z = (v - F.col("_mean")) / F.col("_std")
    order = ["timestamp_utc", "ingest_seq"]
    rows = scan.ordered_scan(
        rows,
        SERIES,
        order,
        sums={"_p": v, "_i": F.lit(1).cast("bigint"), "_up": z - k, "_dn": -z - k},
    )
    rows = scan.ordered_scan(
        rows, SERIES, order, mins={"_up_min": F.col("_up"), "_dn_min": F.col("_dn")}
    )
    zero = F.lit(0.0)
    cusum = F.greatest(
        F.col("_up") - F.least(zero, F.col("_up_min")),
        F.col("_dn") - F.least(zero, F.col("_dn_min")),
    )
    head = F.col("_i") - 1
    before = (F.col("_p") - v) / F.when(head > 0, head)
    after = (F.col("_total") - F.col("_p") + v) / (F.col("_n") - head)
    best = rows.groupBy(*SERIES).agg(
        F.max(cusum).alias("_c"),
        F.max_by(
            F.struct(
                "timestamp_utc",
                before.alias("before"),
                after.alias("after"),
                F.col("_mean").alias("mean"),
            ),
            F.struct(F.round(F.abs(after - before), 9).alias("d"), (-F.col("_i")).alias("i")),
        ).alias("_s"),
    )
    hit = best.where(F.col("_c") > h).join(cov.series.select(*SERIES, "unit"), SERIES)
    hit = hit.withColumn("timestamp_utc", F.col("_s.timestamp_utc"))
    shift = F.round(F.col("_s.after") - F.col("_s.before"), 4)
    return _defects(
        hit,
        "R14",
        F.abs(shift),
        magnitude=F.abs(shift),
        signed_magnitude=shift,
        unit=F.col("unit"),
        level_before=F.round("_s.before", 4),
        level_after=F.round("_s.after", 4),
        baseline_mean=F.round("_s.mean", 4),
    )


def structural(cov: Coverage, absences: DataFrame | None = None) -> DataFrame:
    series = cov.series
    if absences is None:
        absences = cov_ops.structural_absences(cov.readings, series, cov.n_rows)
    anchor = series.agg(F.min("start")).scalar()
    return absences.select(
        *SERIES,
        anchor.alias("timestamp_utc"),
        "reason_code",
        lookup(SEVERITY, F.col("reason_code")).alias("severity"),
        _evidence(
            domain=F.col("domain"),
            excluded_cells=F.col("excluded_cells"),
            note=F.lit("structural coverage fact; excluded from the defect rate"),
        ).alias("evidence"),
        F.lit(None).cast("double").alias("rank_value"),
    )


def dead_sensors(series: DataFrame, hours: int = C.DEAD_HOURS) -> DataFrame:
    end = series.agg(F.max("end")).scalar()
    s = series.withColumn("_end", end).withColumn("_silent", secs("_end") - secs("end"))
    dead = s.where(F.col("_silent") >= hours * 3600).withColumn("timestamp_utc", F.col("end"))
    silent = F.floor(F.col("_silent") / 3600).cast("bigint")
    return _defects(
        dead, "R21", silent, since=iso("end"), silent_hours=silent, window_end=iso("_end")
    )


def run_all(cov: Coverage, bounds=None, unit_rules=None, floors=None, rules=C.CROSS_RULES) -> DataFrame:
    """The union of all detectors; unordered, ordering is the sink's business."""
    r = cov.readings
    return union_all(
        [
            row_absent(cov),
            communication_gaps(cov),
            duplicate_timestamps(r),
            out_of_order(r, cov.n_rows),
            row_flags(cov, ROW_CODES, bounds, unit_rules),
            cross_parameter(r, rules),
            detection_floor(cov, floors),
            step_change(cov, bounds, floors),
            structural(cov),
            dead_sensors(cov.series),
        ]
    )
