"""Trust and risk of every station at every scoring instant, in one plan.

Instants lie a fixed cadence apart and each looks back over a fixed window, so every row
belongs to a known handful of them. Rows are expanded to the instants they count for, which
turns "within the trailing window" into an equality; no range join is needed anywhere.
Instants are addressed by `k`, the number of steps back from the last reading.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stationproof import config as C
from stationproof import registry
from stationproof.functions import scan
from stationproof.functions.columns import CELL, SERIES, at_secs, lookup, secs, sized_broadcast
from stationproof.functions.state import cut
from stationproof.operators import runs
from stationproof.operators.coverage import Coverage

WINDOW_S = C.WINDOW_HOURS * 3600
STEP_S = C.INSTANT_CADENCE_H * 3600
KEY = ["station_id", "k"]


class Clock(NamedTuple):
    """Last reading and number of scoring instants, as scalar columns."""

    end_s: Column
    n: Column


def clock(series: DataFrame, max_points: int | None = None) -> Clock:
    """All scoring instants of the network's span, or the last `max_points` of them."""
    ends = series.agg(F.min(secs("start")).alias("lo"), F.max(secs("end")).alias("hi"))
    n = F.floor((F.col("hi") - F.col("lo")) / STEP_S) + 1
    n = n if max_points is None else F.least(F.lit(max_points), n)
    return Clock(ends.select("hi").scalar(), ends.select(n.cast("bigint")).scalar())


def instants(series: DataFrame, max_points: int | None = None) -> DataFrame:
    c = clock(series, max_points)
    one = series.agg(F.count(F.lit(1)).alias("_n")).withColumns({"_end": c.end_s, "_k": c.n})
    steps = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_k") - 1))
    return one.select("_end", steps.alias("k")).select(
        "k", at_secs(F.col("_end") - F.col("k") * STEP_S).alias("at")
    )


def _expand(df: DataFrame, c: Clock, first: Column, last: Column) -> DataFrame:
    """Repeat rows for each instant whose window meets the epoch seconds [first, last]."""
    d = df.withColumns({"_end": c.end_s, "_nk": c.n})
    lo = F.greatest(F.lit(0), F.floor((F.col("_end") - last - WINDOW_S) / STEP_S) + 1)
    hi = F.least(F.col("_nk") - 1, F.floor((F.col("_end") - first) / STEP_S))
    d = d.withColumns({"_klo": lo.cast("bigint"), "_khi": hi.cast("bigint")})
    return (
        d.where("_khi >= _klo")
        .withColumn("k", F.explode(F.sequence("_klo", "_khi")))
        .withColumn("at_s", F.col("_end") - F.col("k") * STEP_S)
        .drop("_end", "_nk", "_klo", "_khi")
    )


def in_windows(df: DataFrame, c: Clock, ts: str = "timestamp_utc") -> DataFrame:
    """Rows repeated per instant `at` with `at - window < ts <= at`."""
    return _expand(df, c, secs(ts), secs(ts))


def weight(severity) -> Column:
    return lookup(C.SEVERITY_WEIGHT, F.col(severity), C.SEVERITY_DEFAULT)


def covered_cells(series: DataFrame, c: Clock) -> DataFrame:
    """Expected cells per station and instant by arithmetic, and the tick range of each window."""
    s = series.select(
        *SERIES, "cadence_s", "n_expected", secs("start").alias("s0"), secs("end").alias("s1")
    ).withColumns({"_end": c.end_s, "_nk": c.n})
    s = s.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_nk") - 1)))
    at = F.col("_end") - F.col("k") * STEP_S
    cad = F.col("cadence_s")
    lo = F.greatest(F.col("s0"), at - WINDOW_S + cad)
    hi = F.least(F.col("s1"), at)
    i_lo = F.greatest(F.lit(0), F.floor((at - WINDOW_S - F.col("s0")) / cad) + 1)
    i_hi = F.least(F.col("n_expected") - 1, F.floor((at - F.col("s0")) / cad))
    return s.groupBy(*KEY).agg(
        F.sum(F.when(hi >= lo, F.floor((hi - lo) / cad) + 1).otherwise(0)).cast("bigint").alias("covered"),
        F.sum(F.greatest(F.lit(0), i_hi - i_lo + 1)).cast("bigint").alias("expected"),
    )


def health(defects: DataFrame, series: DataFrame, c: Clock, covered: DataFrame) -> DataFrame:
    """exp(-load/decay), load = worst severity weight per defective cell over covered cells."""
    d = defects.where(registry.counts("reason_code"))
    cell = d.groupBy(*CELL).agg(F.max(weight("severity")).alias("w"))
    load = in_windows(cell, c).groupBy(*KEY).agg(
        F.sum("w").alias("weighted"), F.count(F.lit(1)).alias("n_cells")
    )
    # a run starts where the cell one cadence earlier is unflagged or outside the window
    keys = [*SERIES, "reason_code"]
    points = runs.with_cadence(d.select(*keys, "timestamp_utc").distinct(), series)
    prev = scan.ordered_scan(
        scan.assign_blocks(points, keys, seq=None),
        keys,
        ["timestamp_utc"],
        lags={"_p": secs("timestamp_utc")},
    )
    before = secs("timestamp_utc") - F.col("cadence_s")
    starts = F.col("_p").isNull() | (F.col("_p") != before) | (before <= F.col("at_s") - WINDOW_S)
    eps = in_windows(prev, c).groupBy(*KEY).agg(F.count_if(starts).alias("n_episodes"))
    out = covered.join(load, KEY, "left").join(eps, KEY, "left").fillna(
        {"weighted": 0.0, "n_cells": 0, "n_episodes": 0}
    )
    x = F.when(F.col("covered") > 0, F.col("weighted") / F.col("covered")).otherwise(0.0)
    spoiled = F.when(
        F.col("covered") > 0, F.round(100.0 * F.least(F.col("n_cells") / F.col("covered"), F.lit(1.0)), 1)
    ).otherwise(0.0)
    return out.select(
        *KEY, F.exp(-x / C.HEALTH_DECAY).alias("health"), "n_episodes", spoiled.alias("spoiled_pct")
    )


def neighbour_fraction(series: DataFrame) -> DataFrame:
    """Share of a station's parameters that some other station also carries."""
    n = series.groupBy("parameter").agg(F.count(F.lit(1)).alias("_n"))
    return series.join(n, "parameter").groupBy("station_id").agg(
        F.avg((F.col("_n") > 1).cast("double")).alias("neighbour_fraction")
    )


def imputation(cov: Coverage, c: Clock, covered: DataFrame) -> DataFrame:
    """1 - absent share of the window, relieved where neighbours carry the same parameters."""
    r = cov.gap_ranges
    tick = lambda k: F.col("start_s") + F.col(k) * F.col("cadence_s")
    x = _expand(r, c, tick("k_lo"), tick("k_hi"))
    cad = F.col("cadence_s")
    lo = F.greatest(F.col("k_lo"), F.floor((F.col("at_s") - WINDOW_S - F.col("start_s")) / cad) + 1)
    hi = F.least(F.col("k_hi"), F.floor((F.col("at_s") - F.col("start_s")) / cad))
    gone = x.groupBy(*KEY).agg(F.sum(F.greatest(F.lit(0), hi - lo + 1)).cast("bigint").alias("absent"))
    out = (
        covered.join(gone, KEY, "left")
        .fillna({"absent": 0})
        .join(neighbour_fraction(cov.series), "station_id", "left")
        .fillna({"neighbour_fraction": 0.0})
    )
    raw = F.col("absent") / F.col("expected")
    u = F.when(F.col("expected") == 0, 0.0).otherwise(
        raw * (1.0 - C.NEIGHBOUR_RELIEF * F.col("neighbour_fraction"))
    )
    u = F.least(F.greatest(u, F.lit(0.0)), F.lit(1.0))
    return out.select(*KEY, (1.0 - u).alias("certainty"), F.round(100.0 * u, 1).alias("absent_pct"), "absent", "expected")


def peers(series: DataFrame, k: int = C.PEERS_K) -> DataFrame:
    """The first k other carriers of each series, by station id."""
    heads = (
        series.select("parameter", F.col("station_id").alias("peer_id"))
        .withColumn("_r", F.row_number().over(W.partitionBy("parameter").orderBy("peer_id")))
        .where(F.col("_r") <= k + 1)
    )
    own = W.partitionBy(*SERIES).orderBy("_r")
    return (
        series.select(*SERIES)
        .join(heads, "parameter")
        .where(F.col("station_id") != F.col("peer_id"))
        .withColumn("_o", F.row_number().over(own))
        .where(F.col("_o") <= k)
        .drop("_r", "_o")
    )


def first_values(readings: DataFrame) -> DataFrame:
    return readings.groupBy(*CELL).agg(F.min_by("value", "ingest_seq").alias("value"))


def _average_rank(v: str, group: list[str]) -> Column:
    ties = F.count(F.lit(1)).over(W.partitionBy(*group, v))
    return F.rank().over(W.partitionBy(*group).orderBy(v)) + (ties - 1) / 2.0


def _rho(n: Column, s1: Column, s2: Column, q1: Column, q2: Column, p: Column) -> Column:
    """Correlation from sums of ranks, their squares and products; null where one side does not vary."""
    return (n * p - s1 * s2) / F.nullif(F.sqrt((n * q1 - s1 * s1) * (n * q2 - s2 * s2)), F.lit(0.0))


def _usable() -> Column:
    return (F.min("value") < F.max("value")) & (F.min("peer_value") < F.max("peer_value"))


def _small_groups(w: DataFrame, group: list[str]) -> DataFrame:
    """Spearman correlation of groups that one window can hold each."""
    ranked = w.withColumns({"r1": _average_rank("value", group), "r2": _average_rank("peer_value", group)})
    # sums of ranks are exact, and zero spread gives null instead of a division by zero
    of = lambda c: F.sum(c)
    r1, r2 = F.col("r1"), F.col("r2")
    n = F.count(F.lit(1))
    rho = _rho(n, of(r1), of(r2), of(r1 * r1), of(r2 * r2), of(r1 * r2))
    return ranked.groupBy(*group).agg(F.when((n >= C.PEERS_MIN_POINTS) & _usable(), rho).alias("rho"))


def _value_ranks(cells: DataFrame, group: list[str], v: str, name: str, target: int | None) -> DataFrame:
    """Average rank of every distinct value of a group: the values are counted first, and many of them are ordered in blocks."""
    d = cells.groupBy(*group, v).agg(F.sum("m").alias("_m"))
    upto = scan.ordered_scan(scan.assign_value_blocks(d, group, v, target), group, [v], sums={"_cum": F.col("_m")})
    return scan.drop_blocks(upto).select(*group, v, (F.col("_cum") - (F.col("_m") - 1) / 2.0).alias(name))


def _large_groups(w: DataFrame, group: list[str], target: int | None) -> DataFrame:
    """The same from counts of distinct pairs of values, so that no task holds a group."""
    cells = cut(w.groupBy(*group, "value", "peer_value").agg(F.count(F.lit(1)).alias("m")))
    j = cells.join(_value_ranks(cells, group, "value", "r1", target), [*group, "value"])
    j = j.join(_value_ranks(cells, group, "peer_value", "r2", target), [*group, "peer_value"])
    of = lambda c: F.sum(F.col("m") * c)
    r1, r2 = F.col("r1"), F.col("r2")
    n = F.sum("m")
    rho = _rho(n, of(r1), of(r2), of(r1 * r1), of(r2 * r2), of(r1 * r2))
    return j.groupBy(*group).agg(F.when((n >= C.PEERS_MIN_POINTS) & _usable(), rho).alias("rho"))


def rank_agreement(readings: DataFrame, series: DataFrame, c: Clock, at_most: int | None = None, target: int | None = None) -> DataFrame:
    """Spearman correlation of each series with each of its peers per instant.

    Groups of more than `target` pairs (scan.BLOCK_ROWS) go by counts of values. `at_most`, a known bound on the rows of a
    series, tells without a count that there are none.
    """
    target = target or scan.BLOCK_ROWS
    first = first_values(readings).where(F.col("value").isNotNull())
    other = first.select(
        F.col("station_id").alias("peer_id"), "parameter", "timestamp_utc", F.col("value").alias("peer_value")
    )
    pairs = first.join(peers(series), SERIES).join(other, ["peer_id", "parameter", "timestamp_utc"])
    group = [*SERIES, "peer_id", "k"]
    w = in_windows(pairs, c).select(*group, "value", "peer_value")
    if at_most is not None and at_most <= target:
        return _small_groups(w, group).where(F.col("rho").isNotNull())
    # the pairs of an instant are counted before they are repeated for the windows that hold it
    ticks = pairs.groupBy(*SERIES, "peer_id", "timestamp_utc").count()
    hot = cut(in_windows(ticks, c).groupBy(*group).agg(F.sum("count").alias("n")).where(F.col("n") > target).select(*group))
    if hot.isEmpty():
        return _small_groups(w, group).where(F.col("rho").isNotNull())
    hot = sized_broadcast(hot)
    rest = _small_groups(w.join(hot, group, "left_anti"), group)
    return rest.unionByName(_large_groups(w.join(hot, group, "left_semi"), group, target)).where(F.col("rho").isNotNull())


def cross_sensor(readings: DataFrame, series: DataFrame, c: Clock, at_most: int | None = None) -> DataFrame:
    """Agreement with peers averaged over a station's parameters."""
    own = in_windows(
        readings.groupBy(*CELL).agg(
            F.min_by("value", "ingest_seq").alias("value"),
        ),
        c,
    ).groupBy(*SERIES, "k").agg(
        (F.coalesce(F.min("value") == F.max("value"), F.lit(True))).alias("frozen")
    )
    n_peers = peers(series).groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n_peers"))
    rho = rank_agreement(readings, series, c, at_most).groupBy(*SERIES, "k").agg(
        F.avg("rho").alias("rho"), F.count(F.lit(1)).alias("n_valid")
    )
    x = (
        own.join(n_peers, SERIES, "left")
        .fillna({"n_peers": 0})
        .join(rho, [*SERIES, "k"], "left")
    )
    few = F.col("n_peers") < C.PEERS_MIN
    score = (
        F.when(few, None).when(F.col("frozen"), 0.0).otherwise((F.col("rho") + 1.0) / 2.0)
    )
    against = (
        F.when(few, 0)
        .when(F.col("frozen"), F.col("n_peers"))
        .when(F.round("rho", 9) < C.DISAGREE_RHO, F.col("n_valid"))
        .otherwise(0)
    )
    lacking = few | (~F.col("frozen") & F.col("rho").isNull())
    return x.groupBy(*KEY).agg(
        F.avg(score).alias("_score"),
        F.count(score).alias("n_scored"),
        F.sum(against).cast("bigint").alias("n_disagree"),
        F.max(lacking).alias("insufficient"),
    ).select(
        *KEY,
        F.coalesce("_score", F.lit(0.5)).alias("consistency"),
        "n_scored",
        "n_disagree",
        ((F.col("n_scored") == 0) | F.col("insufficient")).alias("few_peers"),
    )


def plausibility(readings: DataFrame, defects: DataFrame, c: Clock, bounds=None) -> DataFrame:
    """Worst margin to the physical bounds in the window; an impossible reading vetoes it."""
    bounds = C.BOUNDS if bounds is None else bounds
    usable = {p: b for p, b in bounds.items() if None not in b and b[1] > b[0]}
    lo = lookup({p: b[0] for p, b in usable.items()}, F.col("parameter"))
    hi = lookup({p: b[1] for p, b in usable.items()}, F.col("parameter"))
    v = F.col("value")
    margin = C.SAFETY_MARGIN * (hi - lo)
    p = (
        F.when((v < lo) | (v > hi), 0.0)
        .when(hi - v < margin, (hi - v) / margin)
        .otherwise(1.0)
    )
    per_tick = (
        readings.where(v.isNotNull() & F.col("parameter").isin(list(usable)))
        .groupBy("station_id", "timestamp_utc")
        .agg(F.min(p).alias("p"), F.count(F.lit(1)).alias("n"))
    )
    worst = in_windows(per_tick, c).groupBy(*KEY).agg(
        F.min("p").alias("worst"), F.sum("n").alias("n_readings")
    )
    hard = defects.where(F.col("reason_code").isin("R07", "R08", "R09"))
    veto = in_windows(hard.select("station_id", "timestamp_utc").distinct(), c).select(*KEY).distinct()
    out = worst.join(veto.withColumn("veto", F.lit(True)), KEY, "full").withColumn("_any", defects.exists())
    vetoed = F.coalesce("veto", F.lit(False))
    value = F.when(vetoed, 0.0).otherwise(F.coalesce("worst", F.lit(1.0)))
    return out.select(
        *KEY,
        value.alias("plausibility"),
        F.coalesce("n_readings", F.lit(0)).alias("n_readings"),
        (vetoed | (~F.col("_any") & (value < 0.5))).alias("implausible"),
    )


def severity_above(defects: DataFrame, c: Clock) -> DataFrame:
    """1 + the worst severity weight of any flag in the window."""
    per_tick = defects.groupBy("station_id", "timestamp_utc").agg(F.max(weight("severity")).alias("w"))
    return in_windows(per_tick, c).groupBy(*KEY).agg((1.0 + F.max("w")).alias("severity"))


def components(cov: Coverage, defects: DataFrame) -> DataFrame:
    """All four components and the severity factor per station and instant."""
    c = clock(cov.series)
    covered = covered_cells(cov.series, c)
    out = (
        covered.select(*KEY)
        .join(health(defects, cov.series, c, covered), KEY)
        .join(imputation(cov, c, covered), KEY)
        .join(cross_sensor(cov.readings, cov.series, c, cov.n_rows), KEY, "left")
        .join(plausibility(cov.readings, defects, c), KEY, "left")
        .join(severity_above(defects, c), KEY, "left")
    )
    # a station without a reading in the window has nothing to compare
    return out.withColumn("compared", F.col("n_scored").isNotNull()).fillna(
        {
            "consistency": 0.5,
            "n_scored": 0,
            "n_disagree": 0,
            "few_peers": True,
            "plausibility": 1.0,
            "n_readings": 0,
            "implausible": False,
            "severity": 1.0,
        }
    ).withColumn("_end", c.end_s).withColumn(
        "timestamp_utc", at_secs(F.col("_end") - F.col("k") * STEP_S)
    ).drop("_end")


def score(parts: DataFrame, exposure: DataFrame | None = None) -> DataFrame:
    """Weighted trust, its reasons, and risk = trust x severity x exposure."""
    names = {
        "HealthConf": "health",
        "ImputationCertainty": "certainty",
        "CrossSensorConsistency": "consistency",
        "PhysicalPlausibility": "plausibility",
    }
    share = {n: F.round(F.col(c) * C.TRUST_WEIGHTS[n], 6) for n, c in names.items()}
    total = sum(share.values(), F.lit(0.0))
    codes = F.array(
        F.when(F.col("n_episodes") > 0, "T01"),
        F.when(F.col("certainty") < 1.0, "T02"),
        F.when((F.col("n_scored") > 0) & (F.col("n_disagree") > 0), "T03"),
        F.when(F.col("few_peers"), "T05"),
        F.when(F.col("implausible"), "T04"),
    )
    raised = F.array_distinct(F.array_compact(codes))
    text = lambda c: (F.col(c) if isinstance(c, str) else c).cast("string")
    evidence = {
        "HealthConf": {"n_defects": "n_episodes"},
        "ImputationCertainty": {"pct": "absent_pct"},
        "CrossSensorConsistency": {"n": "n_disagree", "min_peers": F.lit(C.PEERS_MIN)},
        "PhysicalPlausibility": {"n_readings": "n_readings"},
    }
    # What each component says of itself.
    detail = {
        "HealthConf": F.concat(text("n_episodes"), F.lit(" active fault(s) spoiling "), text("spoiled_pct"), F.lit("% of readings")),
        "ImputationCertainty": F.concat(F.lit("imputation uncertainty "), text("absent_pct"), F.lit("% (placeholder, no model)")),
        "CrossSensorConsistency": F.when(F.col("compared"), F.concat(text("n_scored"), F.lit(" parameter(s) compared to peers"))).otherwise("no data"),
        "PhysicalPlausibility": F.concat(F.lit("worst-case margin over "), text("n_readings"), F.lit(" readings")),
    }
    parts_col = F.array(
        *[
            F.struct(
                F.lit(n).alias("name"),
                F.col(c).alias("value"),
                F.lit(C.TRUST_WEIGHTS[n]).alias("weight"),
                share[n].alias("contribution"),
                F.lit(n == "ImputationCertainty").alias("is_placeholder"),
                detail[n].alias("detail"),
                F.create_map(*[x for k, v in evidence[n].items() for x in (F.lit(k), text(v))]).alias(
                    "evidence"
                ),
            )
            for n, c in names.items()
        ]
    )
    d = parts
    if exposure is not None:
        d = d.join(
            exposure.where("measured").select("station_id", F.col("exposure").alias("_x")),
            "station_id",
            "left",
        )
    else:
        d = d.withColumn("_x", F.lit(None).cast("double"))
    d = d.withColumn("trust", F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)))
    x = F.coalesce("_x", F.lit(C.EXPOSURE_STUB))
    return d.select(
        "station_id",
        "timestamp_utc",
        "trust",
        parts_col.alias("components"),
        F.when(F.size(raised) > 0, raised).otherwise(F.array(F.lit("T00"))).alias("reason_codes"),
        F.struct(
            F.round(F.col("trust") * F.col("severity") * x, 6).alias("value"),
            F.col("severity").alias("severity_vs_threshold"),
            x.alias("population_exposure"),
            F.col("_x").isNull().alias("population_exposure_stubbed"),
        ).alias("risk"),
    )


def merged_evidence(scores: DataFrame) -> Column:
    """Evidence of all components in one map; their keys never overlap."""
    return F.aggregate(
        F.col("components"),
        F.create_map().cast("map<string,string>"),
        lambda acc, x: F.map_concat(acc, x["evidence"]),
    )


def reason_sentences(scores: DataFrame) -> DataFrame:
    """Every reason of every score as the sentence that its evidence fills in."""
    one = scores.withColumn("evidence", merged_evidence(scores)).select("station_id", "timestamp_utc", "evidence", F.explode("reason_codes").alias("reason_code"))
    said = registry.render(lookup(registry.SENTENCE, F.col("reason_code")), F.col("evidence"), F.lit(None).cast("string"))
    return one.select("station_id", "timestamp_utc", "reason_code", said.alias("sentence"))


def score_violations(scores: DataFrame) -> DataFrame:
    """Scores without components or reasons, or outside [0, 1]; must be empty."""
    return scores.where(
        (F.size("components") != len(C.TRUST_WEIGHTS))
        | (F.size("reason_codes") < 1)
        | ~F.col("trust").between(0.0, 1.0)
    )
