"""Labels of the subtle fault classes without planted faults: a label model over what features and flags say.

Several rules of thumb vote on every cell for one class or abstain. They overlap and err, and how well each does is not known.
Expectation-maximisation treats the class of a cell as hidden and estimates, for every rule, how often it gives each answer on each class.
Cells with the same votes are one pattern, so the model is fitted on the counts of patterns, of which there are at most answers to the power of
rules, whatever the number of cells. Every cell gets the posterior of its pattern. All series take part.

Cells whose class a deterministic rule forces are left to that rule. A missing feature makes a vote abstain.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationproof import config as C
from stationproof.functions.columns import CELL, literal_table, sized_broadcast
from stationproof.operators import cv, fault

CLASSES = fault.SUBTLE
#: Passes of the estimation, and what a table of answers starts from: cells added to each answer.
PASSES, SMOOTH = 60, 1.0
ABSTAIN, NONE, DRIFT, ARTEFACT = 0, 1, 2, 3


def _vote(*cases: tuple[Column, int]) -> Column:
    out = F.lit(ABSTAIN)
    for condition, answer in reversed(cases):
        out = F.when(F.coalesce(condition, F.lit(False)), answer).otherwise(out)
    return out.cast("int")


def votes(features: DataFrame, defects: DataFrame) -> DataFrame:
    """CELL, features and `votes`, one answer a rule, for every cell that no deterministic rule claims."""
    stepped = defects.where("reason_code = 'R14'").select(*CELL, F.lit(True).alias("_step")).distinct()
    x = features.join(fault.rule_classes(defects).select(*CELL), CELL, "left_anti").join(stepped, CELL, "left")
    z, raw = F.col("resid_abs_z"), F.col("raw_z")
    # the residual's spread over its series, in which a day's mean and a trend are measured
    spread = F.abs(F.col("residual")) / F.nullif(z, F.lit(0.0))
    day, trend = F.abs(F.col("resid_roll_mean_24")) / F.nullif(spread, F.lit(0.0)), F.abs(F.col("resid_trend")) / F.nullif(spread, F.lit(0.0))
    rules = [
        _vote((F.coalesce("_step", F.lit(False)), DRIFT)),
        _vote((day > 1.0, DRIFT), (day < 0.4, NONE)),
        _vote((trend > 1.0, DRIFT), (trend < 0.3, NONE)),
        _vote(((raw > C.METEO_RAW_Z) & (z < C.METEO_RESID_ABS_Z), ARTEFACT), (raw < 1.0, NONE)),
        _vote(((raw > 1.0) & (F.col("explained_ratio") > 0.6), ARTEFACT)),
        _vote(((F.abs(raw) < 1.0) & (z < 1.0), NONE)),
    ]
    return x.withColumn("votes", F.array(*rules)).drop("_step")


def patterns(voted: DataFrame) -> DataFrame:
    """Cells of every pattern of votes."""
    return voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n"))


def estimate(seen: np.ndarray, counts: np.ndarray, answers: int = 4, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shares of the classes, answers[rule, class, answer] and posteriors[pattern, class] of patterns seen[pattern, rule].

    Starts from rules that are right four times in five where they answer; class k is answer k + 1.
    """
    n_rules, k = seen.shape[1], answers - 1
    table = np.zeros((n_rules, k, answers))
    for j in range(n_rules):
        silent = (counts[seen[:, j] == 0].sum() + 1) / (counts.sum() + 2)
        table[j] = (1 - silent) * 0.2 / max(k - 1, 1)
        table[j, :, 0] = silent
        table[j, range(k), range(1, k + 1)] = (1 - silent) * 0.8
    share = np.full(k, 1.0 / k)
    for _ in range(passes):
        log = np.log(share) + sum(np.log(table[j])[:, seen[:, j]].T for j in range(n_rules))
        post = np.exp(log - log.max(axis=1, keepdims=True))
        post /= post.sum(axis=1, keepdims=True)
        mass = post * counts[:, None]
        share = (mass.sum(axis=0) + SMOOTH) / (counts.sum() + k * SMOOTH)
        for j in range(n_rules):
            for a in range(answers):
                table[j, :, a] = mass[seen[:, j] == a].sum(axis=0) + SMOOTH
            table[j] /= table[j].sum(axis=1, keepdims=True)
    return share, table, post


def weak_labels(features: DataFrame, defects: DataFrame) -> DataFrame:
    """CELL, features, `label_class` (the likeliest class of the cell's votes) and `certainty`, its posterior."""
    voted = votes(features, defects)
    rows = sorted((tuple(r["votes"]), r["n"]) for r in patterns(voted).collect())
    if not rows:
        return voted.drop("votes").withColumns({"label_class": F.lit(None).cast("string"), "certainty": F.lit(None).cast("double")})
    _, _, post = estimate(np.array([p for p, _ in rows]), np.array([n for _, n in rows], float))
    best = post.argmax(axis=1)
    named = [("".join(map(str, p)), CLASSES[b], float(q[b])) for (p, _), b, q in zip(rows, best, post)]
    table = literal_table(voted.sparkSession, named, "_pattern string, label_class string, certainty double")
    keyed = voted.withColumn("_pattern", F.array_join(F.col("votes").cast("array<string>"), ""))
    return keyed.join(sized_broadcast(table), "_pattern").drop("_pattern", "votes")


def blocked(labelled: DataFrame, folds: int) -> DataFrame:
    """Add `block`, the time block of a cell from 1 to `folds`, for training and predicting across blocks."""
    return labelled.join(cv.time_blocks(labelled, folds), "timestamp_utc")
