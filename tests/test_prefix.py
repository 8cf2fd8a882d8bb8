"""Medians of everything earlier, by a tree of days, against joins with the history."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from stationproof.functions import prefix
from stationproof.operators import adjudicate


@pytest.fixture(scope="module")
def tables(spark):
    rnd = random.Random(4)
    values = [("s", "p", rnd.randrange(0, 200 * 86400), rnd.choice([rnd.gauss(0, 5), 1.5, float(rnd.randrange(9)), -1e300])) for _ in range(1500)]
    values += [("t", "p", 86400 * 3 + 5, 2.0), ("t", "p", 86400 * 900, 4.0)]
    times = [0, 86400, 86400 * 64, 86400 * 127 + 1, 86400 * 500, *(rnd.randrange(0, 210 * 86400) for _ in range(60))]
    asked = [(i, "s", "p", t) for i, t in enumerate(times)] + [(900, "t", "p", 86400 * 3 + 5), (901, "t", "p", 86400 * 3 + 6), (902, "t", "p", 86400 * 901), (903, "none", "p", 5)]
    return values, asked, spark.createDataFrame(values, "station_id string, parameter string, _s long, _val double"), spark.createDataFrame(asked, "id long, station_id string, parameter string, _t long")


def test_tree_equals_history(tables, monkeypatch):
    values, asked, v, q = tables
    monkeypatch.setattr(prefix, "PARTS", 64)
    wanted = {}
    for i, s, p, t in asked:
        before = [x for a, b, u, x in values if (a, b) == (s, p) and u < t]
        if before:
            wanted[i] = statistics.median(before)
    for most_rows in (10**9, 0):
        got = {r.id: r.m for r in adjudicate.earlier_baselines(q, ["id"], v, most_rows).select("id", F.col("baseline").alias("m")).collect()}
        assert got == pytest.approx(wanted)


def test_no_requests(tables):
    _, _, v, q = tables
    assert prefix.earlier_medians(q.where("false"), ["id"], v, ["station_id", "parameter"], "m").isEmpty()
