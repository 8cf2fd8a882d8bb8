"""Boosted trees for many models at once and their exact Shapley values."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from stationproof.operators import boosting as B
from stationproof.operators import shapley

COLUMNS = ["a", "b.c", "d"]
DDL = "model int, y double, a double, `b.c` double, d double, weight double, extra string"


def rows(n=1200, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)).round(2)
    y = np.sin(2 * x[:, 0]) + (x[:, 1] > 0.3) * x[:, 2] + rng.normal(size=n) * 0.1
    return [(i % 2, float(y[i]), float(x[i, 0]), float(x[i, 1]) if i % 10 else None, float(x[i, 2]) if i % 7 else math.nan, 1.0, "e") for i in range(n)]


@pytest.fixture(scope="module")
def table(spark):
    odd = [(0, None, 1.0, 1.0, 1.0, 1.0, "e"), (None, 1.0, 1.0, 1.0, 1.0, 1.0, "e"), (9, 1.0, 1.0, 1.0, 1.0, 1.0, "e")]
    return spark.createDataFrame(rows() + odd, DDL).repartition(3).cache()


@pytest.fixture(scope="module")
def forest(table):
    return B.fit(table, COLUMNS, 3, B.Params(rounds=12, rate=0.3, bins=32))


def plain_splits(x, y, edges, min_rows):
    """Best first split of squared loss by trying all."""
    best = None
    for f, e in enumerate(edges):
        for b in range(len(e) + 1):
            left = np.isnan(x[:, f]) | (x[:, f] <= (e[b - 1] if b else -np.inf))
            if min(left.sum(), (~left).sum()) < min_rows:
                continue
            r = y - y.mean()
            gain = r[left].sum() ** 2 / left.sum() + r[~left].sum() ** 2 / (~left).sum()
            if best is None or gain > best[0] + 1e-9:
                best = (gain, f, b)
    return best


def test_first_split_is_the_best_one(forest, table):
    for m in (0, 1):
        data = [r for r in rows() if r[0] == m]
        x = np.array([[np.nan if v is None else v for v in r[2:5]] for r in data])
        _, f, b = plain_splits(x, np.array([r[1] for r in data]), forest.edges, 30)
        one = B.fit(table, COLUMNS, 3, B.Params(rounds=1, depth=1, bins=32, column_share=1.0))
        assert (one.feature[0, m, 0], one.bin[0, m, 0]) == (f, b)


def test_fit_and_predictions(forest, table):
    scored = forest.predict(table, "y.hat")
    assert scored.columns == [*table.columns, "y.hat"]
    got = [r for r in scored.collect() if r["y"] is not None and r["model"] in (0, 1)]
    y, hat = np.array([r["y"] for r in got]), np.array([r["y.hat"] for r in got])
    assert 1 - ((y - hat) ** 2).sum() / ((y - y.mean()) ** 2).sum() > 0.75
    assert {r["y.hat"] for r in scored.where("model is null or model > 2").collect()} == {None}
    assert (forest.feature[:, 2] == -1).all()  # a model without rows
    leaves = (forest.cover > 0).sum(axis=2) - (forest.feature >= 0).sum(axis=2)
    assert leaves.max() <= 31 and forest.cover[forest.cover > 0].min() >= 30


def test_same_trees_however_the_rows_are_dealt(table, forest, monkeypatch):
    monkeypatch.setattr(B, "TASK_ROWS", 200)
    monkeypatch.setattr(B, "FLUSH", 5)
    again = B.fit(table.repartition(7), COLUMNS, 3, B.Params(rounds=12, rate=0.3, bins=32))
    assert (again.feature == forest.feature).all() and (again.bin == forest.bin).all() and (again.cover == forest.cover).all()
    assert np.allclose(again.value, forest.value, rtol=1e-6)


def test_logistic_loss_and_weights(spark):
    data = [(0, float(r[4] > 0), *r[2:5], 1.0 + (r[4] > 0) * 3, "e") for r in rows(600)]
    t = spark.createDataFrame(data, DDL)
    made = B.fit(t, COLUMNS, 1, B.Params(rounds=8, rate=0.3, loss="logistic")).predict(t, "p").collect()
    right = [(r["p"] > 0.5) == (r["y"] == 1) for r in made if not math.isnan(r["d"])]
    assert sum(right) / len(right) > 0.95 and all(0 < r["p"] < 1 for r in made)


def test_no_rows(spark, table):
    none = B.fit(table.where("false"), COLUMNS, 2, B.Params(rounds=2))
    assert {r["p"] for r in none.predict(table, "p").where("model < 2").collect()} == {0.0}
    assert none.table(spark).count() == 0


def test_stored_trees(spark, forest):
    assert forest.table(spark).where("feature is not null").count() == (forest.feature >= 0).sum()


def expectation(forest, m, r, node, x, known):
    f = forest.feature[r, m, node] if node < forest.feature.shape[2] else -1
    if f < 0:
        return forest.value[r, m, node]
    left, right = 2 * node + 1, 2 * node + 2
    if f in known:
        return expectation(forest, m, r, right if x[f] > forest.bin[r, m, node] else left, x, known)
    return sum(forest.cover[r, m, c] / forest.cover[r, m, node] * expectation(forest, m, r, c, x, known) for c in (left, right))


def test_shapley_values_against_all_subsets(forest):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 32, (15, 3)).astype(np.uint8)
    game = lambda row, known: sum(expectation(forest, 0, r, 0, row, known) for r in range(len(forest.feature)))
    own = shapley.Explainer(forest, 0)
    for row, values in zip(x, own.values(x)):
        for i in range(3):
            rest = [j for j in range(3) if j != i]
            wanted = 0.0
            for k in range(3):
                for s in combinations(rest, k):
                    wanted += math.factorial(k) * math.factorial(2 - k) / 6 * (game(row, {*s, i}) - game(row, set(s)))
            assert abs(values[i] - wanted) < 1e-9
        assert abs(own.base - forest.base[0] - game(row, set())) < 1e-9


def test_attributions_add_up(forest, table):
    made = shapley.attributions(forest.predict(table, "p"), forest)
    total = F.aggregate("attributions", F.lit(0.0), lambda a, x: a + x["value"])
    assert made.where("model in (0, 1)").agg(F.max(F.abs(F.col("p") - F.col("base") - total))).first()[0] < 1e-9
    assert made.where("model is null or model > 2").where("attributions is not null or base is not null").isEmpty()
    first = made.where("model = 0").first().attributions
    assert [a.feature for a in first] == COLUMNS and [a.position for a in first] == [0, 1, 2]
