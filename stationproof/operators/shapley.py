"""Exact Shapley values of boosted trees, conditional on the paths that training rows took.

A leaf adds its value to the game in which a feature that is known lets the row through or not, and one that is unknown lets
through the share of training rows that went the leaf's way. With d different features on its path (at most the depth of the trees)
a leaf has 2^d patterns of features that let the row through; the Shapley values of every pattern are worked out once. A row then
finds its pattern at every leaf and adds what stands there. The values of a row and the base, the mean prediction of the training rows, add up to
its margin.
"""

from __future__ import annotations

from itertools import combinations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stationproof.functions.arrow import add_columns
from stationproof.operators.boosting import Forest, model_numbers

DDL = "base double, attributions array<struct<position:int,feature:string,value:double>>"


def leaf_paths(feature: np.ndarray, cover: np.ndarray) -> list[tuple[int, dict[int, tuple[list, float]]]]:
    """Of one tree: every leaf with, by feature on its path, the conditions (node, goes right) and the share let through."""
    out, stack = [], [(0, {})]
    while stack:
        node, path = stack.pop()
        f = int(feature[node]) if node < len(feature) else -1
        if f < 0:
            out.append((node, path))
            continue
        for right in (0, 1):
            child = 2 * node + 1 + right
            tests, share = path.get(f, ([], 1.0))
            stack.append((child, path | {f: ([*tests, (node, right)], share * cover[child] / cover[node])}))
    return out


def pattern_values(shares: list[float]) -> np.ndarray:
    """Shapley values [pattern, feature] of a leaf of value one; bit i of a pattern says whether feature i lets the row through."""
    d = len(shares)
    passes = (np.arange(2**d)[:, None] >> np.arange(d)) & 1
    out = np.zeros((2**d, d))
    for i in range(d):
        rest = [j for j in range(d) if j != i]
        total = np.zeros(2**d)
        for k in range(d):
            weight = factorial(k) * factorial(d - k - 1) / factorial(d)
            for known in combinations(rest, k):
                unknown = np.prod([shares[j] for j in rest if j not in known])
                total += weight * unknown * passes[:, list(known)].prod(axis=1)
        out[:, i] = total * (passes[:, i] - shares[i])
    return out


class Explainer:
    """The pattern tables of all trees of one model."""

    def __init__(self, forest: Forest, model: int):
        self.width, self.base, self.trees = len(forest.columns), float(forest.base[model]), []
        for feature, at, value, cover in zip(forest.feature[:, model], forest.bin[:, model], forest.value[:, model], forest.cover[:, model]):
            if feature[0] < 0:
                continue
            leaves = []
            for node, path in leaf_paths(feature, cover):
                leaves.append((list(path), [tests for tests, _ in path.values()], value[node] * pattern_values([s for _, s in path.values()])))
                self.base += value[node] * cover[node] / cover[0]
            used = np.flatnonzero(feature >= 0)
            self.trees.append((used, feature[used], at[used], leaves))

    def values(self, x: np.ndarray) -> np.ndarray:
        """Attributions [row, feature] of rows of bins."""
        out = np.zeros((len(x), self.width))
        for used, feature, at, leaves in self.trees:
            right = dict(zip(used.tolist(), (x[:, feature] > at).T))
            for columns, tests, table in leaves:
                pattern = np.zeros(len(x), np.int64)
                for i, conditions in enumerate(tests):
                    through = np.logical_and.reduce([right[n] == bool(way) for n, way in conditions])
                    pattern |= through.astype(np.int64) << i
                out[:, columns] += table[pattern]
        return out


def attributions(df: DataFrame, forest: Forest, model_col: str = "model") -> DataFrame:
    """Add `base` and `attributions` (position, feature, value): what each feature adds to the margin of the row's model.

    Both are null for an unknown model. A missing value counts as the forest treats it.
    """
    shared = df.sparkSession.sparkContext.broadcast(forest)

    def make():
        own, made = shared.value, {}

        def run(arrays: list) -> list:
            model, known = model_numbers(arrays[0], len(own.base))
            x = own.binned(arrays[1:])
            values, base = np.zeros(x.shape), np.zeros(len(x))
            for m in np.unique(model[known]).tolist():
                if m not in made:
                    made[m] = Explainer(own, m)
                rows = np.flatnonzero(known & (model == m))
                values[rows], base[rows] = made[m].values(x[rows]), made[m].base
            n, width = x.shape
            parts = [pa.array(np.tile(np.arange(width, dtype=np.int32), n)), pa.array(own.columns * n, pa.string()), pa.array(values.ravel())]
            structs = pa.StructArray.from_arrays(parts, ["position", "feature", "value"])
            ends = pa.array(np.append(np.where(known, np.arange(n) * width, None), n * width), pa.int32())
            return [pa.array(base, pa.float64(), mask=~known), pa.ListArray.from_arrays(ends, structs)]

        return run

    return add_columns(df, [model_col, *forest.columns], make, DDL)
