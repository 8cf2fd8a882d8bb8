"""Gradient-boosted trees for many models at once, grown level by level over one binned table.

Every row names the model that it trains; a row that trains several (the folds of a cross-validation) stands once for each.
Features are bins, one byte each. A level of a round is one pass for all models together: tasks add gradients and counts by (model, open node,
feature, bin), partial sums of a node meet in one task, which chooses the node's best split, and only the chosen splits reach the
driver. So the passes are rounds times levels, whatever the number of models, and what a task or the driver holds is set by the
parameters, not by the rows.

Gradients are rounded to whole numbers of a fixed scale, so sums don't depend on the order in which tasks finish: two fits of the
same rows give the same trees, however the rows are dealt. Of equal gains the first feature and the lowest bin win.

The margin of a row is the sum of the trees so far. It is checkpointed every `FLUSH` rounds and completed from the trees since,
so a lost executor costs one pass. Models small enough for one task are grown by one task each, with the same trees.

A missing feature value (null or NaN) has a bin of its own below all others. A model without rows predicts 0, one without
a split its mean. Rows without target train nothing.
"""

from __future__ import annotations

import io
import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationproof.functions.arrow import add_columns, quoted
from stationproof.functions.state import cut

#: Rounds between two checkpoints of the margins.
FLUSH = 25
#: Rows of one task of a pass.
TASK_ROWS = 500_000
#: Gradients are multiples of their largest possible value over this.
STEPS = 1 << 24
TREES, TREE_TYPES = ("feature", "bin", "value", "cover"), (np.int16, np.int16, np.float64, np.int64)
SPLIT = "slot int, gain double, feature int, bin int, gl long, hl long, nl long, gr long, hr long, nr long"


class Params(NamedTuple):
    rounds: int = 300
    rate: float = 0.05
    depth: int = 5
    leaves: int = 31
    min_rows: int = 30
    column_share: float = 0.9
    bins: int = 64
    seed: int = 17
    loss: str = "squared"  # or "logistic", for targets 0 and 1


class Forest:
    """Trees of all models in heap order: children of node i are 2 i + 1 (bin at most `bin`) and 2 i + 2."""

    def __init__(self, columns: list[str], edges: list[np.ndarray], base: np.ndarray, loss: str, feature=None, bin=None, value=None, cover=None):
        self.columns, self.edges, self.base, self.loss = list(columns), edges, base, loss
        self.feature, self.bin, self.value, self.cover = feature, bin, value, cover

    def binned(self, arrays: list[pa.Array]) -> np.ndarray:
        return bin_matrix(arrays, self.edges)

    def nodes(self, model: np.ndarray, x: np.ndarray, r: int) -> np.ndarray:
        """Leaf of every row in round r."""
        return walk(self.feature[r], self.bin[r], model, x)

    def margins(self, model: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = self.base[model].copy()
        for r in range(len(self.feature)):
            out += self.value[r][model, self.nodes(model, x, r)]
        return out

    def predict(self, df: DataFrame, name: str, model_col: str = "model") -> DataFrame:
        """Add the prediction of each row's model, a probability for the logistic loss; null for an unknown model."""
        return self.predict_block(df, [name], model_col)

    def predict_block(self, df: DataFrame, names: list[str], first_col: str = "model") -> DataFrame:
        """Add the predictions of as many consecutive models as there are names, from each row's first one on."""
        shared = df.sparkSession.sparkContext.broadcast(self)

        def make():
            own = shared.value

            def run(arrays: list) -> list:
                first, known = model_numbers(arrays[0], len(own.base) - len(names) + 1)
                x = own.binned(arrays[1:])
                margins = [own.margins(first + i, x) for i in range(len(names))]
                return [pa.array(1 / (1 + np.exp(-m)) if own.loss == "logistic" else m, pa.float64(), mask=~known) for m in margins]

            return run

        return add_columns(df, [first_col, *self.columns], make, ", ".join(f"{quoted(n)} double" for n in names))

    def to_bytes(self) -> bytes:
        """The whole forest as one NumPy archive without pickled objects."""
        parts = {f"edge{i}": e for i, e in enumerate(self.edges)}
        parts |= {n: getattr(self, n) for n in (*TREES, "base")}
        out = io.BytesIO()
        np.savez_compressed(out, columns=np.array(self.columns, str), loss=np.array(self.loss), **parts)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Forest:
        a = np.load(io.BytesIO(raw), allow_pickle=False)
        columns = a["columns"].tolist()
        return cls(columns, [a[f"edge{i}"] for i in range(len(columns))], a["base"], str(a["loss"]), *(a[n] for n in TREES))

    def table(self, spark) -> DataFrame:
        """All nodes as rows: their split (left where missing or at most the threshold), value and rows; bounded by the parameters."""
        r, m, n = np.nonzero(self.cover)
        inner = n < self.feature.shape[2]
        f = np.where(inner, self.feature[r, m, np.minimum(n, self.feature.shape[2] - 1)], -1)
        at = self.bin[r, m, np.minimum(n, self.feature.shape[2] - 1)]
        threshold = [None if i < 0 else float(self.edges[i][b - 1]) if b else -math.inf for i, b in zip(f.tolist(), at.tolist())]
        names = [None if i < 0 else self.columns[i] for i in f.tolist()]
        cols = {"model": m, "round": r, "node": n, "feature": names, "threshold": threshold, "value": self.value[r, m, n], "n_rows": self.cover[r, m, n]}
        ddl = "model long, round long, node long, feature string, threshold double, value double, n_rows long"
        return spark.createDataFrame(pa.table(cols).to_pandas() if len(r) == 0 else pa.table(cols), ddl)


def model_numbers(array: pa.Array, n_models: int) -> tuple[np.ndarray, np.ndarray]:
    model = array.cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
    known = (model >= 0) & (model < n_models)
    return np.where(known, model, 0), known


def bin_matrix(arrays: list[pa.Array], edges: list[np.ndarray]) -> np.ndarray:
    """Bins of each row and feature: 0 for missing, else 1 + the number of edges under the value."""
    out = np.zeros((len(arrays[0]) if arrays else 0, len(edges)), np.uint8)
    for k, (a, e) in enumerate(zip(arrays, edges)):
        v = a.cast(pa.float64()).to_numpy(zero_copy_only=False)
        out[:, k] = np.where(np.isnan(v), 0, 1 + np.searchsorted(e, v, side="left"))
    return out


def find_edges(table: DataFrame, columns: list[str], bins: int) -> list[np.ndarray]:
    """Cut points of every feature at quantiles of its values, at most bins - 2, by a mergeable sketch."""
    fractions = [i / (bins - 1) for i in range(1, bins - 1)]
    value = lambda c: F.when(~F.isnan(F.col(quoted(c)).cast("double")), F.col(quoted(c)).cast("double"))
    row = table.agg(*[F.percentile_approx(value(c), fractions, 10_000) for c in columns]).first()
    return [np.unique(np.array(q or [], float)) for q in row]


def walk(feature: np.ndarray, at: np.ndarray, model: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Node of every row in the trees feature[model, node], at[model, node]."""
    node, rows, inner = np.zeros(len(model), np.int64), np.arange(len(model)), feature.shape[1]
    for _ in range((inner + 1).bit_length() - 1):
        here = np.minimum(node, inner - 1)
        f = np.where(node < inner, feature[model, here], -1)
        right = x[rows, np.maximum(f, 0)] > at[model, here]
        node = np.where(f >= 0, 2 * node + 1 + right, node)
    return node


def gradients(y: np.ndarray, margin: np.ndarray, weight: np.ndarray, loss: str) -> tuple[np.ndarray, np.ndarray]:
    if loss == "squared":
        return weight * (y - margin), weight
    p = 1 / (1 + np.exp(-margin))
    return weight * (y - p), weight * p * (1 - p)


def best_split(hist: np.ndarray, allowed: np.ndarray, min_rows: int) -> tuple | None:
    """Best (gain, feature, bin, left sums, right sums) of a node's sums hist[feature, bin, (gradient, curvature, rows)]."""
    left = np.cumsum(hist, axis=1)
    total = left[:1, -1:, :]
    right = total - left
    ok = (left[..., 2] >= min_rows) & (right[..., 2] >= min_rows) & (left[..., 1] > 0) & (right[..., 1] > 0) & allowed[:, None]
    if not ok.any():
        return None
    score = lambda s: s[..., 0].astype(float) ** 2 / np.maximum(s[..., 1], 1)
    gain = np.where(ok, score(left) + score(right) - score(total), -1.0)
    f, b = divmod(int(gain.argmax()), gain.shape[1])
    if gain[f, b] <= 0:
        return None
    return (float(gain[f, b]), f, b, *left[f, b].tolist(), *right[f, b].tolist())


class Pass:
    """One level of one round: what tasks need to sum by open node and to choose splits."""

    def __init__(self, p: Params, slots: np.ndarray, n_slots: int, scale: tuple[np.ndarray, np.ndarray], allowed: np.ndarray, recent: list, tree: tuple, slot_model: list[int]):
        self.p, self.slots, self.n_slots, self.scale, self.allowed = p, slots, n_slots, scale, allowed
        self.recent, self.tree, self.slot_model = recent, tree, slot_model

    def sums(self, batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        width, bins = self.allowed.shape[1], self.p.bins
        out = np.zeros((self.n_slots, width, bins, 3), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            model, y, w, margin, x = unpack(b, width)
            for feature, at, value in self.recent:
                margin = margin + value[model, walk(feature, at, model, x)]
            slot = self.slots[model, walk(*self.tree, model, x)]
            open_ = slot >= 0
            parts = [np.rint(v * unit[model])[open_] for v, unit in zip(gradients(y, margin, w, self.p.loss), self.scale)] + [None]
            slot, x = slot[open_], x[open_]
            for f in range(width):
                cell = slot * bins + x[:, f]
                for k, v in enumerate(parts):
                    out[:, f, :, k] += np.bincount(cell, v, self.n_slots * bins).astype(np.int64).reshape(self.n_slots, bins)
        return out

    def choose(self, slot: int, hist: np.ndarray) -> tuple | None:
        best = best_split(hist, self.allowed[self.slot_model[slot]], self.p.min_rows)
        return None if best is None else (slot, *best)


def unpack(b: pa.RecordBatch, width: int):
    model, y, w, margin, x = (b.column(i) for i in range(5))
    bins = np.frombuffer(b"".join(x.to_pylist()), np.uint8).reshape(-1, width)
    return (*(c.to_numpy(zero_copy_only=False) for c in (model, y, w, margin)), bins)


def split_batch(rows: list) -> pa.RecordBatch:
    names = [c.split()[0] for c in SPLIT.split(", ")]
    types = [pa.int32(), pa.float64(), pa.int32(), pa.int32()] + [pa.int64()] * 6
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def run_pass(design: DataFrame, step: Pass) -> list:
    """The chosen split of every open node that has one."""

    def partial(batches):
        hist = step.sums(batches)
        used = np.flatnonzero(hist[:, 0, :, 2].any(axis=1)).tolist()
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([hist[s].tobytes() for s in used], pa.binary())], names=["slot", "hist"])

    def meet(batches):
        shape = (step.allowed.shape[1], step.p.bins, 3)
        hist: dict[int, np.ndarray] = {}
        for b in batches:
            for s, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                part = np.frombuffer(raw, np.int64).reshape(shape)
                hist[s] = hist[s] + part if s in hist else part
        yield split_batch([c for s in sorted(hist) if (c := step.choose(s, hist[s])) is not None])

    return design.mapInArrow(partial, "slot int, hist binary").repartition("slot").mapInArrow(meet, SPLIT).collect()


def prepare(rows: DataFrame, columns: list[str], edges: list[np.ndarray], base: np.ndarray) -> DataFrame:
    """model, y, weight, margin and the bins of all features as one binary value."""

    def make():
        def run(arrays: list) -> list:
            return [pa.array([r.tobytes() for r in bin_matrix(arrays, edges)], pa.binary())]

        return run

    margin = F.element_at(F.array(*[F.lit(float(b)) for b in base]), F.col("model") + 1)
    return add_columns(rows, columns, make, "x binary").select("model", "y", "weight", margin.alias("margin"), "x")


class Start(NamedTuple):
    """What is known of the models before the first round: their means as margins and the scales of their sums."""

    base: np.ndarray
    scale: tuple[np.ndarray, np.ndarray]


def measure(rows: DataFrame, n_models: int, loss: str) -> tuple[Start, dict[int, int]]:
    """Start of all models and the rows of each."""
    y, w = F.col("y"), F.col("weight")
    base, reach, heavy, sizes = np.zeros(n_models), np.ones(n_models), np.ones(n_models), {}
    sums = rows.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.min(y).alias("lo"), F.max(y).alias("hi"), F.max(w).alias("w"), (F.sum(y * w) / F.sum(w)).alias("m"))
    for r in sums.collect():
        m, mean = r["model"], float(f"{r['m']:.9g}")  # a sum's last digits depend on the order in which tasks end
        sizes[m], heavy[m] = r["n"], r["w"]
        if loss == "squared":
            base[m], reach[m] = mean, max(r["hi"] - mean, mean - r["lo"]) * r["w"]
        else:
            share = min(max(mean, 1e-6), 1 - 1e-6)
            base[m], reach[m] = math.log(share / (1 - share)), r["w"]
    return Start(base, (STEPS / np.maximum(reach, 1e-12), STEPS / heavy)), sizes


def grow(p: Params, models: list[int], scale: tuple[np.ndarray, np.ndarray], width: int, find_splits: Callable[[Pass], list], settle: Callable[[list], None], every: int) -> list[np.ndarray]:
    """All rounds of `models`: feature, bin, value and rows as arrays [round, model, node].

    `find_splits` gives the best split of each open node over the rows; `settle` adds the trees of the last `every` rounds to
    the margins. Models are numbered by their place in `models`.
    """
    n_models, inner, size = len(models), 2**p.depth - 1, 2 ** (p.depth + 1) - 1
    trees, recent = [], []
    for r in range(p.rounds):
        allowed = np.array([chosen_columns(width, p.column_share, (p.seed, r, m)) for m in models])
        feature, at = np.full((n_models, inner), -1, np.int16), np.zeros((n_models, inner), np.int16)
        value, cover = np.zeros((n_models, size)), np.zeros((n_models, size), np.int64)
        leaves, level = np.ones(n_models, int), [(m, 0) for m in range(n_models)]
        for _ in range(p.depth):
            slots = np.full((n_models, size), -1, np.int64)
            for s, (m, i) in enumerate(level):
                slots[m, i] = s
            step = Pass(p, slots, len(level), scale, allowed, recent, (feature, at), [m for m, _ in level])
            after = []
            for slot, _, f, b, gl, hl, nl, gr, hr, nr in sorted(find_splits(step), key=lambda c: (-c[1], c[0])):
                m, i = level[slot]
                if leaves[m] == p.leaves:
                    continue
                leaves[m] += 1
                feature[m, i], at[m, i], value[m, i], cover[m, i] = f, b, 0.0, nl + nr
                for child, g, h, n in ((2 * i + 1, gl, hl, nl), (2 * i + 2, gr, hr, nr)):
                    value[m, child], cover[m, child] = p.rate * (g / scale[0][m]) / (h / scale[1][m]), n
                    after.append((m, child))
            level = sorted(after)
            if not level:
                break
        trees.append((feature, at, value, cover))
        recent = [*recent, (feature, at, value)]
        if len(recent) == every and r + 1 < p.rounds:
            settle(recent)
            recent = []
    empty = [np.zeros((0, n_models, k), t) for k, t in ((inner, np.int16), (inner, np.int16), (size, float), (size, np.int64))]
    return [np.stack(a) for a in zip(*trees)] if trees else empty


def with_trees(b: pa.RecordBatch, recent: list, width: int) -> pa.RecordBatch:
    """The rows with `recent` trees added to their margins."""
    model, _, _, margin, x = unpack(b, width)
    for feature, at, value in recent:
        margin = margin + value[model, walk(feature, at, model, x)]
    return pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array(margin), b.column(4)], names=b.schema.names)


def grow_apart(design: DataFrame, p: Params, start: Start, width: int, n_models: int) -> dict[int, list[np.ndarray]]:
    """Trees of models of which each fits a task: one task grows a model through all rounds.

    The number of partitions is stated, or small tables would be put together and their models grown one after the other.
    """

    def one(rows: pa.Table) -> pa.Table:
        m = rows.column("model")[0].as_py()
        batch = rows.set_column(0, "model", pa.array(np.zeros(len(rows), np.int32))).combine_chunks().to_batches()[0]
        held = [batch]

        def settle(recent: list) -> None:
            held[0] = with_trees(held[0], recent, width)

        def find_splits(step: Pass) -> list:
            hist = step.sums(iter(held))
            return [c for s in range(step.n_slots) if (c := step.choose(s, hist[s])) is not None]

        made = grow(p, [m], tuple(s[[m]] for s in start.scale), width, find_splits, settle, 1)
        return pa.table({"model": pa.array([m], pa.int32()), **{n: pa.array([a.tobytes()], pa.binary()) for n, a in zip(TREES, made)}})

    ddl = "model int, " + ", ".join(f"{n} binary" for n in TREES)
    out = {}
    for r in design.repartition(2 * n_models, "model").groupBy("model").applyInArrow(one, ddl).collect():
        arrays = [np.frombuffer(r[n], t) for n, t in zip(TREES, TREE_TYPES)]
        out[r["model"]] = [a.reshape(p.rounds, 1, -1) for a in arrays]
    return out


def grow_together(design: DataFrame, p: Params, start: Start, width: int, models: list[int], tasks: int) -> list[np.ndarray]:
    """Trees of models of any size: one pass over all their rows a level."""
    place = {m: i for i, m in enumerate(models)}
    numbered = F.element_at(F.create_map(*[F.lit(x).cast("int") for kv in place.items() for x in kv]), F.col("model"))
    held = [cut(design.withColumn("model", numbered).repartition(tasks))]

    def settle(recent: list) -> None:
        def run(batches):
            yield from (with_trees(b, recent, width) for b in batches if b.num_rows)

        held[0] = cut(held[0].mapInArrow(run, held[0].schema))

    return grow(p, models, tuple(s[models] for s in start.scale), width, lambda step: run_pass(held[0], step), settle, FLUSH)


def fit(table: DataFrame, columns: list[str], n_models: int, p: Params = Params()) -> Forest:
    """Fit all models. `table` holds model (0 to n_models - 1), y, the feature columns and, if it likes, weight.

    A model of at most `TASK_ROWS` rows is grown by one task through all rounds, larger ones together, level by level; the
    trees are the same either way.
    """
    if p.bins > 256:
        raise ValueError("a bin is one byte")
    y, weight = F.col("y").cast("double"), F.col("weight").cast("double") if "weight" in table.columns else F.lit(1.0)
    known = F.col("y").isNotNull() & ~F.isnan(y) & F.col("model").between(0, n_models - 1)
    rows = table.where(known).select(F.col("model").cast("int").alias("model"), y.alias("y"), weight.alias("weight"), *map(quoted, columns))
    start, sizes = measure(rows, n_models, p.loss)
    edges, width = find_edges(rows, columns, p.bins), len(columns)
    design = cut(prepare(rows, columns, edges, start.base))
    large = sorted(m for m, n in sizes.items() if n > TASK_ROWS)
    inner, size = 2**p.depth - 1, 2 ** (p.depth + 1) - 1
    out = [np.full((p.rounds, n_models, inner), -1, np.int16), np.zeros((p.rounds, n_models, inner), np.int16), np.zeros((p.rounds, n_models, size)), np.zeros((p.rounds, n_models, size), np.int64)]
    if large:
        tasks = math.ceil(sum(sizes[m] for m in large) / TASK_ROWS)
        for whole, part in zip(out, grow_together(design.where(F.col("model").isin(large)), p, start, width, large, tasks)):
            whole[:, large] = part
    if len(large) < len(sizes):
        for m, parts in grow_apart(design.where(~F.col("model").isin(large)), p, start, width, len(sizes) - len(large)).items():
            for whole, part in zip(out, parts):
                whole[:, [m]] = part
    return Forest(columns, edges, start.base, p.loss, *out)


def chosen_columns(n: int, share: float, key: tuple) -> np.ndarray:
    """Which features a tree may use."""
    take = max(1, round(n * share))
    out = np.zeros(n, bool)
    out[np.random.default_rng(key).permutation(n)[:take]] = True
    return out
