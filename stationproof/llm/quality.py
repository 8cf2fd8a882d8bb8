"""Quality classifier from weak labels.

Eight heuristic labellers vote low (-1), high (1) or abstain (0) on each document; most look for one defect and abstain where
they see none. Expectation-maximisation over the counts of their vote patterns, gathered from every document (at most 3^8
patterns), estimates the share of high quality and each labeller's accuracy where it votes, without any true label. Posteriors of a bounded sample of about `SAMPLE` documents then train a
logistic scorer on hashed features (word shapes and bucketed text statistics, 2^14 weights), which scores every document.

A document is rejected when its score, the probability of high quality, is under 0.5. Null and empty texts have no words: all
labellers abstain and they are scored by the bias and the feature of emptiness. Repeated rows score alike; texts count
whole. Without documents the scorer stays at the prior. Other columns pass through; those named like a result are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationproof.llm.common import map_text, stored, without
from stationproof.llm.words import Recent

#: Documents that train the scorer, about.
SAMPLE = 20_000
BITS = 14
EPOCHS, RATE, DECAY = 60, 0.5, 1e-5
LABELLERS = ["repeated_word", "variety", "repeated_neighbour", "symbols", "prose", "separators", "capitals", "repeated_lines"]
_PLAIN = re.compile(rb"[Aa]+[.,;:?'\"]?")
_SHAPE = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256))
_RUN = re.compile(rb"(.)\1+", re.S)
_shapes = Recent("quality", 100_000)


def measures(text: str | None) -> dict[str, float]:
    """Statistics of one text that labellers and features use."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return {"n": 0}
    counts = Counter(words)
    shapes = _shapes.ensure(set(words), lambda new: [_RUN.sub(rb"\1", w.translate(_SHAPE)) for w in new])
    by_shape: Counter = Counter()
    for w, c in counts.items():
        by_shape[shapes[w]] += c
    lines = [x for x in raw.split(b"\n") if x.strip()]
    letters = sum(map(len, words))
    shaped = {s: (sum(b in b"#$%&*@^~=<>{}[]\\_+" or b == 33 for b in s) > 0, b"A" in s and b"a" not in s, s in (b"|", b"-", b"/", b";", b":")) for s in by_shape}
    plain = sum(c for s, c in by_shape.items() if _PLAIN.fullmatch(s)) / n
    twice = sum(a == b for a, b in zip(words, words[1:])) / n
    share = lambda k: sum(c for s, c in by_shape.items() if shaped[s][k]) / n
    return {
        "n": n, "top": max(counts.values()) / n, "distinct": len(counts) / n, "symbols": share(0), "capitals": share(1), "separators": share(2), "plain": plain, "twice": twice,
        "lines": 1 - len(set(lines)) / max(len(lines), 1), "length": letters / n, "shapes": by_shape,
    }


def votes(m: dict) -> list[int]:
    """One vote of each labeller."""
    n = m["n"]
    if not n:
        return [0] * len(LABELLERS)

    def low(value: float, over: float, least: int = 1) -> int:
        return -1 if n >= least and value > over else 0

    return [
        low(m["top"], 0.3, 15), low(1 - m["distinct"], 0.8, 15), low(m["twice"], 0.2, 5), low(m["symbols"], 0.25, 5),
        0 if n < 5 else -1 if m["plain"] < 0.6 else 1 if m["plain"] > 0.85 and m["twice"] < 0.05 else 0, low(m["separators"], 0.15, 5), low(m["capitals"], 0.4, 5), low(m["lines"], 0.3, 15),
    ]


def features(m: dict) -> dict[int, float]:
    """Hashed features: square roots of shape frequencies, and one indicator a bucketed statistic."""
    out: dict[int, float] = {}

    def put(name: bytes, value: float):
        i = zlib.crc32(name) & (1 << BITS) - 1
        out[i] = out.get(i, 0.0) + value

    put(b"empty" if not m["n"] else b"text", 1.0)
    if m["n"]:
        for s, c in m["shapes"].items():
            put(b"s:" + s[:12], (c / m["n"]) ** 0.5)
        for k in ("top", "distinct", "symbols", "capitals", "separators", "plain", "twice", "lines"):
            put(f"{k}:{int(m[k] * 10)}".encode(), 1.0)
        put(f"n:{min(m['n'], 1 << 20).bit_length()}".encode(), 1.0)
    return out


def posterior(model: dict, pattern: list[int]) -> float:
    """Probability of high quality given the votes."""
    odds = np.log(model["prior"] / (1 - model["prior"])) + sum(v * np.log(a / (1 - a)) for v, a in zip(pattern, model["accuracy"]))
    return float(1 / (1 + np.exp(-np.clip(odds, -50, 50))))


def fit_votes(patterns: list[tuple[list[int], int]], rounds: int = 50) -> dict:
    """Expectation-maximisation of the prior and the labellers' accuracies; it starts from labellers that are mostly right."""
    model = {"prior": 0.8, "accuracy": [0.85] * len(LABELLERS)}
    if not patterns:
        return model
    v = np.array([p for p, _ in patterns])
    c = np.array([n for _, n in patterns], dtype=float)
    for _ in range(rounds):
        high = np.array([posterior(model, p) for p, _ in patterns])
        right = (c * high)[:, None] * (v == 1) + (c * (1 - high))[:, None] * (v == -1)
        # Four right votes and one wrong one in front: a labeller that never votes keeps 0.8.
        accuracy = (right.sum(axis=0) + 4) / ((c[:, None] * (v != 0)).sum(axis=0) + 5)
        model = {"prior": float(np.clip((c * high).sum() / c.sum(), 0.05, 0.95)), "accuracy": np.clip(accuracy, 0.55, 0.98).tolist()}
    return model


def fit_scorer(rows: list[tuple[dict[int, float], float]]) -> np.ndarray:
    """Weights of the logistic scorer on soft labels; the last is the bias."""
    weights = np.zeros((1 << BITS) + 1)
    if not rows:
        return weights
    size = [len(x) for x, _ in rows]
    index = np.concatenate([np.fromiter(x.keys(), np.int64, len(x)) for x, _ in rows])
    value = np.concatenate([np.fromiter(x.values(), float, len(x)) for x, _ in rows])
    row = np.repeat(np.arange(len(rows)), size)
    target = np.array([y for _, y in rows])
    # The rarer class counts as much as the other in the first half of its weight.
    share = min(max(target.mean(), 0.05), 0.95)
    weight = target * (0.5 / share) ** 0.5 + (1 - target) * (0.5 / (1 - share)) ** 0.5
    speed = np.full(len(weights), 1e-8)
    for _ in range(EPOCHS):
        z = np.bincount(row, value * weights[index], len(rows)) + weights[-1]
        error = weight * (1 / (1 + np.exp(-z)) - target) / len(rows)
        grad = np.append(np.bincount(index, value * error[row], len(weights) - 1), error.sum()) + DECAY * weights
        speed += grad**2
        weights = weights - RATE * grad / np.sqrt(speed)
    return weights


def labelled(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add `votes`, one character (l, -, h) a labeller."""

    def make():
        return lambda texts: {"votes": pa.array(["".join("l-h"[v + 1] for v in votes(measures(t))) for t in texts], pa.string())}

    return map_text(docs, make, "votes string", text_col, keep)


def train(docs: DataFrame, text_col: str = "text") -> tuple[dict, np.ndarray]:
    """Vote model from all documents, scorer from the sample."""
    seen = docs.select(F.col(f"`{text_col}`").alias("text"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns if c in ("doc_id", text_col)]).alias("_h"))
    voted = stored(labelled(seen, keep=["_h"]), "votes")
    counted = voted.groupBy("votes").count().collect()
    total = sum(r["count"] for r in counted)
    model = fit_votes([(["l-h".index(x) - 1 for x in r.votes], r["count"]) for r in counted])
    limit = int(min(1.0, SAMPLE / max(total, 1)) * 1_000_000)

    def make():
        def run(texts: list) -> dict[str, pa.Array]:
            made = [(features(m), posterior(model, votes(m))) for m in map(measures, texts)]
            return {
                "at": pa.array([list(x) for x, _ in made], pa.list_(pa.int32())), "value": pa.array([list(x.values()) for x, _ in made], pa.list_(pa.float32())),
                "high": pa.array([y for _, y in made], pa.float64()),
            }

        return run

    drawn = seen.where(F.pmod("_h", F.lit(1_000_000)) < limit)
    rows = map_text(drawn, make, "at array<int>, value array<float>, high double", keep=[]).collect()
    return model, fit_scorer([(dict(zip(r.at, r.value)), r.high) for r in rows])


def score(docs: DataFrame, model: dict, weights: np.ndarray, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add `votes`, `weak_label` (posterior of the votes), `quality` (the scorer's probability of high) and `keep`."""

    def make():
        def run(texts: list) -> dict[str, pa.Array]:
            out = []
            for m in map(measures, texts):
                v, x = votes(m), features(m)
                z = weights[-1] + sum(weights[i] * value for i, value in x.items())
                out.append(("".join("l-h"[a + 1] for a in v), posterior(model, v), float(1 / (1 + np.exp(-z)))))
            a, b, c = zip(*out)
            return {"votes": pa.array(a, pa.string()), "weak_label": pa.array(b, pa.float64()), "quality": pa.array(c, pa.float64()), "keep": pa.array([p >= 0.5 for p in c], pa.bool_())}

        return run

    return map_text(docs, make, "votes string, weak_label double, quality double, keep boolean", text_col, keep)


def accepted(docs: DataFrame, model: dict, weights: np.ndarray, text_col: str = "text") -> DataFrame:
    """Documents that are not rejected, with their own columns only."""

    def make():
        def run(texts: list) -> dict[str, pa.Array]:
            z = [weights[-1] + sum(weights[i] * value for i, value in features(measures(t)).items()) for t in texts]
            return {"__accepted": pa.array([bool(x >= 0) for x in z], pa.bool_())}

        return run

    return without(map_text(docs, make, "__accepted boolean", text_col).where("__accepted"), "__accepted")
