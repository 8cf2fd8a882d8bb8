"""Runs by synchronising sets against all periods of all stretches."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stationproof.llm import periodic_runs as R
from stationproof.llm.common import documents as table
from tests.llm.data import SF, documents, odd


def brute(w: np.ndarray) -> list:
    best: dict = {}
    for q in range(1, len(w) // 2 + 1):
        same = [*(w[:-q] == w[q:]).tolist(), False]
        start = None
        for i, s in enumerate(same):
            if s and start is None:
                start = i
            elif not s and start is not None:
                if i - start >= q:
                    best.setdefault((start, i + q), q)
                start = None
    return sorted((a, b, q) for (a, b), q in best.items())


def check(w) -> int:
    w = np.array(w, dtype=np.int64)
    found = R.find_runs(w)
    assert found == brute(w), w.tolist()
    return len(found)


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 22, 100, 377, 800])
def test_runs_of_known_words(n):
    check(fibonacci(n))
    check([bin(i).count("1") % 2 for i in range(n)])
    check([0] * n)
    check(range(n))


def test_periods_that_are_highly_periodic_themselves(monkeypatch):
    for k in (8, 20, 40, 57):
        for tail in ([0, 0], [0], [0, 0, 1, 0], []):
            check(([0, 0, 1] * k + tail) * 2)
            check(([0, 1] * k + [2] + [0, 1] * k) * 3)
    monkeypatch.setattr(R, "touching", lambda *a: None)
    with pytest.raises(AssertionError):
        check(([0, 0, 1] * 40 + [0, 0]) * 2)


def test_runs_of_random_words():
    rng, seen = random.Random(11), 0
    for case in range(600):
        w = [rng.randrange(rng.choice([1, 2, 2, 3, 50])) for _ in range(rng.randint(1, 200))]
        for _ in range(rng.randint(0, 4)):
            unit = w[: rng.randint(1, 60)] if case % 3 else ([0] * rng.randint(1, 6) + [1]) * rng.randint(1, 12)
            x = (unit * rng.randint(2, 5))[: -rng.randint(1, len(unit))]
            at = rng.randint(0, len(w))
            w = w[:at] + x + w[at:]
        if case % 5 == 0:
            w[rng.randrange(len(w))] = 3
            w = w + w[: rng.randint(0, len(w))] + w
        seen += check(w[:700])
    assert seen > 10_000


def test_query(spark):
    texts = odd(random.Random(1)) + [(20, "to be or not " * 4), (21, "a " * 11), (22, "a " * 12), (23, " ".join(map(str, range(300))) * 3)]
    docs = documents(spark, texts).withColumn("a.b", F.lit(1))
    found = R.find(docs)
    assert found.columns == [*docs.columns, "n_words", "runs", "collapsed"]
    rows = {r.doc_id: r for r in found.collect()}
    assert [tuple(x) for x in rows[20].runs] == [(0, 16, 4)] and rows[20].collapsed == "to be or not"
    assert rows[21].runs == [] and rows[21].collapsed == " ".join("a" * 11)
    assert [tuple(x) for x in rows[22].runs] == [(0, 12, 1)] and rows[22].collapsed == "a"
    assert rows[1].n_words == 0 and rows[1].collapsed == "" and rows[1].runs == []
    assert found.count() == len(texts) and R.find(docs.where("false")).count() == 0
    assert R.report(R.find(R.plant(docs), keep=["doc_id"])).count() == len(texts)


def test_report_against_brute_force(spark):
    got = {r.doc_id: r for r in R.report(R.find(R.plant(table(spark, SF)), keep=["doc_id"])).collect()}
    for r in table(spark, SF).collect():
        if len(r.text) > 12_000:
            continue  # the plain way is quadratic
        ws = R.planted(r.doc_id, R.words(r.text))
        number = {w: i for i, w in enumerate(dict.fromkeys(ws))}
        runs = sorted((a, b - a, q) for a, b, q in brute(np.array([number[w] for w in ws])) if b - a >= 12)
        dropped = {i for a, n, q in runs for i in range(a + q, a + n)}
        text = b" ".join(w for i, w in enumerate(ws) if i not in dropped)
        lines = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        wanted = (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text).hexdigest())
        assert tuple(got[r.doc_id])[1:] == wanted
    assert sum(x.n_runs > 0 for x in got.values()) > 10
