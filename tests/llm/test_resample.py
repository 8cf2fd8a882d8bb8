"""Importance resampling against a plain computation and its SQL twin."""

import hashlib
import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from stationproof.llm import resample as R
from stationproof.llm.common import letter_words
from tests.compare import compare, connect
from tests.llm.data import SF, documents, odd, prose


def brute(texts, target, longest=1, buckets=10_000, percent=10, least=20):
    def places(text):
        ws = letter_words(text)
        return [zlib.crc32(b" ".join(ws[i : i + k])) % buckets for k in range(1, longest + 1) for i in range(len(ws) - k + 1)]

    s, t = Counter(p for _, x in texts for p in places(x)), Counter(p for x in target for p in places(x))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets)))) for b in range(buckets)}
    out = []
    for i, x in texts:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[p] for p in places(x))
        out.append([i, len(places(x)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(letter_words(x))])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = k + 1
    return sorted(map(str, (tuple(r[:5]) for r in out)))


@pytest.mark.parametrize("longest, percent", [(1, 10), (2, 50), (1, 100), (1, 0)])
def test_against_brute_force(spark, longest, percent):
    rng = random.Random(4)
    texts = odd(rng) + [(100 + i, prose(rng, rng.randint(10, 60))) for i in range(200)] + [(9, prose(rng, 30))] * 3
    target = [prose(rng, 200, ("the", "on")), None, ""]
    docs = documents(spark, texts).withColumn("a.b", F.lit(1)).withColumn("score", F.lit("old")).withColumn("id_and_text", F.lit(2))
    made = R.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), longest=longest, percent=percent)
    assert made.columns == ["doc_id", "text", "lang", "source", "n_chars", "ids", "keep", "found", "_h", "block", "a.b", "id_and_text", "n_features", "n_words", "weight", "score", "rank"]
    assert sorted(str(tuple(r)) for r in R.report(made).collect()) == brute(texts, target, longest, percent=percent)


def test_empty_tables(spark):
    docs, none = documents(spark, [(1, prose(random.Random(1), 40))] * 20), documents(spark, []).where("false")
    assert R.resample(none, docs).count() == 0
    assert sorted(r["rank"] for r in R.resample(docs, none).where("rank is not null").collect()) == [1, 2]


@pytest.mark.parametrize("values", [[7] * 5000, list(range(5000)), [0] * 2500 + list(range(2500)), [int(math.exp(i / 300)) for i in range(5000)]])
def test_bracket_holds_the_cutoff(spark, values, monkeypatch):
    monkeypatch.setattr(R, "ACCURACY", 50)
    scores = spark.createDataFrame([(v,) for v in values], "v long")
    ordered = sorted(values, reverse=True)
    for k in (1, 500, 2500, 5000):
        low, high, above = R.bracket(scores, "v", len(values), k)
        assert low <= ordered[k - 1] <= high and above == sum(v > high for v in values)


def test_bracket_widens_where_the_sketch_misses(spark, monkeypatch):
    scores = spark.createDataFrame([(v,) for v in range(1000)], "v long")
    asked = []

    def wrong(col, ask, accuracy):
        asked.append(ask)
        return F.array(F.lit(990), F.lit(999)) if len(asked) == 1 else F.array(F.min(col), F.max(col))

    monkeypatch.setattr(R.F, "percentile_approx", wrong)
    assert R.bracket(scores, "v", 1000, 500) == (0, 999, 0) and len(asked) == 2


def test_twin(spark):
    ok, message = compare(spark, connect(SF), "op11_resample", entry.queries()["op11_resample"], entry.oracle_sql()["op11_resample"], SF)
    assert ok, message
