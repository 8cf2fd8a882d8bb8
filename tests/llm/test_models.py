"""Language model, near duplicates, neighbours, quality and the pipeline against brute force or held-out rows."""

import math
import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from stationproof.functions.state import checkpoint_dir
from stationproof.llm import class_lm, near_dedup, neighbours, pieces, quality, secrets
from stationproof.llm.common import documents as table
from tests.compare import compare, connect
from tests.llm.data import SF, documents, odd, prose


def test_class_model(spark):
    docs = table(spark, SF)
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    texts += [(None, None), (900, ""), (901, "zz zz"), (901, "zz zz")]
    rows = class_lm.score(documents(spark, texts)).collect()
    held = lambda i: zlib.crc32(str(i if i is not None else "").encode()) % 7 == 2
    counts = Counter(w for i, t in texts if not held(i) for w in class_lm.tokens(t))
    n, v = sum(counts.values()), len(counts)
    wanted = sorted((str(i), held(i), len(x), sum(counts[w] > 0 for w in x), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in x)) for i, t in texts for x in [class_lm.tokens(t)])
    got = sorted((str(r.doc_id), *r[1:6]) for r in rows)
    assert [g[:5] for g in got] == [w[:5] for w in wanted]
    assert np.allclose([g[5] for g in got], [w[5] for w in wanted], rtol=1e-9)
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert class_lm.score(documents(spark, texts).where("false")).count() == 0


def test_every_word_of_a_few_occurrences_has_its_own_class(spark, monkeypatch):
    monkeypatch.setattr(class_lm, "PART", 300)
    monkeypatch.setattr(class_lm, "HELD_PAIRS", 900)
    monkeypatch.setattr(class_lm, "ROUNDS", 3)
    rng = random.Random(2)
    texts = [" ".join(f"{a}{rng.randint(10, 99)}{e}" for _ in range(30) for a, e in (("n", "xx"), ("v", "xx"))) for _ in range(60)] + ["rare", ""]
    train = documents(spark, list(enumerate(texts)))
    counts = class_lm.word_counts(train)
    parts = 3
    own, cut = class_lm.owners(counts, parts), class_lm.pieces(train, parts)
    own, cut = class_lm.stored(own, "parts"), class_lm.stored(cut, "pieces")
    state, m = class_lm.exchange(own, cut, parts)
    classes = {bytes(r.word): r.k for r in class_lm.classed(own, state).collect()} | {b"": 0}
    assert set(classes) == {w for t in texts for w in class_lm.tokens(t)}
    wanted = np.zeros_like(m)
    for t in texts:
        k = [0, *(classes[w] for w in class_lm.tokens(t))]
        for x, y in zip(k, k[1:]):
            wanted[x, y] += 1
    assert (m == wanted).all()
    assert class_lm.group(b"n10xx") == class_lm.group(b"v10xx")  # one symbol and so one class before
    of = {a: Counter(k for w, k in classes.items() if w.startswith(a)) for a in (b"n", b"v")}
    assert all(len(of[a]) > 1 for a in of)
    monkeypatch.setattr(class_lm, "ROUNDS", 0)
    assert class_lm.likelihood(m) > class_lm.likelihood(class_lm.exchange(own, cut, parts)[1])


def test_a_round_reads_the_corpus_once(spark, monkeypatch):
    monkeypatch.setattr(class_lm, "HELD_PAIRS", 300)
    monkeypatch.setattr(class_lm, "HELD_CELLS", 700)
    monkeypatch.setattr(class_lm, "ROUNDS", 2)
    reads, at_pieces = [], class_lm._at_pieces
    monkeypatch.setattr(class_lm, "_at_pieces", lambda *tables: reads.append(1) or at_pieces(*tables))
    rng = random.Random(4)
    train = documents(spark, [(i, " ".join(rng.choice("the dog cat sees a big old sees".split()) for _ in range(40))) for i in range(30)])
    own, cut = class_lm.stored(class_lm.owners(class_lm.word_counts(train), 2), "parts"), class_lm.stored(class_lm.pieces(train, 2), "pieces")
    _, m = class_lm.exchange(own, cut, 2)
    assert m.sum() == 30 * 41 and len(reads) <= 4  # the first, one a round, and one after a round taken back


def test_rounds_read_links_in_small_rows_and_not_the_corpus(spark, monkeypatch):
    monkeypatch.setattr(class_lm, "HELD_PAIRS", 300)
    monkeypatch.setattr(class_lm, "HELD_LINKS", 50)
    monkeypatch.setattr(class_lm, "ROW_BYTES", 320)
    reads, at_pieces = [], class_lm._at_pieces
    monkeypatch.setattr(class_lm, "_at_pieces", lambda *tables: reads.append(1) or at_pieces(*tables))
    rng = random.Random(7)
    texts = [" ".join(rng.choice("the dog cat sees a big old sees".split()) for _ in range(40)) for _ in range(30)] + ["", None, "x x x x"]
    train = documents(spark, list(enumerate(texts)))
    cut = class_lm.stored(class_lm.pieces(train, 2), "pieces")
    own = class_lm.stored(class_lm.owners(class_lm.word_counts(train), 2), "parts")
    links = class_lm.linked(class_lm.stored(class_lm.asks(own, cut), "asks"), cut).where("kind = 1").collect()
    found, ends = Counter(), 0
    for r in links:
        if r.part == class_lm.TOTALS:
            ends += r.n
            continue
        _, way, near, n = class_lm._links(r.body)
        assert len(n) <= 20
        for w, x, m in zip(way.tolist(), near.tolist(), n.tolist()):
            found[w, x > 0] += m
    pairs = [p for t in texts for x in [[b"", *class_lm.tokens(t)]] for p in zip(x, x[1:])]
    assert ends == sum(a == b == b"" for a, b in pairs) == 2
    wanted = Counter((0, b != b"") for a, b in pairs if a) + Counter((1, a != b"") for a, b in pairs if b) + Counter((2, False) for a, b in pairs if a == b != b"")
    assert found == wanted
    reads.clear()
    monkeypatch.setattr(class_lm, "ROUNDS", 5)
    assert class_lm.score(train).count() == len(texts)
    assert len(reads) <= 2  # for the links, and for the scores


def test_tables_leave_the_disk_when_nothing_reads_them(spark, monkeypatch):
    monkeypatch.setattr(class_lm, "HELD_PAIRS", 300)
    monkeypatch.setattr(class_lm, "PART", 2)
    monkeypatch.setattr(class_lm, "ROUNDS", 2)
    rng = random.Random(9)
    texts = [" ".join(rng.choice("the dog cat sees a big old sees".split()) for _ in range(40)) for _ in range(30)]
    folder = checkpoint_dir(spark)
    tables = lambda: {p for p in Path(folder.removeprefix("file:")).glob("tables/*/**/*.parquet")}
    before, at_moves, moved = tables(), [], class_lm.moved
    monkeypatch.setattr(class_lm, "moved", lambda *a: at_moves.append(tables() - before) or moved(*a))
    scores = class_lm.score(documents(spark, list(enumerate(texts))))
    kinds = lambda files: {p.relative_to(folder.removeprefix("file:")).parts[1].split("-")[0] + "".join(f"/{x}" for x in p.parts if "=" in x) for p in files}
    assert kinds(at_moves[0]) == {"pieces/texts=true", "parts", "asks", "classes", "links/kind=0", "links/kind=1"}  # no words, no bigrams
    assert not any(k.startswith("links") for k in kinds(tables() - before))
    assert scores.count() == len(texts)


def test_gains_by_shared_steps_equal_those_without(monkeypatch):
    rng, k = np.random.default_rng(3), class_lm.CLASSES + 1
    m, own = rng.integers(500, 900, (k, k)).astype(float), rng.integers(1, k, 40)
    after, before, twice = (rng.integers(0, 90, (40, k)) * rng.integers(0, 2, (40, k))).astype(float), rng.integers(0, 3, (40, k)).astype(float), rng.integers(0, 3, 40).astype(float)
    line = np.arange(40)
    after[line, own] += twice
    before[line, own] += twice
    with_steps = class_lm.all_gains(m, own, after, before, twice)
    monkeypatch.setattr(class_lm, "STEPS", 1)
    assert np.array_equal(with_steps, class_lm.all_gains(m, own, after, before, twice))


def test_gains_are_differences_of_likelihood():
    rng, k, size = np.random.default_rng(1), class_lm.CLASSES + 1, 90
    pairs = rng.integers(0, 5, (size, size)).astype(float)
    classes = rng.integers(0, k, size)
    hot = np.eye(k)[classes]
    matrix = lambda h: h.T @ pairs @ h
    for s in range(0, size, 9):
        g = class_lm.gains(matrix(hot), classes[s], pairs[s] @ hot, hot.T @ pairs[:, s], pairs[s, s])
        for to in (3, 17, int(classes[s])):
            moved = hot.copy()
            moved[s] = np.eye(k)[to]
            assert math.isclose(g[to] - g[classes[s]], class_lm.likelihood(matrix(moved)) - class_lm.likelihood(matrix(hot)), rel_tol=1e-6, abs_tol=1e-6)


def brute_components(texts, width, percent):
    sets = []
    for _, t in texts:
        w = near_dedup.blank_words(t)
        k = min(width, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                up[root(a)] = root(b)
    least = {}
    for i, (doc_id, _) in enumerate(texts):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return sorted((str(d), len(s), str(least.get(root(i)))) for i, ((d, _), s) in enumerate(zip(texts, sets)))


def copies(rng, base, n, most):
    out = []
    for _ in range(n):
        w = base.split()
        for i in rng.sample(range(len(w)), int(len(w) * rng.uniform(0, most))):
            w[i] = prose(rng, 1)
        out.append(" ".join(w))
    return out


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    rng = random.Random(9)
    texts = odd(rng) + [(50 + i, t) for i, t in enumerate(copies(rng, prose(rng, 80), 90, 0.14))]
    texts += [(200 + i, t) for g in range(6) for i, t in enumerate(copies(rng, prose(rng, 60), 6, 0.1), 10 * g)] + [(400 + i, prose(rng, 50)) for i in range(30)] + [(500, texts[20][1])]
    docs = documents(spark, texts)
    rows = near_dedup.near_duplicates(docs, width=2).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in rows) == brute_components(texts, 2, 80)
    kept = near_dedup.keep_one(docs, width=2)
    assert kept.columns == docs.columns
    assert kept.count() == len({str(r.doc_id) + str(r.text_hash) for r in rows if r.kept})
    assert near_dedup.near_duplicates(docs.where("false")).count() == 0


def test_fewest_matches_keep_the_miss_probability():
    n, p = 80, 0.8 + 0.2 / 256
    m = near_dedup.fewest_matches(80)[1]
    assert sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(m)) < 1e-5


def test_components_of_a_long_chain(spark):
    key = lambda i: bytearray(i.to_bytes(4, "big"))
    links = spark.createDataFrame([(key(i), key(i + 1)) for i in range(60)] + [(key(100), key(101))], "a binary, b binary")
    got = {bytes(r.key): bytes(r.label) for r in near_dedup.components(links).collect()}
    assert set(got.values()) == {bytes(key(0)), bytes(key(100))} and len(got) == 63


def test_walk_takes_cells_in_order():
    rng = np.random.default_rng(1)
    d1, d2, counts = rng.random(9), rng.random(7), rng.integers(0, 3, (9, 7))
    got = neighbours.walk(d1, d2, counts, counts.sum())
    assert got == sorted(((i, j) for i in range(9) for j in range(7) if counts[i, j]), key=lambda c: d1[c[0]] + d2[c[1]])


def test_neighbours(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 100)
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    hit = total = 0
    rows = vectors.collect()
    ids, m = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    found = {}
    for r in neighbours.report(vectors).collect():
        found.setdefault(r.query_id, []).append(r)
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((m - m[q]) ** 2).sum(axis=1))
        true = [i for i in np.lexsort((ids, d)) if i != q][:10]
        own = sorted(found[ids[q]], key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 11)) and own == sorted(own, key=lambda r: (r.score, r.vec_id))
        assert all(abs(r.score - d[np.flatnonzero(ids == r.vec_id)[0]]) < 1e-12 for r in own)
        hit, total = hit + len({r.vec_id for r in own} & set(ids[true])), total + 10
    assert hit / total >= 0.9


def test_neighbours_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (100, [1.0, 0.0]), (5, None), (None, [1.0, 2.0]), (6, [0.0, 0.0]), (7, [math.nan, 1.0]), (8, [None, 1.0]), (9, [1.0, 2.0, 3.0]), (10, [2.0, 1.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, rank string")
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in neighbours.report(df).collect())
    assert got == [(0, 1, 100, 0.0), (0, 2, 100, 0.0), (0, 3, 10, 1.414214), (100, 1, 0, 0.0), (100, 2, 10, 1.414214)]
    assert neighbours.report(df.where("false")).count() == 0


def test_quality_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = quality.score(docs, *quality.train(docs)).collect()
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table("/root/testdata/sf0.01/labels.parquet").to_pylist()}
    seen = [(labels[r.doc_id], r.keep) for r in rows if r.doc_id in labels]
    assert np.mean([bool(q) == k for q, k in seen]) > 0.97 and np.mean([k for q, k in seen if q]) > 0.98
    strange = documents(spark, odd(random.Random(1)))
    model = quality.train(strange)
    assert quality.score(strange, *model).count() == 10 and quality.accepted(strange, *model).columns == strange.columns
    assert quality.score(strange.where("false"), *quality.train(strange.where("false"))).count() == 0


def test_votes_find_labeller_accuracies():
    rng, true = random.Random(1), [0.9, 0.8, 0.7, 0.95, 0.6, 0.85, 0.9, 0.75]
    patterns = Counter()
    for _ in range(20_000):
        y = 1 if rng.random() < 0.7 else -1
        patterns[tuple((y if rng.random() < a else -y) if rng.random() < 0.6 else 0 for a in true)] += 1
    model = quality.fit_votes([(list(p), n) for p, n in patterns.items()])
    assert abs(model["prior"] - 0.7) < 0.03 and all(abs(a - b) < 0.05 for a, b in zip(model["accuracy"], true))


def test_pipeline(spark):
    stages = dict(corpus_pipeline.STAGES)
    docs = table(spark, SF)
    good = stages["quality_classifier"](spark, docs, SF)
    assert good.columns == docs.columns and good.count() < docs.count()
    texts = [(r.doc_id, r.text) for r in good.collect()]
    one = stages["minhash_near_dedup"](spark, good, SF)
    heads = {c for _, _, c in brute_components(texts, 5, 80)}
    empty = {str(i) for i, t in texts if not (t or "").split()}
    assert {str(r.doc_id) for r in one.collect()} == (heads | empty) - {"None"} and one.columns == docs.columns
    clean = stages["benchmark_decontamination"](spark, one, SF)
    assert clean.columns == docs.columns and clean.count() <= one.count()
    safe = stages["secret_scans"](spark, clean, SF)
    assert safe.columns == docs.columns and safe.count() == clean.count()
    base = secrets.report(safe, [0.0] * len(secrets.ALPHABET) ** 2).where("n_assign + n_access + n_hex > 0")
    assert base.count() == 0
    made = corpus_pipeline.run(spark, SF)
    assert made.columns == ["doc_id", "ids", "decoded"]
    assert {(r.doc_id, r.decoded) for r in made.collect()} == {(r.doc_id, r.text) for r in safe.collect()}
    assert pieces.digests(made).count() == safe.count()


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if n.startswith("op") and n in ("op1_decontaminate", "op6_near_dedup", "op9_secrets")])
def test_twin(spark, name):
    ok, message = compare(spark, connect(SF), name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert ok, message
