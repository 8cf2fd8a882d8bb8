"""Decontamination, license scans and secret scans against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

from stationproof.llm import decontaminate, licenses, queries, secrets
from tests.llm.data import SF, documents, odd, prose

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def expected_hits(texts, items):
    grams = defaultdict(set)
    for item, text in items:
        w = words(text)
        k = min(len(w), 10)
        for i in range(len(w) - k + 1 if w else 0):
            grams[tuple(w[i : i + k])].add(item)
    out = []
    for doc_id, text in texts:
        w, hit, found = words(text), set(), set()
        for k in {len(g) for g in grams}:
            for i in range(len(w) - k + 1):
                if (g := tuple(w[i : i + k])) in grams:
                    hit |= set(range(i, i + k))
                    found |= grams[g]
        listed = ",".join(sorted(str(x) for x in found))
        out.append((str(doc_id), len(w), len(hit), len(found), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)))
    return sorted(out)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(1)
    items = [(i, prose(rng, rng.choice([3, 9, 10, 11, 30]))) for i in range(12)] + [(20, None), (21, "..."), (3, "qq ww"), (30, "qq WW")]
    texts = odd(rng) + [(100 + i, prose(rng, 40)) for i in range(20)]
    for i in range(20):
        w = items[i % 12][1].split()
        at = rng.randint(0, max(len(w) - 10, 0))
        texts.append((200 + i, f"{prose(rng, 5)}, {'; '.join(w[at : at + rng.randint(2, 14)]).upper()}! QQ-ww {prose(rng, 5)} {items[3][1]}"))
    return texts, items


def test_decontaminate(spark, corpus):
    texts, items = corpus
    docs, bench = documents(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.report(docs, bench).collect()
    assert sorted((str(r.doc_id), *r[1:]) for r in rows) == expected_hits(texts, items)
    dirty = {r.doc_id for r in rows if r.contaminated}
    left = decontaminate.remove_documents(docs, bench)
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(i) for i, _ in texts if i not in dirty)
    cut = decontaminate.remove_spans(docs, bench)
    assert cut.columns == docs.columns and cut.count() == len(texts)
    again = {r.doc_id: r for r in decontaminate.report(cut.where("doc_id < 200"), bench).collect()}
    assert all(not r.contaminated for r in again.values())
    assert decontaminate.report(docs.where("false"), bench).count() == 0
    assert {r.contaminated for r in decontaminate.report(docs, bench.where("false")).collect()} == {False}


def test_decontaminate_without_broadcast(spark, corpus, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    texts, items = corpus
    rows = decontaminate.report(documents(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((str(r.doc_id), *r[1:]) for r in rows) == expected_hits(texts, items)


def distance(pattern, text):
    """Fewest edits between the pattern and any substring."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_a_word_more_or_another_keeps_the_label():
    scanner = licenses.Scanner(licenses.PHRASES, licenses.NOTICES)
    gpl = next(n for n in licenses.NOTICES if n.startswith("this program"))
    altered = {
        "permission is hereby granted without charge to any person obtaining a copy of this software": None,
        "permission is granted free of charge to any person obtaining a copy of this software": None,
        "permission is hereby granted free of any charge to any person obtaining a copy of this software": "mit",
        gpl.replace("program", "library"): "gpl",
        gpl.replace("software you", "software and you"): "gpl",
    }
    for text, label in altered.items():
        least = min((distance(n, text), n) for n in licenses.NOTICES)
        wanted = label or (licenses.NOTICES[least[1]] if least[0] <= licenses.edits_allowed(least[1]) else None)
        assert {f["label"] for f in scanner.fuzzy(f" a {text} b ")} == ({wanted} if wanted else set())


def test_fuzzy_notices_lose_nothing():
    rng, scanner = random.Random(4), licenses.Scanner(licenses.PHRASES, licenses.NOTICES)
    letters = "abcdefghijklmnopqrstuvwxyz "
    seen = 0
    for _ in range(60):
        notice = rng.choice(list(licenses.NOTICES))
        x = list(notice)
        for _ in range(rng.randint(0, licenses.edits_allowed(notice) + 2)):
            i = rng.randrange(len(x))
            x[i : i + rng.randint(0, 1)] = rng.choice(["", rng.choice(letters)])
        line = f" {' '.join((prose(rng, 8) + ' ' + ''.join(x) + ' and more').split())} "
        found = scanner.fuzzy(line)
        wanted = {licenses.NOTICES[n] for n in licenses.NOTICES if distance(n, line) <= licenses.edits_allowed(n)}
        assert {f["label"] for f in found} == wanted
        assert all(0 < f["similarity"] <= 1 and f["edits"] <= max(map(licenses.edits_allowed, licenses.NOTICES)) for f in found)
        seen += bool(wanted)
    assert seen > 20


def test_license_report(spark):
    texts = odd(random.Random(2)) + [
        (50, "MIT License. The mit-license! CC BY 4, permit license"),
        (51, "Relaesed under teh MIT licence"),
        (52, "This work is licensed under the GNU General Public License, version 3"),
        (53, "Licensed under CC BY-NC 4.0, é"),
    ]
    rows = defaultdict(list)
    for r in licenses.report(licenses.scan(documents(spark, texts))).collect():
        rows[r.doc_id].append(r)
    assert sum(map(len, rows.values())) == len(texts)
    for doc_id, text in texts:
        w = words(text)
        places = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        want = (len(w), len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(sorted({x for _, x in places})))
        assert want in [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows[doc_id]]
    assert rows[51][0].labels == "" and rows[52][0].labels == "gpl" and rows[53][0].labels == "cc-by,cc-by-nc"
    assert rows[52][0].score == 1.0 and rows[4][0].score == 0.0


KINDS = {"assign": (re.compile(secrets.KINDS["assign"][0], re.A), 2, 12), "access": (re.compile("AKIA[A-Z0-9]+"), 0, 18), "hex": (re.compile("[0-9a-f]+"), 0, 16)}


def base_spans(text):
    return sorted((m.start(), k, m.end(), n) for k, (n, (p, g, least)) in enumerate(KINDS.items()) for m in p.finditer(text or "") if len(m.group(g)) >= least)


def test_secrets(spark):
    rng = random.Random(3)
    parts = ["token", "=", ":", " ", "abc123def456789", "AKIA", "ABCDEFGHIJKLMN", "é", "SECRET", "'", '"', "0123456789abcdef", "pass", "word", "api_key", "-", "\n"]
    random64 = "".join(rng.choice(secrets.ALPHABET[:62]) for _ in range(44))
    texts = odd(rng) + [(100 + i, "".join(rng.choice(parts) for _ in range(30))) for i in range(150)]
    texts += [(400, "key: abcdefghijkl0123\n" + "é token: abcdefghijkl0123\n" * 1200), (401, "token=secret=abcdefghijklmnop"), (402, "token=abc: SECRET: abcdefghijklmnopq")]
    texts += [(403, f"use {random64} now"), (404, "internationalizationframeworks and someverylongidentifiername")]
    docs = documents(spark, texts)
    keys = ["".join(rng.choice(secrets.ALPHABET[:62]) for _ in range(40)) for _ in range(300)]
    names = ["".join(rng.choice(["inter", "national", "frame", "work", "very", "long", "identifier", "name", "some", "ization"]) for _ in range(5)) for _ in range(300)]
    labelled = spark.createDataFrame([(k, True) for k in keys] + [(n, False) for n in names], "value string, random boolean")
    table = secrets.train(labelled)
    rows = defaultdict(list)
    for r in secrets.report(docs, table).collect():
        rows[r.doc_id].append(r)
    assert sum(map(len, rows.values())) == len(texts)
    for doc_id, text in texts:
        spans = base_spans(text)
        digest = hashlib.sha256(",".join(f"{n}:{a}:{b}" for a, _, b, n in spans).encode()).hexdigest()
        counts = tuple(sum(s[3] == k for s in spans) for k in KINDS)
        assert (*counts, digest) in [(r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in rows[doc_id]]
    assert rows[403][0].spans == "markov:4:48" and rows[404][0].spans == ""
    redacted = secrets.redact(docs, table)
    assert redacted.columns == docs.columns
    after = {r.doc_id: r for r in redacted.collect()}
    assert after[403].text == "use [secret] now" and after[403].found == "y" and after[1].text is None
    assert after[400].text.count("[secret]") == 1200 and not base_spans(after[400].text)
    assert secrets.report(docs.where("false"), table).count() == 0


def test_secret_samples_train_models(spark):
    docs = documents(spark, [(1, "token = abcdef0123456789abcdef01 and internationalizationframework"), (2, None)])
    assert sorted((r.value, r.random) for r in secrets.samples(docs).collect()) == [("abcdef0123456789abcdef01", True), ("abcdef0123456789abcdef01", True), ("internationalizationframework", False)]
    assert any(secrets.train(secrets.samples(docs))) and not any(secrets.train(secrets.samples(docs.where("doc_id = 2"))))


def test_secrets_query_finds_keys_of_every_alphabet(spark, tmp_path):
    rng = random.Random(8)
    keys = ["".join(rng.choice(letters) for _ in range(n)) for letters in secrets.DRAWN.values() for n in (24, 40, 64) for _ in range(10)]
    names = ["internationalization", "einlichkeitverkeitach"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(10**9 + i, f"use {k} now") for i, k in enumerate(keys + names)], docs.schema)
    docs.union(more).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id - 10**9: r.spans for r in queries.op9_secrets(spark, str(tmp_path)).where("doc_id >= 1000000000").collect()}
    assert sum(f":4:{4 + len(k)}" in found[i] for i, k in enumerate(keys)) >= 0.98 * len(keys)
    assert [found[len(keys) + i] for i in range(len(names))] == ["", ""]


def test_long_identifiers_and_spans_in_the_vocabulary(spark):
    docs = documents(spark, [(1, "a token=abcdef0123456789 of-x é_y zz" + " " + "g" * 300_000), (2, None), (3, "zz")])
    got = {(r.value, r.random): r.n for r in secrets.vocabulary(docs).collect()}
    assert got == {("abcdef0123456789", True): 2, ("of-x", False): 1, ("_y", False): 1, ("zz", False): 2, ("g" * 300_000, False): 1}
    assert any(secrets.learn(docs)) and not any(secrets.learn(docs.where("doc_id = 2")))
