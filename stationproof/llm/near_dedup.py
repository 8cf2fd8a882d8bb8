"""Near-duplicate documents: MinHash bands, sequential Bayesian verification, exact confirmation, components.

A document's set holds its distinct shingles of `width` words (lower-cased A-Z, cut at ASCII white space); with fewer words
the whole sequence is the one shingle. Documents of equal sets form one class; only classes are compared. A signature has
`BANDS` x `ROWS` minima; each band's minima hash to a bucket, and one byte of each minimum is kept for verification.

Pairs are found in two steps, so that a bucket of near copies is never expanded into all its pairs. First every member of a
bucket meets the bucket's hub, the member that shares most bucket places with others. Then buckets whose members still fall
into several components are open: each member outside an open bucket's largest component meets the members of other
components, as blocks in one task, each pair in the first bucket that it shares. The task runs the Bayesian test, counts common
shingles of what passes on sets of 32-bit hashes (with a little room, for collisions), and emits only what may link two parts that
no certain link has joined yet. Pairs inside one component need no test: no link can change the result.

The test compares signatures in batches of `BATCH`; after each batch a pair goes when the posterior probability (uniform
prior) that its similarity reaches the threshold is under `MISS`. Survivors are confirmed on their full shingle sets. A pair at
the threshold misses all bands with probability (1 - 0.8^5)^40 = 1.2e-7.

Null and empty texts have the empty set and link with nothing; a null doc_id is never a component's id unless all its
members' are null. Repeated rows are one class and keep one row each in the result. Texts of any length count whole. Only
doc_id and text are read; other columns play no part. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationproof.functions.columns import sized_broadcast
from stationproof.llm.common import blank_words, map_text, stored
from stationproof.llm.words import Recent

BANDS, ROWS = 40, 5
#: Signature places in one step of the Bayesian test, and the chosen probability of losing a true pair at a step.
BATCH, MISS = 40, 1e-7
#: Members of a bucket compared as one block.
BLOCK = 512
#: Common shingles that 32-bit hashes may hide in a pair, before the full sets decide.
ROOM = 3
#: Shingles hashed at once in a task.
FLAT = 1 << 18

_WORDS = Recent("near_dedup", 200_000)
_RNG = np.random.default_rng(6)
_MUL = (_RNG.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint64) * 2 + 1).astype(np.uint32)
_ADD = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
_MIX = _RNG.integers(0, 1 << 62, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _word_hashes(words: list[bytes]) -> np.ndarray:
    known = _WORDS.ensure(set(words), lambda new: [xxhash.xxh3_64_intdigest(w) for w in new])
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles."""
    words = blank_words(text)
    if not words:
        return np.empty(0, np.uint64)
    h = _word_hashes(words)
    width = min(width, len(words))
    acc = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        acc = _mixed(acc * np.uint64(0x9E3779B97F4A7C15) + h[k : len(words) - width + 1 + k])
    return np.unique(acc)


def set_key(values: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(values.tobytes()) if len(values) else b""


def _minima(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Signature rows of consecutive non-empty sets."""
    x = (flat >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts), BANDS * ROWS), np.uint32)
    for i in range(BANDS * ROWS):
        out[:, i] = np.minimum.reduceat(x * _MUL[i] + _ADD[i], starts)
    return out


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, key (of the set; empty for the empty set), sig (one byte a minimum), bands."""

    def make():
        def run(texts: list) -> dict[str, pa.Array]:
            sets = [shingle_set(t, width) for t in texts]
            sig: list[bytes | None] = [None] * len(sets)
            bands = np.zeros((len(sets), BANDS), np.int64)
            todo: list[int] = []
            held = 0

            def flush():
                if todo:
                    lengths = [len(sets[i]) for i in todo]
                    m = _minima(np.concatenate([sets[i] for i in todo]), np.cumsum([0, *lengths[:-1]]))
                    h = _mixed((m.reshape(-1, BANDS, ROWS).astype(np.uint64) * _MIX).sum(axis=2) + np.arange(BANDS, dtype=np.uint64))
                    bands[todo] = h.view(np.int64)
                    for i, row in zip(todo, (_mixed(m.astype(np.uint64)) & np.uint64(255)).astype(np.uint8)):
                        sig[i] = row.tobytes()
                    todo.clear()

            for i, s in enumerate(sets):
                if len(s):
                    todo.append(i)
                    held += len(s)
                    if held > FLAT:
                        flush()
                        held = 0
            flush()
            ends = np.cumsum([0, *[BANDS if s is not None else 0 for s in sig]])
            rows = bands[[s is not None for s in sig]].ravel()
            return {
                "n_shingles": pa.array([len(s) for s in sets], pa.int64()), "key": pa.array([set_key(s) for s in sets], pa.binary()),
                "sig": pa.array(sig, pa.binary()), "bands": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(rows, pa.int64())),
            }

        return run

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return map_text(rows, make, "n_shingles long, key binary, sig binary, bands array<long>", keep=["doc_id", "text_hash"])


def fewest_matches(percent: int) -> list[int]:
    """After each batch: the fewest equal places at which a pair stays. A byte also agrees by chance, once in 256."""
    t = percent / 100
    p = t + (1 - t) / 256
    out = []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        # With a uniform prior, P(similarity >= t | m of n) is the chance of at most m successes in n + 1 tries at p.
        tail, m = 0.0, -1
        while tail < MISS:
            m += 1
            tail += math.comb(n + 1, m) * p**m * (1 - p) ** (n + 1 - m)
        out.append(m)
    return out


def _passing(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, fewest: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Those index pairs whose signatures pass the sequential test."""
    equal = np.zeros(len(i), np.int32)
    for step, least in enumerate(fewest):
        part = slice(step * BATCH, step * BATCH + BATCH)
        equal = equal + (a[i, part] == b[j, part]).sum(axis=1)
        stays = equal >= least
        i, j, equal = i[stays], j[stays], equal[stays]
    return i, j


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), BANDS * ROWS)


def _test_pairs(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of class keys that pass the Bayesian test."""
    sig = lambda side: classes.select(F.col("key").alias(side), F.col("sig").alias(f"sig_{side}"))
    fewest = fewest_matches(percent)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if len(x):
                rows = np.arange(len(x))
                yield x.loc[:, ["a", "b"]].iloc[_passing(_matrix(x["sig_a"]), _matrix(x["sig_b"]), rows, rows, fewest)[0]]

    return pairs.join(sig("a"), "a").join(sig("b"), "b").mapInPandas(run, "a binary, b binary")


def _sets(keys: DataFrame, classes: DataFrame, docs: DataFrame, width: int, narrow: bool = False) -> DataFrame:
    """key, members: the sets of some classes, made again from one document of each; as 32-bit hashes if narrow."""
    chosen = classes.join(keys, "key", "left_semi").select(F.col("rep.doc_id").alias("_d"), F.col("rep.text_hash").alias("_h"))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    texts = rows.join(sized_broadcast(stored(chosen, "chosen")), rows["doc_id"].eqNullSafe(F.col("_d")) & (rows["text_hash"] == F.col("_h")), "left_semi")

    def make():
        def run(batch: list) -> dict[str, pa.Array]:
            sets = [shingle_set(t, width) for t in batch]
            held = [np.unique((s >> np.uint64(32)).astype(np.uint32)) if narrow else s for s in sets]
            return {"key": pa.array([set_key(s) for s in sets], pa.binary()), "members": pa.array([s.tobytes() for s in held], pa.binary())}

        return run

    return stored(map_text(texts, make, "key binary, members binary", keep=[]).dropDuplicates(["key"]), "sets")


def _confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those pairs whose full sets have the similarity."""
    pairs = stored(pairs, "pairs")
    sets = _sets(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct(), classes, docs, width)
    side = lambda s: sets.select(F.col("key").alias(s), F.col("members").alias(f"set_{s}"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            keep = []
            for p, q in zip(x["set_a"], x["set_b"]):
                p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield x.loc[keep, ["a", "b"]]

    return stored(pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(run, "a binary, b binary"), "links")


def components(links: DataFrame) -> DataFrame:
    """key, label: the smallest key reachable over links (a, b). Each round takes neighbours' labels, then labels' labels."""
    both = stored(links.union(links.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("key")).agg(F.min("b").alias("m")).select("key", F.least("key", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("key").alias("b"), "label"), "b").groupBy(F.col("a").alias("key")).agg(F.min("label").alias("near"))
        step = labels.join(near, "key").select("key", F.col("label").alias("was"), F.least("label", "near").alias("mid"))
        jump = labels.select(F.col("key").alias("mid"), F.col("label").alias("far"))
        after = stored(step.join(jump, "mid", "left").select("key", "was", F.least("mid", F.coalesce("far", "mid")).alias("label")), "labels")
        labels = after.select("key", "label")
        if after.where("was <> label").isEmpty():
            return labels


def _sizes_allow(n, m, percent: int):
    """Sets of sizes n and m can reach the similarity."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


class _Parts:
    """Which labels have been joined, within one task's block."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (above := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(above, above)
            x = above
        return x


def _open_links(members: DataFrame, labels: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Likely links (a, b) across components of open buckets, enough to join what they join."""
    named = members.join(labels, "key", "left").select("bucket", "key", "n", F.coalesce("label", "key").alias("label"))
    parts = named.groupBy("bucket", "label").agg(F.count("*").alias("c"))
    whole = parts.groupBy("bucket").agg(F.count("*").alias("parts"), F.sum("c").alias("all"), F.max(F.struct("c", "label")).alias("top")).where("parts > 1")
    blocks = lambda c: F.ceil(c / BLOCK).cast("int")
    opened = whole.select("bucket", F.col("top.label").alias("main"), blocks(F.col("all") - F.col("top.c")).alias("na"), blocks(F.col("all")).alias("nb"))
    places = stored(named.join(opened, "bucket"), "open")
    keys = places.select("key").distinct()
    content = classes.join(keys, "key", "left_semi").select("key", "sig", "bands").join(_sets(keys, classes, docs, width, narrow=True), "key")
    rows = places.join(stored(content, "content"), "key").withColumn("minor", F.col("label") != F.col("main"))
    place = lambda n: F.pmod(F.xxhash64("key"), n.cast("long")).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    columns = ["key", "n", "label", "sig", "bands", "members", "minor"]
    left = rows.where("minor").select("bucket", place(F.col("na")).alias("x"), upto(F.col("nb")).alias("y"), F.lit(True).alias("asks"), *columns)
    right = rows.select("bucket", upto(F.col("na")).alias("x"), place(F.col("nb")).alias("y"), F.lit(False).alias("asks"), *columns)
    fewest = fewest_matches(percent)

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        a, b = g[g["asks"]], g[~g["asks"]]
        out: list[tuple[bytes, bytes]] = []
        if len(a) and len(b):
            bucket = g["bucket"].iloc[0]
            sa, sb = _matrix(a["sig"]), _matrix(b["sig"])
            ba, bb = np.stack(a["bands"].to_numpy()), np.stack(b["bands"].to_numpy())
            ma, mb = ([np.frombuffer(m, np.uint32) for m in x["members"]] for x in (a, b))
            codes = pd.factorize(pd.concat([a["label"], b["label"]]))[0]
            la, lb = codes[: len(a)], codes[len(a) :]
            ka, kb = a["key"].to_numpy(), b["key"].to_numpy()
            order = {k: r for r, k in enumerate(sorted({*ka, *kb}))}
            ra, rb = np.array([order[k] for k in ka]), np.array([order[k] for k in kb])
            na, nb, minor = a["n"].to_numpy(), b["n"].to_numpy(), b["minor"].to_numpy()
            joined = _Parts()
            for at in range(0, len(a), 64):
                s = slice(at, at + 64)
                small, large = np.minimum(na[s, None], nb), np.maximum(na[s, None], nb)
                fit = (la[s, None] != lb) & (small * 100 >= large * percent) & (~minor | (ra[s, None] < rb))
                i, j = np.nonzero(fit)
                i, j = _passing(sa[s], sb, i, j, fewest)
                for k in range(0, len(i), 100_000):  # the first bucket that a pair shares is the one that decides it
                    ik, jk = i[k : k + 100_000], j[k : k + 100_000]
                    equal = ba[s][ik] == bb[jk]
                    own = ba[s][ik, equal.argmax(axis=1)] == bucket
                    for p, q in zip((ik[own] + at).tolist(), jk[own].tolist()):
                        rp, rq = joined.root(la[p]), joined.root(lb[q])
                        if rp != rq:
                            shared, sizes = len(np.intersect1d(ma[p], mb[q], assume_unique=True)), na[p] + nb[q]
                            if (100 + percent) * (shared + ROOM) >= percent * sizes:
                                out.append((ka[p], kb[q]))
                            if (100 + percent) * (shared - ROOM) >= percent * sizes:  # a link for certain
                                joined.up[rp] = rq
        return pd.DataFrame(out, columns=["a", "b"])

    return left.unionByName(right).groupBy("bucket", "x", "y").applyInPandas(compare, "a binary, b binary").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per document row: doc_id, text_hash, n_shingles, component_id, kept."""
    signed = stored(signatures(docs, width), "signatures")
    rep = F.min(F.struct("doc_id", "text_hash")).alias("rep")
    filled = signed.where("n_shingles > 0").groupBy("key")
    classes = stored(filled.agg(F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"), rep), "classes")
    spread = classes.select("key", "n", F.explode("bands").alias("bucket"))
    sized = spread.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = stored(spread.join(sized, "bucket"), "members")
    central = members.groupBy("key").agg(F.sum("size").alias("score"))
    ranked = members.join(central, "key")
    hubs = ranked.groupBy("bucket").agg(F.max(F.struct("score", "key", "n")).alias("hub"))
    meet = members.join(hubs, "bucket").where((F.col("hub.key") != F.col("key")) & _sizes_allow(F.col("n"), F.col("hub.n"), percent))
    pairs = meet.select(F.least("key", "hub.key").alias("a"), F.greatest("key", "hub.key").alias("b")).distinct()
    first = _confirm(_test_pairs(pairs, classes, percent), classes, docs, width, percent)
    second = _confirm(_open_links(members, components(first), classes, docs, width, percent), classes, docs, width, percent)
    labels = components(first.union(second))
    own = signed.select("doc_id", "text_hash", "n_shingles", "key").join(labels, "key", "left")
    # Empty sets link with nothing: such a document is a component of its own, by doc_id.
    own = own.withColumn("label", F.when(F.length("key") == 0, F.concat(F.lit("doc:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")).otherwise(F.coalesce("label", "key")))
    own = stored(own.drop("key"), "labelled")
    least = own.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    out = own.join(least, "label").select("doc_id", "text_hash", "n_shingles", "component_id")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, that of the smallest doc_id, with all its columns; repeated rows are one document.

    What goes is named by (doc_id, text hash), broadcast while its counted rows are few; texts move only beyond that.
    """
    marked = stored(near_duplicates(docs, width, percent).select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), "kept"), "marked")
    gone = stored(marked.where(~F.col("kept")).select("_d", "_h").distinct(), "gone")
    again = stored(marked.where("kept").groupBy("_d", "_h").count().where("count > 1").select("_d", "_h"), "again")

    def same(other: DataFrame):
        return docs["doc_id"].eqNullSafe(other["_d"]) & (F.coalesce(F.xxhash64(docs["text"]), F.lit(0)) == other["_h"])

    rows = docs.join(sized_broadcast(gone), same(gone), "left_anti")
    if again.isEmpty():
        return rows
    known = sized_broadcast(again)
    return rows.join(known, same(again), "left_anti").union(rows.join(known, same(again), "left_semi").dropDuplicates(["doc_id", "text"]))
