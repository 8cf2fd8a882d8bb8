"""Resampling of documents towards a target distribution by importance weights of hashed word features.

Features are all runs of 1 to `longest` consecutive words, repeats counted; a feature's bucket is the crc32 of its bytes modulo the
number of buckets. Two passes: the first counts features by bucket, in one array a task, and adds the tasks' arrays by bucket; the
second looks every feature's gain up in the array of whole-number log-ratios of target and source and sums them. A document's score
is its weight plus a Gumbel draw made from its id and the seed, so the best scores are a sample without replacement in which
weights count as log-probabilities. Scores are written once, to the session's shared folder.

Which documents are drawn is decided by one cutoff. A mergeable quantile sketch brackets it; exact counts above and inside the
bracket then tell whether the cutoff lies in it, and widen it where it doesn't. Only the rows inside are sorted to find
the cutoff itself; rows above it are drawn whatever their order. The drawn rows are numbered by ranges of their order.

Order: score, highest first, then doc_id, smallest first and null before all, then the row's place in the written table; so rows of equal score
and id (copies of one row) have ranks of their own, and which of them gets which makes no difference to the columns `report` returns.
Null, empty and wordless texts have no features, weight 0 and never enough words to be drawn. A null doc_id draws with
an empty id. Texts of any length are counted whole. An empty table gives an empty result; an empty target gives every bucket the gain of no
occurrence. Columns named like a result column are replaced, others pass through unread.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationproof.functions.scan import global_rank
from stationproof.llm.common import bounded_batches, fresh, letter_words, map_text, quoted, stored

#: Buckets of the feature hash, words of the longest feature, seed of the draw.
BUCKETS, LONGEST, SEED = 10_000, 1, 2024
#: Words that a document needs to be drawn, and hundredths of those documents that are drawn.
LEAST_WORDS, PERCENT = 20, 10
#: Accuracy of the quantile sketch; the bracket begins with twice its error to either side.
ACCURACY = 10_000
RESULT = "n_features long, n_words long, weight long, score long"


def features(words: list[bytes], longest: int) -> list[bytes]:
    out = list(words)
    for k in range(2, longest + 1):
        out.extend(b" ".join(words[i : i + k]) for i in range(len(words) - k + 1))
    return out


def buckets_of(words: list[bytes], longest: int, buckets: int) -> np.ndarray:
    found = features(words, longest)
    return np.fromiter(map(crc32, found), np.int64, len(found)) % buckets


def bucket_counts(df: DataFrame, text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """Features by bucket over all texts. Each task gives its non-zero counts; the driver gets one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts += np.bincount(buckets_of(letter_words(text), longest, buckets), minlength=buckets)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used], pa.int64())], names=["bucket", "n"])

    bounded_batches(df)
    parts = df.select(F.col(quoted(text_col)).alias("text")).mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of each bucket's smoothed log-ratio of target and source, rounded down."""
    size, all_source, all_target = len(source), int(source.sum()), int(target.sum())
    ratio = ((t + 1.0) * (all_source + size) / ((s + 1.0) * (all_target + size)) for s, t in zip(source.tolist(), target.tolist()))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def gumbel(doc_id, seed: int) -> int:
    """Thousandths of a Gumbel draw that depends on the id and the seed only."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: np.ndarray, text_col: str = "text", id_col: str = "doc_id", longest: int = LONGEST, seed: int = SEED, keep: list[str] | None = None) -> DataFrame:
    """Add n_features, n_words, weight and score."""
    table, size = gain, len(gain)
    both = fresh(docs, "id_and_text")
    source = docs.select("*", F.struct(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text")).alias(both))

    def make():
        def run(rows: list) -> dict[str, pa.Array]:
            out: list[tuple[int, int, int, int]] = []
            for r in rows:
                words = letter_words(r["text"])
                places = buckets_of(words, longest, size)
                weight = int(table[places].sum())
                out.append((len(places), len(words), weight, weight + gumbel(r["id"], seed)))
            return {n: pa.array([o[k] for o in out], pa.int64()) for k, n in enumerate(("n_features", "n_words", "weight", "score"))}

        return run

    return map_text(source, make, RESULT, both, docs.columns if keep is None else keep)


def bracket(scores: DataFrame, col: str, n: int, k: int) -> tuple[int, int, int]:
    """(low, high, rows above high): an exact bracket of the k-th highest of n values.

    The sketch proposes; the counts of rows above and inside decide, and a bracket that misses is widened.
    """
    margin = 2 / ACCURACY + 1 / n
    while True:
        ask = [max(0.0, 1 - k / n - margin), min(1.0, 1 - k / n + margin)]
        low, high = scores.agg(F.percentile_approx(col, ask, ACCURACY)).first()[0]
        ends = scores.agg(F.min(col), F.max(col)).first()
        low, high = (ends[0] if ask[0] == 0 else low), (ends[1] if ask[1] == 1 else high)
        above, inside = scores.agg(F.count_if(F.col(col) > high), F.count_if(F.col(col).between(low, high))).first()
        if above < k <= above + inside:
            return low, high, above
        margin *= 8


def draw(weighed: DataFrame, id_col: str = "doc_id", percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Add `rank`: 1, 2, 3, … of the drawn documents, null for the others.

    Drawn are floor(percent / 100) of the documents of at least `least_words` words, the highest scores.
    """
    own = [F.col(quoted(c)) for c in weighed.columns if c.lower() != "rank"]
    able = (F.col("n_words") >= least_words).alias("able")
    place = F.monotonically_increasing_id().alias("place")
    scored = stored(weighed.select(F.struct(*own).alias("row"), able, F.col("score").alias("best"), F.col(quoted(id_col)).alias("id"), place), "weighed")
    able = scored.where("able")
    n = able.count()
    k = n * percent // 100
    if not k:
        return scored.select("row.*", F.lit(None).cast("long").alias("rank"))
    order = [F.col("best").desc(), F.col("id").asc_nulls_first(), F.col("place")]
    low, high, above = bracket(able.select("best"), "best", n, k)
    inside = able.where(F.col("best").between(low, high)).select("best", "id", "place")
    last = global_rank(inside, order, "at").where(F.col("at") == k - above).first()
    same_id = F.col("id").eqNullSafe(F.lit(last["id"]))
    before_id = F.lit(False) if last["id"] is None else F.col("id").isNull() | (F.col("id") < F.lit(last["id"]))
    upto = (F.col("best") > last["best"]) | ((F.col("best") == last["best"]) & (before_id | (same_id & (F.col("place") <= last["place"]))))
    drawn = F.col("able") & F.coalesce(upto, F.lit(False))
    ranked = global_rank(scored.where(drawn), order, "rank").select("row.*", "rank")
    return ranked.union(scored.where(~drawn).select("row.*", F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS, keep: list[str] | None = None) -> DataFrame:
    """All documents with their weight, score and rank; `target` holds the texts to be like, both in a column `text`."""
    gain = gains(bucket_counts(docs, longest=longest, buckets=buckets), bucket_counts(target, longest=longest, buckets=buckets))
    return draw(weigh(docs, gain, longest=longest, seed=seed, keep=keep), percent=percent, least_words=least_words)


def report(resampled: DataFrame) -> DataFrame:
    return resampled.select("doc_id", "n_features", "weight", "score", "rank")
