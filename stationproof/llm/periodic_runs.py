"""Runs of words that repeat with a period, found by string synchronising sets.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) of at least 2 q words and at least
`LEAST`, that no neighbouring word extends. All runs of a text are found, of every period:

* Small periods, below `SMALL`, are read off the text: a run of period q is a stretch of places that equal the place q before.
* Larger ones go by scales t = 4, 8, 16, …; a scale finds the periods from 3 t - 1 to below 6 t - 1. Every place has a hash of its
  next t words. Places whose next t words have a period of at most t / 3 are left out; they lie inside runs that smaller periods
  have given. A place belongs to the scale's synchronising set where its own hash, or that of the place t behind it, is the least
  of those from one to the other. So membership depends on the next 2 t words only, and any t places in a row hold a member, unless
  they start 3 t - 1 words of a period of at most t / 3. Two members whose next 2 t words are equal propose their distance as a
  period. Members with equal contexts are more than t / 3 apart, so a member has less than 18 partners within 6 t words and all of
  them are tried: a scale costs in proportion to the text.
* A run whose whole period is itself highly periodic may hold no member. There the text has two runs of the same small period that
  touch, each at least as long as the large period; those pairs of known runs propose every period that aligns them. Each such
  proposal is a run, so their number is bounded by that of the runs.

A proposal is extended to both sides by comparing words, so hashes never decide. Of several periods of one stretch the smallest
is kept. Scales end as soon as no 2 t words occur twice.

Words are runs without blank, tab, line feed, vertical tab, form feed and carriage return. Nulls, empty and blank texts have no
words and no runs. A text of any length is taken whole by the task that holds it. Repeated rows give equal results, ties can't
arise. An empty table gives an empty result. Columns named like a result column are replaced, others pass through.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationproof.llm.common import map_text, sha

#: Words of the shortest run.
LEAST = 12
#: Periods below this are read off the text.
SMALL = 11
#: First scale: its periods begin where the small ones end.
FIRST = 4
OUT = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """Well spread 64-bit hashes of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def doubled(h: np.ndarray, t: int) -> np.ndarray:
    """Hashes of 2 t words from those of t words."""
    return mix(h[:-t] * np.uint64(0x9E3779B97F4A7C15) + h[t:])


def least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` values in a row."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[: len(x) - step], x[step:])
        have += step
    return x


def small_runs(w: np.ndarray, below: int) -> list[tuple[int, int, int]]:
    """All (start, end, period) with a period under `below` and at least two periods long, divisors of the period included."""
    found = []
    for q in range(1, min(below, len(w) // 2 + 1)):
        same = np.zeros(len(w) - q + 2, np.int8)
        same[1:-1] = w[:-q] == w[q:]
        edges = np.flatnonzero(same[1:] != same[:-1])
        starts, ends = edges[::2], edges[1::2]
        long = ends - starts >= q
        found.extend((a, b + q, q) for a, b in zip(starts[long].tolist(), ends[long].tolist()))
    return found


def alike(w: np.ndarray, i: int, j: int, way: int) -> int:
    """How many words from i on equal those from j on, i < j; with way -1: words before i and before j."""
    have, step = 0, 32
    room = len(w) - j if way > 0 else i
    while have < room:
        step = min(step * 2, room - have)
        if way > 0:
            differ = w[i + have : i + have + step] != w[j + have : j + have + step]
        else:
            differ = (w[i - have - step : i - have] != w[j - have - step : j - have])[::-1]
        at = int(differ.argmax())
        if differ[at]:
            return have + at
        have += step
    return have


def members(h: np.ndarray, runs: list[tuple[int, int, int]], t: int) -> np.ndarray:
    """The synchronising set of scale t from hashes of t words and the runs of period up to t / 3."""
    key = np.minimum(mix(h), OUT - np.uint64(1))
    inside = np.zeros(len(h) + 1, np.int64)
    for a, b, q in runs:
        if 3 * q <= t <= b - a:
            inside[a] += 1
            inside[b - t + 1] -= 1
    key[np.cumsum(inside[:-1]) > 0] = OUT
    low = least(key, t + 1)
    return np.flatnonzero((low < OUT) & ((key[: len(low)] == low) | (key[t:] == low)))


def equal_contexts(at: np.ndarray, context: np.ndarray, near: int, far: int) -> list[tuple[int, int]]:
    """(distance, place) of all pairs of places with equal contexts whose distance is in [near, far)."""
    order = np.lexsort((at, context))
    at, context = at[order], context[order]
    found: list[np.ndarray] = []
    lag = 1
    while lag < len(at):
        gap = at[lag:] - at[:-lag]
        pair = (context[lag:] == context[:-lag]) & (gap < far)
        if not pair.any():
            break
        pair &= gap >= near
        found.append(np.column_stack((gap[pair], at[:-lag][pair])))
        lag += 1
    pairs = np.concatenate(found) if found else np.empty((0, 2), np.int64)
    return list(map(tuple, pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))].tolist()))


class Stretches:
    """Maximal stretches by period, from proposals of a period at a place."""

    def __init__(self, w: np.ndarray):
        self.w, self.found = w, {}

    def propose(self, q: int, i: int) -> None:
        known = self.found.setdefault(q, [])
        if known and known[-1][0] <= i and i + q < known[-1][1]:
            return
        a = i - alike(self.w, i, i + q, -1)
        b = i + q + alike(self.w, i, i + q, 1)
        if b - a >= 2 * q:
            known.append((a, b))

    def runs(self) -> list[tuple[int, int, int]]:
        return [(a, b, q) for q, stretches in self.found.items() for a, b in set(stretches)]


def touching(runs: list[tuple[int, int, int]], w: np.ndarray, out: Stretches) -> None:
    """Propose the periods that align two touching runs of the same period."""
    by_period: dict[int, list[tuple[int, int]]] = {}
    for a, b, q in runs:
        if b - a >= 8 * q:
            by_period.setdefault(q, []).append((a, b))
    for q, spans in by_period.items():
        spans.sort()
        for (a, b), (c, d) in zip(spans, spans[1:]):
            if c > b:
                continue
            last = w[b - q : b]
            for shift in range(q):
                if (w[c + shift : c + shift + q] == last).all():
                    # A period p aligns the runs where p is c + shift - (b - q), give or take whole q.
                    first = c + shift - (b - q)
                    for p in range(first % q, min(b - a, d - c, (d - a) // 2) + 1, q):
                        at = max(a, c - p)
                        if p >= SMALL and at < min(b, d - p):
                            out.propose(p, at)
                    break


def smallest(runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of the periods of one stretch the smallest."""
    best: dict[tuple[int, int], int] = {}
    for a, b, q in runs:
        best[a, b] = min(q, best.get((a, b), q))
    return sorted((a, b, q) for (a, b), q in best.items())


def find_runs(w: np.ndarray) -> list[tuple[int, int, int]]:
    """All (start, end, period) of runs of at least two periods in an array of word numbers, by start, end."""
    runs = smallest(small_runs(w, SMALL))
    h = mix(w.astype(np.uint64) + np.uint64(1))
    t = 1
    while t < FIRST and len(h) > t:
        h, t = doubled(h, t), 2 * t
    while 2 * (3 * t - 1) <= len(w):
        context = doubled(h, t)
        ordered = np.sort(context)
        if not (ordered[1:] == ordered[:-1]).any():
            break
        at = members(h, runs, t)
        out = Stretches(w)
        for q, i in equal_contexts(at, context[at], 3 * t - 1, 6 * t - 1):
            out.propose(q, i)
        runs = smallest(runs + out.runs())
        h, t = context, 2 * t
    out = Stretches(w)
    touching(runs, w, out)
    return smallest(runs + out.runs())


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def text_runs(ws: list[bytes], at_least: int = LEAST) -> list[tuple[int, int, int]]:
    """All (start, length, period) of runs of at least so many words, by start, then period."""
    if len(ws) < max(at_least, 2):
        return []
    number: dict[bytes, int] = {}
    w = np.fromiter((number.setdefault(x, len(number)) for x in ws), np.int64, len(ws))
    if len(number) == len(ws):
        return []
    return sorted((a, b - a, q) for a, b, q in find_runs(w) if b - a >= at_least)


def collapse(ws: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, of each run the first period only."""
    if not runs:
        return b" ".join(ws)
    drop = np.zeros(len(ws) + 1, np.int64)
    for a, n, q in runs:
        drop[a + q] += 1
        drop[a + n] -= 1
    kept = np.flatnonzero(np.cumsum(drop[:-1]) == 0)
    return b" ".join([ws[i] for i in kept.tolist()])


def find(docs: DataFrame, text_col: str = "text", at_least: int = LEAST, keep: list[str] | None = None) -> DataFrame:
    """Add `n_words`, `runs` (array of start, length, period; by start, then period) and `collapsed`, the text without repeats."""

    def make():
        def run(texts: list) -> dict[str, pa.Array]:
            counts, ends, flat, collapsed = [], [0], [], []
            for text in texts:
                ws = words(text)
                runs = text_runs(ws, at_least)
                counts.append(len(ws))
                flat.extend(runs)
                ends.append(len(flat))
                collapsed.append(collapse(ws, runs).decode("utf-8", "surrogatepass"))
            columns = [pa.array([r[k] for r in flat], pa.int64()) for k in range(3)]
            structs = pa.StructArray.from_arrays(columns, ["start", "length", "period"])
            return {
                "n_words": pa.array(counts, pa.int64()),
                "runs": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs),
                "collapsed": pa.array(collapsed, pa.string()),
            }

        return run

    return map_text(docs, make, "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string", text_col, keep)


def planted(doc_id: int | None, ws: list[bytes]) -> list[bytes]:
    """The words of a document as the query's contract rewrites them: every tenth document, by crc32 of its id, ends periodically."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(ws), h // 10
    if h % 10 or not n:
        return ws
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return ws[:a] + [ws[a + (i - a) % p] for i in range(a, n)]


def plant(docs: DataFrame) -> DataFrame:
    """doc_id and text with the query's repeats; a document without id stays as it is."""
    narrow = docs.select("doc_id", F.struct("doc_id", "text").alias("both"))

    def make():
        def run(rows: list) -> dict[str, pa.Array]:
            texts = []
            for r in rows:
                h = zlib.crc32(str(r["doc_id"]).encode()) if r["doc_id"] is not None else 1
                texts.append(r["text"] if h % 10 else b" ".join(planted(r["doc_id"], words(r["text"]))).decode("utf-8", "surrogatepass"))
            return {"text": pa.array(texts, pa.string())}

        return run

    return map_text(narrow, make, "text string", "both", ["doc_id"])


def report(found: DataFrame) -> DataFrame:
    """One row a document: number of runs, the longest one (ties: smallest start, then period) and digests."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("q"))))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("best"), sha(F.array_join(line, "")).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"))
    return best.select(
        "doc_id",
        "n_runs",
        (-F.col("best.s")).alias("start"),
        F.col("best.l").alias("length"),
        (-F.col("best.q")).alias("period"),
        F.expr("1000 * best.l div -best.q").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )
