"""Benchmark decontamination: word windows of test items, looked up in a broadcast hash set, verified, and removed.

Words are lower-cased (A-Z) runs of ASCII digits, letters and non-ASCII characters. An item gives every window of `n`
consecutive words; an item of fewer words, but not none, is one window. A document word is hit when it lies inside an
occurrence of a window. Only built-in functions run: each document's words are split once, every window length that occurs
becomes an array of 64-bit window hashes (exploded as outer, so that the planner repeats none of this in a filter), and one generator row a window meets the broadcast hash set in the same stage; a
hash hit counts only when the words agree. What reaches the one shuffle is a row a document and partial sets of its hits.

The set of windows is broadcast only while its counted rows stay under `BROADCAST_WINDOWS`; beyond it, the planner joins by
shuffle and splits skewed windows.

Null and empty texts have no words and are clean; items without words are ignored; a null doc_id or item_id is a value like
any other, but null item_ids are not listed. Repeated document rows each get their result; repeated items count once by id.
Empty tables give empty or all-clean results. Only the named columns are read; results carry other columns through a join on
(doc_id, text hash), so extra columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationproof.functions.columns import sized_broadcast
from stationproof.llm.common import stored

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A window's row is its hash, its words and a set id: about 200 bytes, so at most some 100 MB are broadcast.
BROADCAST_WINDOWS = 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """A-Z in lower case, other characters as they are; null for null."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """Words of a text in order; an empty array for null."""
    return F.coalesce(F.array_remove(F.split(lowered(text), GAP), ""), F.array().cast("array<string>"))


def _starts(n: Column, k: int) -> Column:
    return F.when(n >= k, F.sequence(F.lit(1), n - (k - 1))).otherwise(F.array().cast("array<int>"))


def _hashes(column: str, n: Column, k: int) -> Column:
    return F.transform(_starts(n, k), lambda i: F.xxhash64(F.slice(F.col(column), i, k)))


def windows(items: DataFrame, n: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row for each distinct window: k, h (hash), w (its words), set_id and the items that hold it."""
    split = items.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("ws")).where(F.size("ws") > 0)
    sized = split.withColumn("k", F.least(F.size("ws"), F.lit(n)))
    at = F.explode_outer(F.sequence(F.lit(1), F.size("ws") - F.col("k") + 1)).alias("i")
    each = sized.select("item", "ws", "k", at).select("item", "k", F.slice("ws", F.col("i"), F.col("k")).alias("w"))
    held = each.groupBy("k", "w").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return held.select("k", F.xxhash64("w").alias("h"), "w", F.sha2(F.to_json("items"), 256).alias("set_id"), "items")


def hits(docs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """Per document row: doc_id, text_hash, n_words, spans (sorted (start, length) of occurrences), items (sorted ids)."""
    known = windows(items, n).persist()
    lengths = {r.k: r.c for r in known.groupBy("k").agg(F.count("*").alias("c")).orderBy("k").collect()}  # at most n rows
    small = sum(lengths.values()) <= BROADCAST_WINDOWS
    lookup = known.select("k", "h", "w", "set_id")
    sets = known.groupBy("set_id").agg(F.first("items").alias("items"))

    base = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("ws"))
    base = base.withColumn("n_words", F.size("ws"))
    count, ends, total = F.col("n_words"), [], F.lit(0)
    for k in lengths:
        total = total + F.greatest(count - (k - 1), F.lit(0))
        ends.append((k, total))
    hashed = base.withColumn("hs", F.concat(F.array(F.lit(0).cast("long")), *[_hashes("ws", count, k) for k in lengths]))
    spread = hashed.select("doc_id", "text_hash", "n_words", "ws", F.posexplode_outer("hs").alias("p", "h"))
    length, start = F.lit(None).cast("int"), F.lit(None).cast("int")
    for (k, end), before in reversed(list(zip(ends, [F.lit(0), *[e for _, e in ends]]))):
        length = F.when(F.col("p") <= end, F.lit(k)).otherwise(length)
        start = F.when(F.col("p") <= end, F.col("p") - before - 1).otherwise(start)

    mark = spread.alias("d")
    other = (F.broadcast(lookup) if small else lookup).alias("t")
    same = (F.col("d.h") == F.col("t.h")) & (F.col("d.p") > 0) & (F.slice(F.col("d.ws"), start + 1, F.col("t.k")) == F.col("t.w")) & (F.col("t.k") == length)
    found = mark.join(other, same, "left").where((F.col("p") == 0) | F.col("set_id").isNotNull())
    found = found.select("doc_id", "text_hash", "n_words", "p", start.alias("start"), length.alias("k"), "set_id")
    doc = found.groupBy("doc_id", "text_hash").agg(
        F.count(F.when(F.col("p") == 0, 1)).alias("copies"),
        F.max("n_words").cast("long").alias("n_words"),
        F.sort_array(F.collect_set(F.when(F.col("set_id").isNotNull(), F.struct("start", "k")))).alias("spans"),
        F.collect_set("set_id").alias("set_ids"),
    )
    named = doc.select("*", F.explode_outer("set_ids").alias("set_id")).join(F.broadcast(sets) if small else sets, "set_id", "left")
    per = named.groupBy("doc_id", "text_hash").agg(
        F.first("copies").alias("copies"), F.first("n_words").alias("n_words"), F.first("spans").alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return per.select("doc_id", "text_hash", "n_words", "spans", "items", F.explode(F.expr("array_repeat(0, int(copies))")).alias("_copy")).drop("_copy")


def covered(spans: Column) -> Column:
    """Words inside the union of sorted (start, k) spans."""
    zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("end"))

    def add(acc, s):
        end = s["start"] + s["k"]
        return F.struct((acc["total"] + F.greatest(end - F.greatest(s["start"], acc["end"]), F.lit(0))).alias("total"), F.greatest(end, acc["end"]).alias("end"))

    return F.aggregate(spans, zero, add, lambda acc: acc["total"])


def report(docs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """Counts and item lists of every document row."""
    h = hits(docs, items, n).withColumn("n_hit", covered(F.col("spans")))
    listed = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return h.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), listed.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def _found(docs: DataFrame, items: DataFrame, n: int) -> tuple[DataFrame, Column]:
    """Documents with hits, broadcast while their counted rows are few, and the condition that joins them to `docs`."""
    spans = hits(docs, items, n).where(F.size("spans") > 0).groupBy(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")).agg(F.first("spans").alias("_s"))
    found = stored(spans, "hits")
    return sized_broadcast(found), docs["doc_id"].eqNullSafe(found["_d"]) & (F.xxhash64(docs["text"]) == found["_h"])


def remove_documents(docs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """The documents without any hit, with all their columns."""
    found, same = _found(docs, items, n)
    return docs.join(found, same, "left_anti")


def remove_spans(docs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """All documents; hit words are cut from `text` together with the gap before each."""
    found, same = _found(docs, items, n)
    joined = docs.join(found, same, "left")
    gap, letter = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    parts = F.regexp_extract_all(docs["text"], F.lit(f"{gap}*{letter}+"), F.lit(0))
    left = F.filter(parts, lambda _, i: ~F.exists(found["_s"], lambda s: (i >= s["start"]) & (i < s["start"] + s["k"])))
    tail = F.regexp_extract(docs["text"], f"({gap}*)$", 1)
    text = F.when(found["_s"].isNull(), docs["text"]).otherwise(F.concat(F.array_join(left, ""), tail))
    return joined.select(*[text.alias("text") if c == "text" else docs[f"`{c}`"] for c in docs.columns])
