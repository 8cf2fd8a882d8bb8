"""Secret scans: three fixed kinds, and character Markov models of random strings and ordinary identifiers.

Base kinds are leftmost, non-overlapping matches of a pattern. The method looks at runs of key characters of `MIN_RUN` and
more that overlap no base span, and reports those that a bigram model of random strings explains better than one of ordinary
identifiers by a log-likelihood ratio of at least `MIN_LLR` nats in all and `MEAN_LLR` a transition. Both models are trained
from labelled samples: strings with a flag. `samples` labels a corpus with its own base kinds alone: their values are random,
other long runs are ordinary. `learn` trains for a corpus: the random side holds, in equal parts, the corpus' base values and
keys drawn over each of `DRAWN` by a digest; the ordinary side all identifiers of the corpus of any length that touch no base
span, but for long runs that a first model, trained without long runs, already calls random. The models are two tables over
pairs of 67 characters, whatever the corpus, so the driver may hold them; partial sums fill them from every document.

Only built-in functions run. Offsets are code points. A null text counts as empty and has no spans; repeated rows get equal
results; texts of any length are scanned whole (offsets are summed in runs, so the work stays linear). Without samples of
either sort the ratio is zero and the method adds nothing. Other columns pass through; one named like a result is replaced.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stationproof.llm.common import stored, without

# Kinds in their order, patterns, the group that must have the length, the length.
KINDS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]{14,}", 0, 18),
    "hex": (r"(?<![0-9a-f])[0-9a-f]{16,}", 0, 16),
}
METHOD = "markov"
ORDER = [*KINDS, METHOD]
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
MIN_RUN, MIN_LLR, MEAN_LLR = 20, 12.0, 0.5
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % MIN_RUN
#: Identifiers of any length that touch no `GAP`, which stands for a base span.
GAP = "\uffff"
WORD = rf"(?<![A-Za-z0-9+/_=-]|{GAP})[A-Za-z0-9+/_=-]{{2,}}+(?!{GAP})"
#: Alphabets of drawn keys, and how many keys of `KEY` characters each gives.
LOWER, UPPER, DIGITS = ALPHABET[26:52], ALPHABET[:26], ALPHABET[52:62]
DRAWN = {
    "hex": DIGITS + "abcdef",
    "HEX": DIGITS + "ABCDEF",
    "base32": UPPER + "234567",
    "base36": LOWER + DIGITS,
    "BASE36": UPPER + DIGITS,
    "base62": UPPER + LOWER + DIGITS,
    "base64": UPPER + LOWER + DIGITS + "+/",
    "base64url": UPPER + LOWER + DIGITS + "-_",
}
KEYS, KEY = 8_000, 32
#: Weight of each unseen pair in the models.
PRIOR = 0.5
CHUNK = 512
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _places(gaps: Column, matches: Column) -> Column:
    """(start, end) of each match, from the texts between and in the matches: chunks first, so that arrays stay short."""
    steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("len")))
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def within(pos, chunk):
        def add(acc, s):
            start = acc["pos"] + s["gap"]
            place = F.array(F.struct(start.alias("start"), (start + s["len"]).alias("end")))
            return F.struct((start + s["len"]).alias("pos"), F.concat(acc["out"], place).alias("out"))

        return F.aggregate(chunk, F.struct(pos.alias("pos"), empty.alias("out")), add, lambda acc: acc["out"])

    def next_chunk(acc, chunk):
        whole = F.aggregate(chunk, F.lit(0), lambda n, s: n + s["gap"] + s["len"])
        return F.struct((acc["pos"] + whole).alias("pos"), F.concat(acc["out"], F.array(within(acc["pos"], chunk))).alias("out"))

    def chunks(all_steps):
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(all_steps) - 1) / CHUNK).cast("int")), lambda c: F.slice(all_steps, c * CHUNK + 1, F.lit(CHUNK)))

    bound = F.element_at(F.transform(F.array(steps), chunks), 1)
    zero = F.struct(F.lit(0).alias("pos"), F.array().cast("array<array<struct<start:int,end:int>>>").alias("out"))
    return F.flatten(F.aggregate(bound, zero, next_chunk, lambda acc: acc["out"]))


def _found(text: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    """Spans of one pattern whose group has the length, with the group's text."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = matches if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    made = F.zip_with(
        _places(F.split(text, pattern, -1), matches), values,
        lambda p, v: F.struct(p["start"].alias("start"), F.lit(kind).alias("kind"), p["end"].alias("end"), v.alias("value")),
    )
    return F.when(F.rlike(text, F.lit(pattern)), F.filter(made, lambda s: F.length(s["value"]) >= least)).otherwise(F.array().cast(SPAN)).cast(SPAN)


def _scan(docs: DataFrame, text_col: str) -> DataFrame:
    """Base spans `__base` in order, and `__runs`, long runs of key characters that overlap none of them."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    base = F.concat(*[_found(text, k, *rule) for k, rule in enumerate(KINDS.values())])
    scanned = docs.select("*", F.array_sort(base).alias("__base"), _found(text, len(KINDS), RUN, 0, MIN_RUN).alias("__all"))
    clear = F.filter("__all", lambda r: ~F.exists("__base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    return scanned.withColumn("__runs", F.when(F.size("__base") == 0, F.col("__all")).otherwise(clear)).drop("__all")


def samples(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Labelled strings of a corpus: value, random."""
    scanned = _scan(docs.select(text_col), text_col)
    pick = lambda c, flag: F.transform(c, lambda s: F.struct(s["value"].alias("value"), F.lit(flag).alias("random")))
    return scanned.select(F.explode_outer(F.concat(pick("__base", True), pick("__runs", False))).alias("s")).where("s IS NOT NULL").select("s.value", "s.random")


def drawn(spark: SparkSession) -> DataFrame:
    """Keys over each alphabet of `DRAWN`, the same each time: value, source."""
    digest = F.sha2(F.concat_ws(":", "source", "id").cast("binary"), 512)  # four hex digits a character
    number = lambda i: F.conv(F.substring(digest, i * 4 + 1, F.lit(4)), 16, 10).cast("int")
    sources = F.explode(F.array(*[F.struct(F.lit(k).alias("source"), F.lit(v).alias("letters")) for k, v in DRAWN.items()])).alias("a")
    rows = spark.range(KEYS).select("id", sources).select("id", "a.source", "a.letters")
    letter = lambda i: F.substring("letters", number(i) % F.length("letters") + 1, F.lit(1))
    return rows.select(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(KEY - 1)), letter), "").alias("value"), "source")


def vocabulary(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Distinct base values (random) and identifiers that touch none (not random), with their number: value, random, n."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    found = docs.select(text.alias("text"), F.array_sort(F.concat(*[_found(text, k, *rule) for k, rule in enumerate(KINDS.values())])).alias("base"))
    left = F.when(F.size("base") > 0, _replaced(F.col("text"), F.col("base"), GAP)).otherwise(F.col("text"))
    words = F.transform(F.regexp_extract_all(left, F.lit(WORD), F.lit(0)), lambda w: F.struct(w.alias("value"), F.lit(False).alias("random")))
    values = F.transform("base", lambda s: F.struct(s["value"].alias("value"), F.lit(True).alias("random")))
    return found.select(F.explode(F.concat(values, words)).alias("s")).groupBy("s.value", "s.random").agg(F.count("*").alias("n"))


def learn(docs: DataFrame, text_col: str = "text") -> list[float]:
    """The table of `train` for a corpus."""
    known = stored(vocabulary(docs, text_col), "identifiers").withColumn("source", F.lit("corpus"))
    labelled = known.unionByName(drawn(docs.sparkSession).withColumns({"random": F.lit(True), "n": F.lit(1).cast("long")}))
    first = train(labelled.where(F.col("random") | (F.length("value") < MIN_RUN)))
    return train(labelled.where(F.col("random") | (F.length("value") < MIN_RUN) | ~_random(F.col("value"), first)))


def train(labelled: DataFrame) -> list[float]:
    """Log ratio of the two models for each pair of characters, row by row of the alphabet.

    A column `n` counts a string so many times; with a column `source`, those of one label weigh the same in all.
    """
    n = F.col("n") if "n" in labelled.columns else F.lit(1)
    source = F.col("source") if "source" in labelled.columns else F.lit("")
    chars = F.split("value", "")
    pairs = F.zip_with(F.slice(chars, F.lit(1), F.size(chars) - 1), F.slice(chars, F.lit(2), F.size(chars) - 1), lambda x, y: F.concat(x, y))
    rows = labelled.where(F.length("value") > 1).select("random", source.alias("source"), n.alias("n"), F.explode(pairs).alias("pair"))
    counted = rows.groupBy("random", "source", "pair").agg(F.sum("n").alias("n"))
    a = len(ALPHABET)
    counts = {True: [PRIOR] * (a * a), False: [PRIOR] * (a * a)}
    seen = sorted(counted.where(F.col("pair").rlike(f"^[{ALPHABET}]{{2}}$".replace("=-", "=\\-"))).collect())  # at most 67 x 67 rows a label and source
    whole = Counter()
    for r in seen:
        whole[r.random, r.source] += r.n
    most = {k: max(v for (random, _), v in whole.items() if random == k) for k, _ in whole}
    for r in seen:
        counts[r.random][ALPHABET.index(r.pair[0]) * a + ALPHABET.index(r.pair[1])] += r.n * most[r.random] / whole[r.random, r.source]
    if len(most) < 2:
        return [0.0] * (a * a)
    out = []
    for c in range(a):
        rows = {k: counts[k][c * a : c * a + a] for k in counts}
        sums = {k: sum(rows[k]) for k in rows}
        out += [math.log(x / sums[True]) - math.log(y / sums[False]) for x, y in zip(rows[True], rows[False])]
    return out


def ratio(value: Column, table: list[float]) -> Column:
    """Log-likelihood ratio of a string: random against ordinary."""
    a = len(ALPHABET)
    ratios = F.array(*[F.lit(x) for x in table])
    codes = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c))

    def total(cs):
        at = lambda i: F.element_at(ratios, (F.element_at(cs, i) - 1) * a + F.element_at(cs, i + 1))
        return F.aggregate(F.sequence(F.lit(1), F.size(cs) - 1), F.lit(0.0), lambda s, i: s + F.coalesce(at(i), F.lit(0.0)))

    return F.element_at(F.transform(F.array(F.filter(codes, lambda c: c > 0)), total), 1)


def _random(value: Column, table: list[float]) -> Column:
    score = ratio(value, table)
    return (score >= MIN_LLR) & (score >= MEAN_LLR * (F.length(value) - 1))


def scan(docs: DataFrame, table: list[float], text_col: str = "text", out: str = "found") -> DataFrame:
    """All columns, and `out`: spans (start, kind, end, value) by start, then kind; kinds count from 0 in `ORDER`."""
    scanned = _scan(without(docs, out), text_col)
    extra = F.when(F.size("__runs") > 0, F.filter("__runs", lambda r: _random(r["value"], table))).otherwise(F.array().cast(SPAN))
    return scanned.withColumn(out, F.array_sort(F.concat("__base", extra))).drop("__base", "__runs")


def _named(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in ORDER])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, table: list[float]) -> DataFrame:
    """Counts by kind, a digest of the base spans and all spans of each document."""
    found = scan(docs.select("doc_id", "text"), table)
    of = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    base = _named(F.filter("found", lambda s: s["kind"] < len(KINDS)))
    return found.select("doc_id", *[of(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(base.cast("binary"), 256).alias("base_sha256"), _named(F.col("found")).alias("spans"))


def _replaced(text: Column, spans: Column, put: str) -> Column:
    """The text with every span replaced; overlapping spans count as one."""
    zero = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("end"))

    def cut(acc, s):
        gap = F.when(s["start"] >= acc["end"], F.array(text.substr(acc["end"] + 1, s["start"] - acc["end"]), F.lit(put))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.concat(acc["parts"], gap).alias("parts"), F.greatest(acc["end"], s["end"]).alias("end"))

    return F.aggregate(spans, zero, cut, lambda acc: F.concat(F.array_join(acc["parts"], ""), text.substr(acc["end"] + 1, F.length(text))))


def redact(docs: DataFrame, table: list[float], put: str = "[secret]", text_col: str = "text") -> DataFrame:
    """Documents with every span of `text` replaced by `put`; overlapping spans count as one."""
    found = scan(docs, table, text_col, "__found")
    text = F.col(f"`{text_col}`")
    new = F.when(F.size("__found") > 0, _replaced(text, F.col("__found"), put)).otherwise(text)
    return found.select(*[new.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
