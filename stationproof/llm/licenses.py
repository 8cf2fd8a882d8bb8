"""License scans: exact phrases by word, and fuzzy short notices by exact seeds and bounded-error matching.

A text becomes its words (lower-cased A-Z, runs of digits, letters and non-ASCII characters) joined by one blank. A notice of
L characters may differ by up to k = L // 15 edits. Cut into k + 1 parts, at least one part must then stand exactly in any
match, so an automaton over all parts finds every candidate place. The time of matching grows steeply with k, so a candidate is first counted:
of 2 k + 2 parts, k + 2 must stand exactly, each at most k places from where it belongs. The regex library's bounded-error matching
decides what is left and gives span and edits. Work on a text is linear but for windows of length L + 3k around seeds, so texts are taken whole.

A null or empty text has no words, no places and no labels, and the score 0. Repeated rows get equal results. Places of a
phrase may overlap and each counts. Other columns pass through; one named like a result column is replaced.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationproof.llm.common import letter_words, map_text

# Base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Short notices of public licenses, as words, and their labels.
NOTICES = {
    "this work is licensed under the gnu general public license": "gpl",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "licensed under the apache license version 2 0": "apache",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "licensed under a creative commons attribution": "cc-by",
    "licensed under cc by nc": "cc-by-nc",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
}
RESULT = (
    "n_words long, places array<struct<label:string,word:long>>, "
    "notices array<struct<label:string,first_word:long,last_word:long,edits:int,similarity:double>>"
)


def edits_allowed(notice: str) -> int:
    return len(notice) // 15


def parts(notice: str, n: int) -> list[tuple[int, str]]:
    """n parts of nearly equal length with their offsets."""
    cuts = [len(notice) * i // n for i in range(n + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


class Scanner:
    """Seeds and verifying patterns of a set of notices."""

    def __init__(self, phrases: dict[str, str], notices: dict[str, str]):
        import ahocorasick
        import regex

        self.phrases, self.notices = phrases, notices
        self.seeds = ahocorasick.Automaton()
        by_seed: dict[str, list] = {}
        for notice in notices:
            for offset, seed in parts(notice, edits_allowed(notice) + 1):
                by_seed.setdefault(seed, []).append((notice, offset, len(seed)))
        for seed, uses in by_seed.items():
            self.seeds.add_word(seed, uses)
        if by_seed:
            self.seeds.make_automaton()
        self.patterns = {n: regex.compile(f"(?b)(?:{regex.escape(n, literal_spaces=True)}){{e<={edits_allowed(n)}}}") for n in notices}
        self.small = {n: parts(n, 2 * edits_allowed(n) + 2) for n in notices}
        self.ready = bool(by_seed)

    def exact(self, line: str) -> list[dict]:
        """Places of the phrases in `line`, words joined by blanks with a blank at both ends."""
        out = []
        for phrase, label in self.phrases.items():
            at = line.find(f" {phrase} ")
            word = seen = 0
            while at >= 0:
                word += line.count(" ", seen, at)
                seen = at
                out.append({"label": label, "word": word})
                at = line.find(f" {phrase} ", at + 1)
        return sorted(out, key=lambda p: (p["word"], p["label"]))

    def likely(self, notice: str, line: str, at: int) -> bool:
        """Whether enough small parts of a notice stand in `line` about where a match that begins near `at` has them."""
        k = edits_allowed(notice)
        need = left = k + 2
        spare = len(self.small[notice]) - need
        for offset, part in self.small[notice]:
            place = at + offset
            if line.find(part, max(place - k, 0), max(place + k + len(part), 0)) >= 0:
                left -= 1
                if not left:
                    return True
            else:
                spare -= 1
                if spare < 0:
                    return False
        return False

    def fuzzy(self, line: str) -> list[dict]:
        """Notices in `line` (as above) within their edits."""
        starts: dict[str, set[int]] = {}
        if self.ready:
            for end, uses in self.seeds.iter(line):
                for notice, offset, size in uses:
                    starts.setdefault(notice, set()).add(end - size + 1 - offset)
        out = []
        for notice, found in starts.items():
            k, done = edits_allowed(notice), -1
            for at in sorted(found):
                if not self.likely(notice, line, at):
                    continue
                begin, stop = max(at - k, 0), min(at + len(notice) + 2 * k, len(line))
                m = self.patterns[notice].search(line, max(begin, done), stop)
                if m and m.end() > m.start():
                    done = m.end()
                    text = m.group().strip()
                    first = line.count(" ", 0, m.start() + len(m.group()) - len(m.group().lstrip())) - 1
                    edits = sum(m.fuzzy_counts)
                    similarity = 1 - edits / len(notice)
                    out.append({"label": self.notices[notice], "first_word": max(first, 0), "last_word": max(first, 0) + text.count(" "), "edits": edits, "similarity": similarity})
        return sorted(out, key=lambda n: (n["first_word"], n["label"], n["edits"]))


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add n_words, `places` of exact phrases and fuzzy `notices`; words count from 0."""
    phrases, notices = PHRASES if phrases is None else phrases, NOTICES if notices is None else notices
    place = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
    notice = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32()), ("similarity", pa.float64())]))

    def make():
        scanner = Scanner(phrases, notices)

        def run(texts: list) -> dict[str, pa.Array]:
            counts, exact, fuzzy = [], [], []
            for t in texts:
                words = letter_words(t)
                line = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
                counts.append(len(words))
                exact.append(scanner.exact(line))
                fuzzy.append(scanner.fuzzy(line))
            return {"n_words": pa.array(counts, pa.int64()), "places": pa.array(exact, place), "notices": pa.array(fuzzy, notice)}

        return run

    return map_text(docs, make, RESULT, text_col, keep)


def report(scanned: DataFrame) -> DataFrame:
    """Counts, first and last place, labels and best similarity of each document."""
    labels = lambda *c: F.array_join(F.array_sort(F.array_distinct(F.concat(*c))), ",")
    base, own = F.col("places.label"), F.col("notices.label")
    best = F.greatest(F.coalesce(F.array_max("notices.similarity"), F.lit(0.0)), F.when(F.size("places") > 0, 1.0).otherwise(0.0))
    return scanned.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places.word").alias("first_word"),
        F.array_max("places.word").alias("last_word"), labels(base).alias("base_labels"), labels(base, own).alias("labels"), best.alias("score"),
    )
