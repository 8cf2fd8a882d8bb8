"""Token counts of a unigram vocabulary without building tokens: Aho-Corasick matches and a counting Viterbi pass.

The vocabulary and its scores come from a sentencepiece model file; text is marked and split like the tokenizers library's
Metaspace (a mark for each blank and one in front, a new word at each mark). An automaton lists every piece that ends at
each character; the dynamic programme keeps the best score and its piece count there. Tie rules are those of the library's
unigram model: candidates of one end are taken from the earliest start on and only a strictly better one replaces; a character
without a piece of its own costs the lowest score less 10 and counts as its bytes. Scores are summed in double precision.

No piece goes on after a letter with a non-letter, so words fall into segments that are counted once a worker and looked up.
Null and empty texts have no tokens. Repeated rows and ties give equal counts; texts are counted whole. Other columns pass
through; one named like the result is replaced.
"""

from __future__ import annotations

from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from stationproof.llm.common import map_text
from stationproof.llm.pieces import CROSSES, MARK, SEGMENT, model_bytes
from stationproof.llm.words import Recent

#: Added to the lowest score for an unknown character, as in the library.
PENALTY = 10.0


def vocabulary(model: bytes) -> list[tuple[str, float]]:
    """Pieces that can match, with scores: no control or unknown piece, and no run of marks, which no word holds."""
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_proto=model)
    ids = [i for i in range(lib.get_piece_size()) if not (lib.is_control(i) or lib.is_unknown(i))]
    return [(p, lib.get_score(i)) for i in ids for p in [lib.id_to_piece(i)] if not (len(p) > 1 and set(p) == {MARK})]


class Counter:
    """Counts pieces of the best segmentation."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.matches = ahocorasick.Automaton()
        for p, score in pieces:
            self.matches.add_word(p, (len(p), score))
        self.matches.make_automaton()
        self.unknown = min(s for _, s in pieces) - PENALTY
        self.whole = any(len(p) > 1 and CROSSES.search(p) for p, _ in pieces if not p.startswith("<0x"))
        if self.whole:
            raise ValueError("a piece crosses the start of a segment")
        self.known = Recent("token_counts", 700_000)

    def count(self, word: str) -> int:
        ends: list[list] = [[] for _ in word]
        for end, found in self.matches.iter(word):
            ends[end].append(found)
        best, tokens = [0.0], [0]
        for end, found in enumerate(ends):
            score = pieces = None
            single = False
            for length, s in sorted(found, reverse=True):  # the longest piece has the earliest start
                start = end + 1 - length
                if score is None or best[start] + s > score:
                    score, pieces = best[start] + s, tokens[start] + 1
                single = single or length == 1
            if not single and (score is None or best[end] + self.unknown > score):
                score, pieces = best[end] + self.unknown, tokens[end] + len(word[end].encode("utf-8", "surrogatepass"))
            best.append(score)
            tokens.append(pieces)
        return tokens[-1]

    def counts(self, texts: list[str | None]) -> list[int]:
        split = []
        for t in texts:
            marked = (t or "").replace(" ", MARK)
            split.append(SEGMENT.findall(marked if not marked or marked[0] == MARK else MARK + marked))
        known = self.known.ensure(set(chain.from_iterable(split)), lambda new: [self.count(s) for s in new])
        return [sum(map(known.__getitem__, s)) for s in split]


_COUNTERS: dict[int, Counter] = {}


def counter(model: bytes) -> Counter:
    key = hash(model)
    if key not in _COUNTERS:
        _COUNTERS[key] = Counter(vocabulary(model))
    return _COUNTERS[key]


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add `n_tokens`."""
    model = model_bytes(path)

    def make():
        own = counter(model)
        return lambda texts: {"n_tokens": pa.array([c for at in range(0, len(texts), 100) for c in own.counts(texts[at : at + 100])], pa.int64())}

    return map_text(docs, make, "n_tokens long", text_col, keep)
