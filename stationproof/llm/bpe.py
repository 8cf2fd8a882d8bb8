"""Byte-level BPE encoding and decoding.

A text is cut at added tokens and then by the vocabulary's pattern into words; each word merges on its own. A short word is a
row of part boundaries with, beside it, the rank of every two neighbouring parts: the whole row of ranks is searched for its
minimum (the leftmost of equal ones), the boundary between the two parts is deleted, and the ranks on its two sides are looked
up anew. A word is a few bytes, so the search stays within one short list; words of more than `SHORT` bytes keep the ranks in
a heap instead, for the search of a row grows with its square. Words repeat, so a worker merges a new word once and looks the
rest up; its memory of words is bounded.

The ids equal those of the tokenizers library without special tokens, truncation and padding. Added tokens that stand in a text
are found as the library finds them. Which characters are letters, numbers and blanks depends on a library's Unicode version;
characters outside ASCII are put to the library once when a worker first meets them, and replaced by one of their class for
the cutting where Python thinks otherwise.

Nulls count as empty texts, which have no ids. Repeated rows give equal results. Texts of any length are taken whole. An empty
table gives an empty result. Columns named like a result column are replaced, others pass through.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationproof.llm.common import map_text, sha
from stationproof.llm.words import Recent

#: Words of at most so many bytes search their ranks as a list.
SHORT = 64
#: Words that one Python worker keeps in each of two generations.
KEPT = 500_000
NONE = 1 << 60
#: How byte-level vocabularies of this kind cut texts: an ending after an apostrophe, or a run of letters, of numbers or of other
#: marks with the blank before it, or blanks (fixed rules of their format, here by what `re` calls letters and numbers).
BLANKS = r" \t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = re.compile(rf" ?[^\W\d_]+|'(?:[stmd]|re|ve|ll)| ?\d+| ?(?:[^\w{BLANKS}]|_)+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+")
#: One character of each class of that pattern.
CLASSES = ("a", "1", "!", "\n")

_CODECS: dict[int, "Codec"] = {}


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = (b for b in range(256) if b not in shown)
    return [chr(v) for _, v in sorted([(b, b) for b in shown] + [(b, 256 + i) for i, b in enumerate(rest)])]


class Codec:
    """A byte-level vocabulary with its encoder and decoder."""

    def __init__(self, model: str):
        from tokenizers import Tokenizer

        spec = json.loads(model)
        bpe, cut = spec["model"], spec["pre_tokenizer"] or {}
        plain = spec["normalizer"] is None and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if bpe.get(k)]
        added = spec["added_tokens"]
        if bpe["type"] != "BPE" or not plain or odd or any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("not a plain byte-level BPE vocabulary")
        value = {ord(c): b for b, c in enumerate(byte_letters())}
        raw = lambda piece: bytes(value[ord(c)] for c in piece)
        self.ids = {raw(p): i for p, i in bpe["vocab"].items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in bpe["merges"])
        self.rank = {(raw(a), raw(b)): r for r, (a, b) in enumerate(pairs)}
        self.rank_of_bytes = {a + b: r for (a, b), r in self.rank.items() if len(a) == len(b) == 1}
        self.added = {t["content"]: t["id"] for t in added}
        special = sorted(self.added, key=len, reverse=True)
        self.cut_added = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.bytes_of = {i: p for p, i in self.ids.items()} | {i: t.encode() for t, i in self.added.items()}
        self.library = Tokenizer.from_str(model).pre_tokenizer
        self.met: set[str] = set()
        self.stand_in: dict[int, str] = {}
        self.known = Recent("bpe", KEPT)

    # Cutting into words

    def _meet(self, letters: set[str]) -> None:
        """Note the characters that the library puts in another class than Python."""
        for c in letters:
            asked = lambda x: f"a{x}1{x}!{x}"
            theirs = [span for _, span in self.library.pre_tokenize_str(asked(c))]
            fits = [x for x in (c, *CLASSES) if [m.span() for m in WORDS.finditer(asked(x))] == theirs]
            if not fits:
                raise ValueError(f"the library cuts {c!r} in no known way")
            if fits[0] != c:
                self.stand_in[ord(c)] = fits[0]
        self.met |= letters

    def words(self, text: str) -> list[str]:
        """The words of a text without added tokens."""
        if text.isascii():
            return WORDS.findall(text)
        letters = set(text)
        if not letters <= self.met:
            self._meet(letters - self.met)
        if self.stand_in:
            cut = text.translate(self.stand_in)
            if cut != text:
                return [text[m.start() : m.end()] for m in WORDS.finditer(cut)]
        return WORDS.findall(text)

    def split(self, text: str) -> list[str]:
        """Words and added tokens of a text."""
        if self.cut_added is None or not self.cut_added.search(text):
            return self.words(text)
        parts = self.cut_added.split(text)
        return list(chain.from_iterable([p] if i % 2 else self.words(p) for i, p in enumerate(parts)))

    # Merging

    def merge(self, word: bytes) -> list[int]:
        cuts = self.merge_short(word) if len(word) <= SHORT else self.merge_long(word)
        ids = self.ids
        return [ids[word[a:b]] for a, b in zip(cuts, cuts[1:])]

    def merge_short(self, word: bytes) -> list[int]:
        """Part boundaries of a word, by a row of ranks."""
        rank, rank_of_bytes = self.rank.get, self.rank_of_bytes.get
        cuts = list(range(len(word) + 1))
        ranks = [rank_of_bytes(word[i : i + 2], NONE) for i in range(len(word) - 1)]
        while ranks:
            best = min(ranks)
            if best == NONE:
                break
            i = ranks.index(best)
            del cuts[i + 1], ranks[i]
            a, b = cuts[i], cuts[i + 1]
            part = word[a:b]
            if i:
                ranks[i - 1] = rank((word[cuts[i - 1] : a], part), NONE)
            if i < len(ranks):
                ranks[i] = rank((part, word[b : cuts[i + 2]]), NONE)
        return cuts

    def merge_long(self, word: bytes) -> list[int]:
        """Part boundaries of a word, by a heap of ranks; parts are linked by where they begin and end."""
        rank, n = self.rank, len(word)
        end, start = list(range(1, n + 1)), list(range(n))  # of the part that begins here, of the one whose last byte is here
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := rank.get((word[i : i + 1], word[i + 1 : i + 2]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, a, b, c = heapq.heappop(heap)
            if end[a] != b or end[b] != c:
                continue  # one of the two has grown since
            end[a], end[b], start[c - 1] = c, 0, a
            if c < n and (r := rank.get((word[a:c], word[c : end[c]]))) is not None:
                heapq.heappush(heap, (r, a, c, end[c]))
            if a and (r := rank.get((word[start[a - 1] : a], word[a:c]))) is not None:
                heapq.heappush(heap, (r, start[a - 1], a, c))
        cuts = [0]
        while cuts[-1] < n:
            cuts.append(end[cuts[-1]])
        return cuts

    def learn(self, words: list[str]) -> list[bytes]:
        """Ids of words and added tokens not met before."""
        own = ([self.added[w]] if w in self.added else self.merge(w.encode("utf-8")) for w in words)
        return [array("i", ids).tobytes() for ids in own]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        split = [self.split(t) if t else [] for t in texts]
        of = self.known.ensure(set(chain.from_iterable(split)), self.learn)
        return [b"".join(map(of.__getitem__, s)) for s in split]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; ids that the vocabulary lacks are silent, bytes that are not UTF-8 become replacement marks."""
        try:
            raw = b"".join(map(self.bytes_of.__getitem__, ids))
        except KeyError:
            raw = b"".join(self.bytes_of.get(i, b"") for i in ids)
        return raw.decode("utf-8", "replace")


def codec(model: str) -> Codec:
    """The vocabulary, built once in a Python worker."""
    key = hash(model)
    if key not in _CODECS:
        _CODECS[key] = Codec(model)
    return _CODECS[key]


def model_text(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add `ids` (array<int>) and `decoded`, the text that the ids decode to."""
    model = model_text(path)

    def make():
        own = codec(model)

        def run(texts: list) -> dict[str, pa.Array]:
            ids, decoded = [], []
            for at in range(0, len(texts), 100):
                for raw in own.encode(texts[at : at + 100]):
                    ids.append(raw)
                    decoded.append(own.decode(np.frombuffer(raw, dtype="<i4").tolist()))
            ends = np.cumsum([0] + [len(r) // 4 for r in ids])
            flat = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"), pa.int32())
            return {"ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat), "decoded": pa.array(decoded, pa.string())}

        return run

    return map_text(docs, make, "ids array<int>, decoded string", text_col, keep)


def decode(df: DataFrame, path: str, ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Add `decoded`, the text of an id array; null for null. Null ids are silent."""
    model = model_text(path)

    def make():
        own = codec(model)
        return lambda rows: {"decoded": pa.array([None if r is None else own.decode(r) for r in rows], pa.string())}

    return map_text(df, make, "decoded string", ids_col, keep)


def digests(encoded: DataFrame) -> DataFrame:
    """Count and digests of the ids and of the decoded text."""
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), sha(joined).alias("ids_sha256"), sha(F.col("decoded")).alias("decoded_sha256"))
