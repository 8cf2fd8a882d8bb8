"""SentencePiece encoding and decoding of merge-type vocabularies.

Encoding keeps, for every segment of a text, an agenda of adjacent symbol pairs ordered by score, then by place: the pair
whose joined piece scores best is merged, its two new neighbour pairs enter the agenda, and outdated entries are skipped.
Short segments hold the agenda as a plain list in text order, long ones as a heap. No piece holds a blank mark or a non-letter
after another kind of character (checked on loading), so a text falls into segments that merge independently; segments
repeat, so each task merges a new segment once, checks it against the sentencepiece library in batches, and looks the rest
up. A difference from the library ends the run.

Nulls count as empty texts, which have no ids. Repeated rows and ties give equal results (agenda ties go to the left). Texts
of any length are taken whole. An empty table gives an empty result. Columns named like a result column are replaced.
"""

from __future__ import annotations

import codecs
import heapq
import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationproof.llm.common import map_text, sha
from stationproof.llm.words import Recent

MARK = "▁"
LETTER = "[A-Za-zÀ-ÖØ-öø-ɏ]"
#: A segment ends before a blank mark, around a line feed (always a byte piece) and between a letter and a non-letter.
SEGMENT = re.compile(rf"\n|{MARK}+(?:(?!{LETTER})[^{MARK}\n])*{LETTER}*|(?:(?!{LETTER})[^{MARK}\n])+{LETTER}*|{LETTER}+")
CROSSES = re.compile(rf"[^{MARK}]{MARK}|{LETTER}(?!{LETTER})(?!$)|\n")
#: Up to this many characters the agenda is a list.
SHORT = 40
#: Segments that one Python worker keeps in each of two generations, some 230 bytes each.
KEPT = 600_000

_CODECS: dict[int, "Codec"] = {}


def _one_mark_a_byte(error):
    return "�" * (error.end - error.start), error.end


codecs.register_error("one_mark_a_byte", _one_mark_a_byte)


class Codec:
    """A merge-type vocabulary with its encoder, decoder and the library that checks it."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = lib.get_piece_size()
        special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) for i in range(size)]
        self.ids = {lib.id_to_piece(i): i for i in range(size) if not special[i]}
        self.score = [lib.get_score(i) for i in range(size)]
        self.order = {p: -self.score[i] for p, i in self.ids.items()}
        self.control = {i for i in range(size) if lib.is_control(i)}
        self.byte_ids = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(CROSSES.search(p) for p in self.ids):
            raise ValueError("a piece crosses the start of a segment")
        if not all(lib.is_byte(i) for i in self.byte_ids):
            raise ValueError("the vocabulary needs byte pieces")
        text = {i: p.replace(MARK, " ").encode() for p, i in self.ids.items()}
        text |= {i: bytes([b]) for b, i in enumerate(self.byte_ids)}
        text |= {i: (" ⁇ ".encode() if lib.is_unknown(i) else b"") for i in range(size) if i not in text}
        self.bytes_of = text
        self.head = len(lib.encode("\n"))
        self.known = Recent("pieces", KEPT)

    def merge(self, segment: str) -> list[int]:
        """Ids of one segment, by the agenda."""
        symbols = self.merge_short(segment) if len(segment) <= SHORT else self.merge_long(segment)
        out, ids = [], self.ids
        for s in symbols:
            found = ids.get(s)
            if found is None:
                out.extend(self.byte_ids[b] for b in s.encode("utf-8"))
            else:
                out.append(found)
        return out

    def merge_short(self, segment: str) -> list[str]:
        order, none = self.order.get, float("inf")
        symbols = list(segment)
        agenda = [order(a + b, none) for a, b in zip(symbols, symbols[1:])]
        while agenda:
            best = min(agenda)
            if best == none:
                break
            i = agenda.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del agenda[i]
            if i:
                agenda[i - 1] = order(symbols[i - 1] + symbols[i], none)
            if i < len(agenda):
                agenda[i] = order(symbols[i] + symbols[i + 1], none)
        return symbols

    def merge_long(self, segment: str) -> list[str]:
        ids, score = self.ids, self.score
        symbols = list(segment)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            found = ids.get(symbols[i] + symbols[i + 1])
            if found is not None:
                agenda.append((-score[found], i, i + 1, symbols[i] + symbols[i + 1]))
        heapq.heapify(agenda)
        while agenda:
            _, i, j, piece = heapq.heappop(agenda)
            left, right = symbols[i], symbols[j]
            if left is None or right is None or len(left) + len(right) != len(piece):
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = piece, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = ids.get(piece + symbols[k])
                if found is not None:
                    heapq.heappush(agenda, (-score[found], i, k, piece + symbols[k]))
            h = before[i]
            if h >= 0:
                found = ids.get(symbols[h] + piece)
                if found is not None:
                    heapq.heappush(agenda, (-score[found], h, i, symbols[h] + piece))
        return [s for s in symbols if s is not None]

    def learn(self, segments: list[str]) -> list[bytes]:
        """Ids of segments not met before, checked against the library."""
        # The library puts one mark before each text, so a segment that begins with one gives that up here; others get
        # a line feed in front, which never merges, and lose its ids again.
        asked = [s[1:].replace(MARK, " ") if s[0] == MARK and len(s) > 1 else "\n" + s.replace(MARK, " ") for s in segments]
        made = []
        for s, a, theirs in zip(segments, asked, self.library.encode(asked, num_threads=1)):
            own = self.merge(s)
            if own != (theirs if a[0] != "\n" or s[0] == MARK and len(s) > 1 else theirs[self.head :]):
                raise AssertionError(f"segment {s!r}: {own} differs from the library's {theirs}")
            made.append(array("i", own).tobytes())
        return made

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        split = [SEGMENT.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        of = self.known.ensure(set(chain.from_iterable(split)), self.learn)
        return [b"".join(map(of.__getitem__, s)) for s in split]

    def decode(self, ids: list[int]) -> str:
        if not self.control.isdisjoint(ids):
            return self._decode_parts(ids)
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        if raw[:1] == b" " and self._marked(ids[0]):
            raw = raw[1:]
        return raw.decode("utf-8", "one_mark_a_byte")

    def _marked(self, i: int) -> bool:
        return not self.library.is_byte(i) and not self.library.is_unknown(i)

    def _decode_parts(self, ids: list[int]) -> str:
        """Control ids are silent, but bytes on their two sides don't join."""
        parts: list[list[int]] = [[]]
        for i in ids:
            if i in self.control:
                parts.append([])
            else:
                parts[-1].append(i)
        texts = [b"".join(map(self.bytes_of.__getitem__, p)).decode("utf-8", "one_mark_a_byte") for p in parts]
        first = next((k for k, p in enumerate(parts) if p), None)
        if first is not None and texts[first][:1] == " " and self._marked(parts[first][0]):
            texts[first] = texts[first][1:]
        return "".join(texts)


def codec(model: bytes) -> Codec:
    """The vocabulary, built once in a Python worker."""
    key = hash(model)
    if key not in _CODECS:
        _CODECS[key] = Codec(model)
    return _CODECS[key]


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add `ids` (array<int>) and `decoded`, the text that the ids decode to."""
    model = model_bytes(path)

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
    """Add `decoded`, the text of an id array; null for null."""
    model = model_bytes(path)

    def make():
        own = codec(model)
        return lambda rows: {"decoded": pa.array([None if r is None else own.decode(r) for r in rows], pa.string())}

    return map_text(df, make, "decoded string", ids_col, keep)


def digests(encoded: DataFrame) -> DataFrame:
    """Count and digests of the ids and of the decoded text."""
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), sha(joined).alias("ids_sha256"), sha(F.col("decoded")).alias("decoded_sha256"))
