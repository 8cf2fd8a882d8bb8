"""Token ids in block files with Elias-Fano document boundaries.

Documents are dealt by ranges of doc_id to shards, encoded in ascending order and packed into blocks. A block holds one
concatenated id array (16 bits an id where the vocabulary allows it, else 32) and its documents' end offsets as an
Elias-Fano sequence: the low bits of each offset packed, the high bits in unary, and a sampled select structure over them, so
that any document's offsets are found without a table of 64-bit offsets. Blocks are rows of Parquet files in a folder that
all executors share, so a lost task is written again and a reader sees only whole files.

The vocabulary drops white space and never joins across it. A text of ASCII and Latin-1 letters is cut into the parts of its
words at once, any other into chunks at ASCII white space, whose chunks of such letters are cut into parts too. The tokenizers library encodes each distinct part
or other chunk once in a worker's memory; it is looked up after that.

Nulls and empty texts hold the end id only. Null doc_ids come first. Rows of equal doc_id are ordered by a hash of their text,
equal rows stay side by side. A document is never cut, however long. An empty table gives no blocks.
"""

from __future__ import annotations

import os
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationproof.llm.words import Recent

#: Ids in a block, unless one document alone has more.
BLOCK = 1 << 20
#: One select sample for so many ones of the unary part.
SAMPLE = 256
#: A chunk of its own that separates the words put to the library together.
MARK = "\x01"
#: How the vocabulary's pre-tokenizer cuts lower-cased texts of the characters below (a fixed value of its file); the commonest kind
#: stands first.
PARTS = re.compile("[a-zß-öø-ÿ]+|[0-9]|'(?:[stmd]|re|ve|ll)|[^a-z0-9ß-öø-ÿ \t-\r]+")
#: Any character but ASCII and the letters of Latin-1, which no normal form changes and which lower-case one to one.
OTHERS = re.compile("[^\x00-\x7fÀ-ÖØ-öø-ÿ]")
BLOCKS = (
    "shard int, block int, start long, n_docs int, n_ids long, width int, low_bits int, low binary, high binary, samples binary, ids binary, "
    "doc_ids array<bigint>"
)


class EliasFano:
    """A non-decreasing sequence of integers from 0 to `top` in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray, top: int) -> EliasFano:
        n = len(values)
        bits = max(0, int(top // max(n, 1)).bit_length() - 1)
        values = values.astype(np.int64)
        low = ((values[:, None] >> np.arange(bits)) & 1).astype(np.uint8).ravel()
        ones = (values >> bits) + np.arange(n)
        unary = np.zeros((top >> bits) + n + 1, dtype=np.uint8)
        unary[ones] = 1
        return cls(n, bits, np.packbits(low, bitorder="little").tobytes(), np.packbits(unary, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4").tobytes())

    def select(self, i: int) -> int:
        """The value at place i: its one in the unary part is searched from the nearest sample on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(np.frombuffer(self.samples, "<u4")[i // SAMPLE])
        left, byte = i % SAMPLE, at >> 3
        word = self.high[byte] >> (at & 7) << (at & 7)
        while left >= (ones := word.bit_count()):
            left -= ones
            byte += 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        place = byte * 8 + (word & -word).bit_length() - 1
        first = i * self.low_bits
        low = int.from_bytes(self.low[first >> 3 : (first + self.low_bits + 7) >> 3], "little") >> (first & 7)
        return (place - i) << self.low_bits | low & (1 << self.low_bits) - 1

    def values(self) -> np.ndarray:
        """All values in order."""
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        low = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        return (ones - np.arange(self.n) << self.low_bits) + (low.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)


def _plain(text: str) -> bool:
    """Of ASCII and Latin-1 letters, without added tokens or the mark: lower-cased and cut by `PARTS`, it is what the library encodes."""
    return (text.isascii() or not OTHERS.search(text)) and MARK not in text and "<|" not in text


class ChunkEncoder:
    """Ids of whole texts by way of their parts and white-space chunks."""

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_str(model)
        #: The same vocabulary for parts, which need no more lower-casing and cutting.
        self.of_parts = Tokenizer(self.library.model)
        self.of_parts.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.mark = self.library.encode(MARK, add_special_tokens=False).ids
        self.known, self.parts = Recent("token_file"), Recent("token_file")

    def _learn(self, chunks: list[bytes]) -> list[bytes]:
        """Plain chunks are cut into parts, which repeat more often; others go to the library whole."""
        words = [c.decode("utf-8", "surrogatepass") for c in chunks]
        cut = [PARTS.findall(w.lower()) if _plain(w) else None for w in words]
        whole = [w for w, c in zip(words, cut) if c is None]
        alone = dict(zip(whole, self._ask(whole)))
        of = self.parts.ensure(set(chain.from_iterable(c for c in cut if c)), self._ask_parts)
        return [alone[w] if c is None else b"".join(map(of.__getitem__, c)) for w, c in zip(words, cut)]

    def _ask(self, words: list[str]) -> list[bytes]:
        """The library's ids of words, many at once."""
        plain = [w for w in words if MARK not in w]
        made = dict(zip(plain, self._together(self.library, plain)))
        return [made[w] if w in made else self._alone(w) for w in words]

    def _ask_parts(self, parts: list[str]) -> list[bytes]:
        return self._together(self.of_parts, parts)

    def _together(self, library, words: list[str]) -> list[bytes]:
        """Ids of words without the mark, which goes between them."""
        made: list[bytes] = []
        for at in range(0, len(words), 1000):
            some = words[at : at + 1000]
            ids = np.array(library.encode_batch_fast([f" {MARK} ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = np.flatnonzero(ids == self.mark[0]) if len(self.mark) == 1 else []
            if len(cuts) != len(some) - 1:
                made += map(self._alone, some)
                continue
            raw, ends = ids.tobytes(), [*(4 * cuts).tolist(), 4 * len(ids)]
            made += [raw[a:b] for a, b in zip([0, *(e + 4 for e in ends)], ends)]
        return made

    def _alone(self, word: str) -> bytes:
        return np.array(self.library.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        plain = [t is not None and _plain(t) for t in texts]
        split = [PARTS.findall(t.lower()) if own else (t or "").encode("utf-8", "surrogatepass").split() for t, own in zip(texts, plain)]
        known = self.known.ensure(set(chain.from_iterable(s for s, own in zip(split, plain) if not own)), self._learn)
        parts = self.parts.ensure(set(chain.from_iterable(s for s, own in zip(split, plain) if own)), self._ask_parts)
        return [b"".join(map((parts if own else known).__getitem__, s)) for s, own in zip(split, plain)]


_ENCODERS: dict[int, ChunkEncoder] = {}


def encoder(model: str) -> ChunkEncoder:
    key = hash(model)
    if key not in _ENCODERS:
        _ENCODERS[key] = ChunkEncoder(model)
    return _ENCODERS[key]


def pack(shard: int, block: int, start: int, doc_ids: list, ids: list[bytes], width: int) -> dict:
    """One block row."""
    flat = np.frombuffer(b"".join(ids), dtype="<u4")
    ends = EliasFano.build(np.cumsum([len(x) // 4 for x in ids]), len(flat))
    return {
        "shard": shard, "block": block, "start": start, "n_docs": len(ids), "n_ids": len(flat), "width": width, "low_bits": ends.low_bits, "low": ends.low,
        "high": ends.high, "samples": ends.samples, "ids": flat.astype(f"<u{width}").tobytes(), "doc_ids": doc_ids,
    }


def write(docs: DataFrame, path: str, model_path: str, end_id: int, shards: int | None = None) -> None:
    """Encode `doc_id`, `text` and write block files to the folder `path`."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    with open(model_path, encoding="utf-8") as f:
        model = f.read()
    width = 2 if max(Tokenizer.from_str(model).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    end = np.array([end_id], dtype="<u4").tobytes()
    schema = spark.createDataFrame([], BLOCKS).schema
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_tie"))
    ordered = rows.repartitionByRange(shards, "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie", "text")

    def run(batches):
        own, shard = encoder(model), TaskContext.get().partitionId()
        block = start = held = 0
        doc_ids, ids = [], []
        to_arrow = pa.schema([(f.name, {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}.get(f.dataType.simpleString(), pa.list_(pa.int64()))) for f in schema])
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(texts), 100):
                for name, made in zip(names[at : at + 100], own.encode(texts[at : at + 100])):
                    if held and held + len(made) // 4 + 1 > BLOCK:
                        yield pa.RecordBatch.from_pylist([pack(shard, block, start, doc_ids, ids, width)], schema=to_arrow)
                        block, start, held, doc_ids, ids = block + 1, start + held, 0, [], []
                    doc_ids.append(name)
                    ids.append(made + end)
                    held += len(made) // 4 + 1
        if ids:
            yield pa.RecordBatch.from_pylist([pack(shard, block, start, doc_ids, ids, width)], schema=to_arrow)

    ordered.mapInArrow(run, schema).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the block files: doc_id, start (over all files), n_tokens, ids_crc32."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    # One row a shard; their number is that of the writer's range partitions, whatever the data.
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()
    starts, before = {}, 0
    for t in totals:
        starts[t.shard] = before
        before += t.n

    def run(batches):
        for batch in batches:
            for b in batch.to_pylist():
                ends = EliasFano(b["n_docs"], b["low_bits"], b["low"], b["high"], b["samples"]).values()
                ids = np.frombuffer(b["ids"], dtype=f"<u{b['width']}").astype("<u4").tobytes()
                begins = np.concatenate(([0], ends[:-1]))
                crc = [zlib.crc32(ids[4 * x : 4 * y]) for x, y in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(b["doc_ids"], pa.int64()), pa.array(begins + starts[b["shard"]] + b["start"], pa.int64()), pa.array(ends - begins, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
