"""Brown class-based n-grams: exchange clustering, class transitions, word emissions, smoothed scores.

Tokens are words (lower-cased A-Z, cut at ASCII white space) and one end a text. Exchange clustering moves every word of at least
`LEAST` training occurrences between `CLASSES` classes, and as one the rarer words of a part that share ending and length
(`group`): each round counts each word's neighbours by class and moves half of the words to the class that gains most
likelihood; a round that loses likelihood is taken back. The end is a class of its own. A word that training has not seen
takes the class that most training words of its group have.

Words and their classes are a table of parts of about `PART` words. Texts are read once, into pieces of numbered words. Pieces
ask the parts for their words' places, and hand every part the bigrams that its words stand in, added up there over all pieces
(`linked`): a round reads these and not the corpus. In a round each part sends the others the classes of the neighbours that they
listed once; with them a part counts neighbours by class and the class bigrams, and its words move when these have been added
up. A round reads its links once, or twice after a round that was taken back. Rows are packed arrays, and a task reads them in
order: one chunk of links, or one piece, at a time. Stored tables are deleted when nothing reads them any more.

score = sum of log10 P(class | class before) + log10 P(word | class), with P(word | class) = (c + 1) / (N_class + V_class + 1)
and transitions smoothed by `SMOOTH`. Only counts per class (and group) pass through the driver, whatever the corpus. Counts
and classes of words reach the pieces by a shuffle, and a piece's texts are scored from its numbers in one task.

Null and empty texts hold the end alone. A null doc_id counts as empty text in the split. Repeated rows count each. Texts
are scored whole. An empty table gives an empty result; without training texts every
count is zero and scores come from smoothing alone. Other columns are not read.
"""

from __future__ import annotations

import gc
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, groupby

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationproof.llm.common import BATCH_ROWS, blank_words, freed, stored, stored_in_turn

GROUPS, CLASSES, ROUNDS, SMOOTH = 128, 64, 8, 0.1
PART = 50_000
#: Occurrences from which a word is clustered alone; rarer ones alone would learn their few neighbours by heart.
LEAST = 3
END = b""
#: Counts for which growths of x log x are shared between words.
STEPS = 64
#: Columns of a word's counts: classes after it, classes before it, and how often it follows itself.
WIDTH = 2 * (CLASSES + 1) + 1
#: Distinct words, or tokens, of a piece.
HELD_WORDS, HELD_PAIRS = 200_000, 500_000
#: Links from pieces that a part's task holds before it adds up equal ones.
HELD_LINKS = 400_000
#: Bytes of packed rows that a task holds in one batch, beside the row at hand; and of one row, so that it fits a region of the JVM's heap.
HELD_BYTES, ROW_BYTES = 2 << 20, 384 << 10
#: Turns in which the parts add up their links, so that the disk holds the shuffle of one turn beside the bigrams not yet added up.
TURNS = 3
#: Cells of counts that a task adds up at once.
HELD_CELLS = 4_000_000
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Part numbers of rows that hold class bigrams, and of the end as a neighbour.
TOTALS, NONE = -2, -1
SURVEY = "part int, block long, body binary, n long"
SURVEY_NAMES = ["part", "block", "body", "n"]
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def held_out(doc_id) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def tokens(text: str | None) -> list[bytes]:
    return [*blank_words(text), END]


def group(word: bytes) -> int:
    """Of a word: by its last two bytes and its length."""
    return zlib.crc32(word[-2:]) % 16 * 8 + min(len(word) // 2, 7)


def _flat(x: np.ndarray) -> bytes:
    """Numbers byte by byte, so that files and shuffles compress them well."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _numbers(body: bytes, kind: str, n: int, at: int = 0) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(body, np.uint8, n * size, at).reshape(size, n).T).view(kind)[:, 0]


def _small(body: bytes) -> bytes:
    """Compressed with its size before it."""
    return len(body).to_bytes(8, "little") + pa.compress(body, "zstd", asbytes=True)


def _large(body: bytes) -> bytes:
    return pa.decompress(body[8:], int.from_bytes(body[:8], "little"), "zstd", asbytes=True)


def numbered(texts: DataFrame) -> DataFrame:
    """The corpus as pieces: block, part (0, and -1, -2, … for the rows of a piece's texts in turn), words (in the order of their
    numbers from 1 on; 0 is the end) and how often each number occurs in training texts (n), both in row 0, and the texts as
    numbers in rows of `ROW_BYTES` (body, see `_texts`). Without a column held_out all texts are for training."""
    out_of = F.col("held_out") if "held_out" in texts.columns else F.lit(False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32

        def out():
            sizes, seq, away = np.array(list(map(len, runs)), np.int64), np.concatenate(runs), np.array(held_outs, bool)
            n = np.bincount(seq[np.repeat(~away, sizes)], minlength=len(numbers)).astype(np.int64)
            ids = np.array([0 if i is None else i for i in doc_ids], np.int64)
            null = np.array([i is None for i in doc_ids], bool)
            body = len(runs).to_bytes(8, "little") + null.tobytes() + away.tobytes() + _flat(ids) + _flat(sizes) + _flat(seq)
            body = _small(body)
            yield _row("block part words n body", [block], [0], [_small(b"\n".join(list(numbers)[1:]))], [_small(_flat(n))], [None])
            for i, lo in enumerate(range(0, len(body), ROW_BYTES)):
                yield _row("block part words n body", [block], [NONE - i], [None], [None], [body[lo : lo + ROW_BYTES]])

        numbers, runs, doc_ids, held_outs, held = defaultdict(count().__next__, {}), [], [], [], 0
        numbers[END]
        for batch in batches:
            for doc_id, text, away in zip(*(c.to_pylist() for c in batch.columns)):
                words = tokens(text)
                runs.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                doc_ids.append(doc_id)
                held_outs.append(away)
                held += len(words)
                if held > HELD_PAIRS or len(numbers) > HELD_WORDS:
                    yield from out()
                    numbers, runs, doc_ids, held_outs, held, block = defaultdict(count().__next__, {}), [], [], [], 0, block + 1
                    numbers[END]
        if runs:
            yield from out()

    return texts.select(F.col("doc_id").cast("long"), "text", out_of).mapInArrow(run, "block long, part int, words binary, n binary, body binary")


def _texts(body: bytes) -> tuple:
    """Of a piece: doc_ids, which of them are null, which texts are held out, their sizes, and the numbers of all their words."""
    body = _large(body)
    d = int.from_bytes(body[:8], "little")
    null, away = (np.frombuffer(body, bool, d, 8 + i * d) for i in range(2))
    ids, sizes = (_numbers(body, "<i8", d, 8 + (2 + 8 * i) * d) for i in range(2))
    return ids, null, away, sizes, _numbers(body, "<i4", (len(body) - 8 - 18 * d) // 4, 8 + 18 * d)


def _counted(whole: DataFrame) -> DataFrame:
    """word, c over all training tokens of the pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for body, n in _rows(batches):
            words = pa.array([END, *_split(_large(body))], pa.binary())
            n = _numbers(_large(n), "<i8", len(words))
            has = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([words.take(pa.array(has)), pa.array(n[has])], names=["word", "n"])

    return whole.where("part = 0").select("words", "n").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def word_counts(texts: DataFrame) -> DataFrame:
    """word, c over all tokens."""
    return _counted(numbered(texts))


def _row(names: str, *columns: tuple) -> pa.RecordBatch:
    kinds = {"block": pa.int64(), "part": pa.int32(), "kind": pa.int32(), "body": pa.binary(), "n": pa.int64(), "c": pa.binary(), "own": pa.binary(), "words": pa.binary()}
    kinds |= {"n": pa.binary()} if "words" in names else {}
    return pa.RecordBatch.from_arrays([pa.array(list(v), kinds[k]) for k, v in zip(names.split(), columns)], names=names.split())


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):  # one row's body at a time
            yield tuple(c[i].as_py() for c in batch.columns)


def _packed(a: np.ndarray, *others: np.ndarray) -> bytes:
    """Columns of rows in order of a: steps of a, and byte by byte, so that shuffles compress them well."""
    rows = np.stack((np.diff(a, prepend=0), *others)).astype("<i4")
    return _small(rows.view(np.uint8).reshape(len(rows), -1, 4).transpose(0, 2, 1).tobytes())


def _unpacked(body: bytes, columns: int) -> np.ndarray:
    rows = np.ascontiguousarray(np.frombuffer(_large(body), np.uint8).reshape(columns, 4, -1).transpose(0, 2, 1)).view("<i4")[:, :, 0].astype(np.int64)
    rows[0] = np.cumsum(rows[0])
    return rows


def _asked(block: int, words: bytes, parts: int) -> pa.RecordBatch:
    """What a piece asks each part: block, part, and how many words, their numbers and the words (body)."""
    words = _split(_large(words))
    owner = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % parts
    order = np.argsort(owner, kind="stable")
    has, first = np.unique(owner[order], return_index=True)
    number, words = order.astype("<i4") + np.int32(1), [words[i] for i in order.tolist()]
    bodies = [_small(int(hi - lo).to_bytes(8, "little") + _flat(number[lo:hi]) + b"\n".join(words[lo:hi])) for lo, hi in zip(first, [*first[1:], len(words)])]
    return _row("block part body", [block] * len(has), has.tolist(), bodies)


def _lists(whole: DataFrame, parts: int) -> DataFrame:
    """What each piece asks each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, words in _rows(batches):
            yield _asked(block, words, parts)

    return whole.where("part = 0").select("block", "words").mapInArrow(run, "block long, part int, body binary")


def pieces(texts: DataFrame, parts: int) -> DataFrame:
    """The corpus as pieces: what each asks each part, and at parts -1, -2, … its texts as numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, part, words, body in _rows(batches):
            yield _asked(block, words, parts) if part == 0 else _row("block part body", [block], [part], [body])

    return numbered(texts).select("block", "part", "words", "body").mapInArrow(run, "block long, part int, body binary")


def owners(counts: DataFrame, parts: int) -> DataFrame:
    """The words of each part in order, with their counts, and those clustered alone: part, body, c, own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None, [], []

        def out():
            part, words, c = held
            alone = [w for w, n in zip(words, c) if n >= LEAST]
            yield _row("part body c own", [part], [b"\n".join(words)], [np.array(c, np.int64).tobytes()], [b"\n".join(alone)])

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for part, rows in groupby(range(batch.num_rows), columns[0].__getitem__):
                rows = list(rows)
                if part != held[0]:
                    if held[1]:
                        yield from out()
                    held = part, [], []
                for more, column in zip(held[1:], columns[1:]):
                    more += column[rows[0] : rows[-1] + 1]
        if held[1]:
            yield from out()

    dealt = counts.where(F.length("word") > 0).select(F.pmod(F.crc32("word"), F.lit(parts)).cast("int").alias("part"), "word", "c")
    return dealt.repartition("part").sortWithinPartitions("part", "word").mapInArrow(run, "part int, body binary, c binary, own binary")


def _split(body: bytes) -> list[bytes]:
    return body.split(b"\n") if body else []


def _places(words: list[bytes], place: dict[bytes, int]) -> np.ndarray:
    """Numbers in a part: of the words clustered alone, then of the groups of its other words."""
    return np.array([i if (i := place.get(w)) is not None else len(place) + group(w) for w in words], np.int32)


def _by_part(own: DataFrame, of_blocks: DataFrame, tasks: int | None = None) -> DataFrame:
    """Each part's own row and then its blocks' rows, in one task: part, kind, block, body."""
    both = own.select("part", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("block"), "body").union(of_blocks.select("part", F.lit(1), "block", "body"))
    return both.repartition(*([tasks] if tasks else []), "part").sortWithinPartitions("part", "kind", "block")


def asks(own: DataFrame, cut: DataFrame) -> DataFrame:
    """Answers of the parts to the pieces: part, block, and how many words, their numbers, places and counts (body)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in groupby(_rows(batches), lambda r: r[0]):
            index: dict[bytes, int] = {}
            c, places, alone = np.zeros(1, np.int64), np.zeros(1, np.int32), 0
            for _, kind, block, body in rows:
                if kind == 0:
                    words, _, c = body.partition(b"\n\n")  # the first such place: words are never empty
                    words, c = _split(words), np.frombuffer(c, np.int64)
                    own = [w for w, n in zip(words, c.tolist()) if n >= LEAST]
                    index, alone, places = dict(zip(words, range(len(words)))), len(own), _places(words, dict(zip(own, range(len(own)))))
                else:
                    body = _large(body)
                    n = int.from_bytes(body[:8], "little")
                    words = _split(body[8 + 4 * n :])
                    at = np.fromiter((index.get(w, -1) for w in words), np.int64, n)
                    place, new = places[at], np.flatnonzero(at < 0)
                    place[new] = [alone + group(words[i]) for i in new]
                    yield _row("part block body", [part], [block], [_small(body[: 8 + 4 * n] + _flat(place) + _flat(np.where(at < 0, 0, c[at])))])

    mine = own.select("part", F.concat("body", F.lit(b"\n\n"), "c").alias("body"))
    return _by_part(mine, cut.where("part >= 0")).mapInArrow(run, "part int, block long, body binary")


def _answer(body: bytes) -> tuple:
    """Numbers in the piece, places, counts."""
    body = _large(body)
    n = int.from_bytes(body[:8], "little")
    return _numbers(body, "<i4", n, 8), _numbers(body, "<i4", n, 8 + 4 * n), _numbers(body, "<i8", n, 8 + 8 * n)


def _at_pieces(answers: DataFrame, cut: DataFrame) -> DataFrame:
    """Each piece's answers by part and then its texts, in one task: block, kind, part, body."""
    both = answers.select("block", F.lit(0).alias("kind"), "part", "body").union(cut.where("part < 0").select("block", F.lit(1), "part", "body"))
    return both.repartition("block").sortWithinPartitions("block", "kind", "part")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Of each piece: block, answers (part, body), texts."""
    for block, rows in groupby(_rows(batches), lambda r: r[0]):
        answers, bodies = [], []
        for _, kind, part, body in rows:
            if kind == 0:
                answers.append((part, body))
            else:
                bodies.insert(0, body)  # the first row has the largest part
        yield block, answers, b"".join(bodies)


def _bigrams(asked: DataFrame, cut: DataFrame) -> DataFrame:
    """Bigrams of each piece's training texts for the parts of both their words: part, block, body, n. Packed are the word's place
    and what the neighbour is to it (0 after it, 1 before it, 2 the word itself, counted a third time), part and place of the
    neighbour, and the count. The end follows itself n times in a row of part `TOTALS`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, answers, body in _read(batches):
            _, _, away, sizes, seq = _texts(body)
            if away.all():
                continue
            found = [(part, *_answer(a)[:2]) for part, a in answers]
            symbol = np.concatenate([[NONE << 32], *[(part << 32) + places.astype(np.int64) for part, _, places in found]])
            known, number = np.unique(symbol, return_inverse=True)  # the end comes first
            of = np.zeros(len(symbol), np.int64)
            of[np.concatenate([[0], *[at for _, at, _ in found]])] = number
            y = of[seq[np.repeat(~away, sizes)]]
            code, n = np.unique(np.concatenate(([0], y[:-1])) * len(known) + y, return_counts=True)  # each text ends with the end
            a, b = code // len(known), code % len(known)
            if code[0] == 0:
                yield _row("part block body n", [TOTALS], [block], [None], [n[0]])
            x, y, same = a > 0, b > 0, (a == b) & (a > 0)
            own, near, n = np.concatenate((a[x], b[y], a[same])), np.concatenate((b[x], a[y], a[same] * 0)), np.concatenate((n[x], n[y], n[same]))
            way = np.repeat([0, 1, 2], [x.sum(), y.sum(), same.sum()])
            order = np.argsort((own * 3 + way) * len(known) + near)
            own, near, n, way = own[order], near[order], n[order], way[order]
            part, place = known >> 32, known & 0xFFFFFFFF
            has, first = np.unique(part[own], return_index=True)
            for p, lo, hi in zip(has, first, [*first[1:], len(own)]):
                yield _row("part block body n", [p], [block], [_packed(place[own[lo:hi]] * 3 + way[lo:hi], part[near[lo:hi]], place[near[lo:hi]], n[lo:hi])], [0])

    return _at_pieces(asked, cut).mapInArrow(run, SURVEY)


def _added(held: list) -> list:
    """Equal links as one: places with ways, neighbours, sums, in this order."""
    own, near, n = (np.concatenate(c) for c in zip(*held))
    held.clear()
    of, place = (near >> 32) + 1, near & 0xFFFFFFFF
    bits = [int(x.max()).bit_length() for x in (own, of, place)]
    if sum(bits) < 63:
        code = (own.astype(np.int64) << (bits[1] + bits[2])) + (of << bits[2]) + place
        order = np.argsort(code, kind="stable")  # fast on the sorted rows of several pieces
        code = code[order]
        first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
        order, sums = order[first], np.add.reduceat(n[order], first)
    else:
        order = np.lexsort((near, own))
        first = np.flatnonzero(np.concatenate(([True], (np.diff(own[order]) != 0) | (np.diff(near[order]) != 0))))
        order, sums = order[first], np.add.reduceat(n[order], first)
    return [(own[order], near[order], sums)]


def linked(asked: DataFrame, cut: DataFrame) -> DataFrame:
    """The training corpus by words: kind, part, block, body, n. Kind 0 lists places of a part whose classes another part (block)
    wants; kind 1 are links of a part, in chunks: place and way, number of the neighbour in the part's lists, count.

    The bigrams are written before they are dealt out to the parts, and are deleted turn by turn: so the shuffle to the pieces, that
    to the parts and the links are never on the disk at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in groupby(_rows(batches), lambda r: r[0]):
            if part == TOTALS:
                yield _row("kind part block body n", [1], [part], [0], [None], [sum(r[3] for r in rows)])
                continue
            held, size, limit = [], 0, HELD_LINKS
            for _, _, body, _ in rows:
                own, of, place, n = _unpacked(body, 4)
                held.append((own.astype(np.int32), (of << 32) + place, n.copy()))
                size += len(own)
                if size > limit:
                    held = _added(held)
                    size = len(held[0][0])
                    limit = HELD_LINKS + size * 5 // 4
            (own, near, n), = _added(held)
            known = np.unique(np.concatenate(([NONE << 32], near)))
            number = np.searchsorted(known, near)
            of, place = known[1:] >> 32, known[1:] & 0xFFFFFFFF
            has, first = np.unique(of, return_index=True)
            for other, lo, hi in zip(has, first, [*first[1:], len(of)]):
                yield _row("kind part block body n", [0], [other], [part], [_packed(place[lo:hi])], [0])
            for i, lo in enumerate(range(0, len(own), ROW_BYTES // 16)):
                to = slice(lo, lo + ROW_BYTES // 16)
                yield _row("kind part block body n", [1], [part], [i], [_packed(own[to], number[to], n[to] & 0xFFFFFFFF, n[to] >> 32)], [0])

    def in_turn() -> Iterator[DataFrame]:
        found = stored(_bigrams(asked, cut).withColumn("turn", F.pmod("part", F.lit(TURNS))), "bigrams", "turn")
        for turn in range(TURNS):
            _swept(cut)
            yield found.where(F.col("turn") == turn).drop("turn").repartition("part").sortWithinPartitions("part", "block").mapInArrow(run, f"kind int, {SURVEY}")
            freed(found, f"turn={turn}")

    return stored_in_turn(in_turn(), "links", "kind")


def _links(body: bytes) -> tuple:
    """Places, ways, numbers of neighbours, counts."""
    own, near, n, high = _unpacked(body, 4)
    place = own // 3
    return place, own - 3 * place, near, (n & 0xFFFFFFFF) + (high << 32)


def _total_rows(total: np.ndarray) -> pa.RecordBatch:
    """Class bigrams by cell as rows of their own part."""
    cell = np.flatnonzero(total)
    none = pa.nulls(len(cell), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([TOTALS] * len(cell), pa.int32()), pa.array(cell, pa.int64()), none, pa.array(total[cell], pa.int64())], names=SURVEY_NAMES)


def _matrix(rows: DataFrame) -> np.ndarray:
    """Class bigrams from the rows of their part."""
    m = np.zeros((CLASSES + 1) ** 2)
    for r in rows.where(F.col("part") == TOTALS).groupBy("block").agg(F.sum("n").alias("n")).collect():  # at most classes squared rows
        m[r.block] = r.n
    return m.reshape(CLASSES + 1, -1)


def _turn(places: np.ndarray, part: int, turn: int) -> np.ndarray:
    """Which words may move this time: half of them."""
    x = (places.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B1) + np.asarray(part, np.uint64) * np.uint64(0x85EBCA77) + np.uint64(turn * 0xC2B2AE3D)
    x = (x ^ (x >> np.uint64(15))) * np.uint64(0x2C1B3C6D)
    return ((x ^ (x >> np.uint64(13))) & np.uint64(1)).astype(bool)


def _near(at: np.ndarray, column: np.ndarray, n: np.ndarray, words: int) -> Iterator[tuple]:
    """Sums of n by word and column, in order, for at most `HELD_CELLS` cells at a time: words, columns, sums."""
    step = max(1, HELD_CELLS // WIDTH)
    for lo in range(0, words, step):
        own = slice(None) if words <= step else (at >= lo) & (at < lo + step)
        cells = np.bincount((at[own] - lo) * WIDTH + column[own], n[own], min(step, words - lo) * WIDTH)
        code = np.flatnonzero(cells)
        yield lo + code // WIDTH, code % WIDTH, cells[code].astype(np.int64)


def surveyed(state: DataFrame, links: DataFrame, turn: int) -> DataFrame:
    """Neighbours by class of the words that may move this time (none after the last), and class bigrams (part `TOTALS`): part,
    block or cell, body, n."""
    k = CLASSES + 1

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = np.zeros(0, np.uint8)
        for part, kind, other, body in _rows(batches):
            if kind == 0:
                classes = np.frombuffer(body, np.uint8)
            else:
                yield _row("part block body", [other], [part], [classes[_unpacked(body, 1)[0]].tobytes()])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k), np.int64)
        for part, rows in groupby(_rows(batches), lambda r: r[0]):
            classes, heard, of = np.zeros(0, np.uint8), [np.zeros(1, np.uint8)], None  # the end has class 0
            for _, kind, block, body in rows:
                if kind == 0:
                    classes = np.frombuffer(body, np.uint8)
                    number = np.full(len(classes), -1)
                    if turn < ROUNDS:
                        word = np.flatnonzero(_turn(np.arange(len(classes)), part, turn))
                        number[word] = np.arange(len(word))
                    continue
                if kind == 1:
                    heard.append(np.frombuffer(body, np.uint8))
                    continue
                of = np.concatenate(heard).astype(np.int64) if of is None else of
                own, way, near, n = _links(body)
                a, b = classes[own].astype(np.int64), of[near]
                column = way * k + b
                cells = np.bincount(column * k + a, n, 3 * k * k).astype(np.int64).reshape(3, k, k)
                total += cells[0].T
                total[0] += cells[1, 0]  # bigrams that begin with the end, which alone has class 0, are those of no part's word
                at = number[own]
                x = at >= 0
                if not x.any():
                    continue
                first = at[x].min()
                for w, near, sums in _near(at[x] - first, column[x], n[x], int(at[x].max() - first) + 1):
                    body = sums.tobytes() + word[first + w].astype(np.int32).tobytes() + near.astype(np.uint8).tobytes()
                    yield _row("part block body n", [part], [block], [body], [0])
        yield _total_rows(total.ravel())

    sent = _by_part(state, links.where("kind = 0")).mapInArrow(send, "part int, block long, body binary")
    mine = state.select("part", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("block"), "body")
    rows = mine.union(sent.select("part", F.lit(1), "block", "body")).union(links.where(f"kind = 1 and part <> {TOTALS}").select("part", F.lit(2), "block", "body"))
    return rows.repartition("part").sortWithinPartitions("part", "kind", "block").mapInArrow(count, SURVEY)


def moved(state: DataFrame, counted: DataFrame, m: np.ndarray, tasks: int) -> DataFrame:
    """Classes after the words of `counted` have moved: part, body."""
    k = CLASSES + 1

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in groupby(_rows(batches), lambda r: r[0]):
            classes = np.frombuffer(next(rows)[3], np.uint8).copy()  # a part's own row comes first
            near = np.zeros(len(classes) * WIDTH, np.int64)
            for _, _, _, body in rows:
                size = len(body) // 13
                n, word = np.frombuffer(body, np.int64, size), np.frombuffer(body, np.int32, size, 8 * size).astype(np.int64)
                np.add.at(near, word * WIDTH + np.frombuffer(body, np.uint8, size, 12 * size), n)  # chunks of links may share a word
            near = near.reshape(-1, WIDTH)
            chosen = np.flatnonzero(near.any(axis=1))
            steps = _steps(m)
            for i in range(0, len(chosen), 500):
                at = chosen[i : i + 500]
                v, own = near[at].astype(float), classes[at].astype(np.int64)
                g = all_gains(m, own, v[:, :k], v[:, k : 2 * k], v[:, -1], steps)
                g[:, 0] = -np.inf  # the end's class takes no words
                to, line = g.argmax(axis=1), np.arange(len(at))
                better = g[line, to] > g[line, own] + 1e-6
                classes[at[better]] = to[better]
            yield _row("part body", [part], [classes.tobytes()])

    return _by_part(state, counted.where(F.col("part") != TOTALS), tasks).mapInArrow(move, "part int, body binary")


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(m: np.ndarray) -> float:
    """Of the class bigrams, but for what no clustering changes."""
    return float(_xlogx(m).sum() - _xlogx(m.sum(axis=0)).sum() - _xlogx(m.sum(axis=1)).sum())


def _steps(m: np.ndarray) -> tuple:
    """For cells and their transpose: x log x, and by n how much it grows in a row of cells that each gain n."""
    return tuple((x, _xlogx(x), np.stack([_xlogx(x + n) - _xlogx(x) for n in range(STEPS)])) for x in (np.ascontiguousarray(m.T), np.ascontiguousarray(m)))


def all_gains(m: np.ndarray, own: np.ndarray, after: np.ndarray, before: np.ndarray, twice: np.ndarray, steps: tuple | None = None) -> np.ndarray:
    """Likelihood, by word and class, of putting a word there, with what it has in its own class taken out first.

    after, before: its neighbours by class, `twice` of them itself. Only cells that a word's neighbours touch are worked out,
    those of small counts by `steps`, which words share.
    """
    line = np.arange(len(own))
    a, b = after.copy(), before.copy()
    a[line, own] -= twice
    b[line, own] -= twice
    out = np.zeros(after.shape)
    for (cells, logs, grown), near, full, other in zip(steps or _steps(m), (a, b), (after, before), (before, after)):
        i, c = np.nonzero(near)
        if not len(i):
            continue
        e, o, n = np.arange(len(i)), own[i], near[i, c]
        small = n < STEPS
        d = grown[np.where(small, n, 0).astype(np.int64), c]
        rest = np.flatnonzero(~small)
        d[rest] = _xlogx(cells[c[rest]] + n[rest, None]) - logs[c[rest]]
        taken = cells[c, o] - full[i, c]  # in the word's own class its own share is not there
        d[e, o] = _xlogx(taken + n) - _xlogx(taken)
        same = np.flatnonzero(c == o)
        if len(same):
            x = cells[c[same]] - other[i[same]]
            at = np.arange(len(same)), o[same]
            x[at] -= full[i[same], c[same]]
            x[at] += twice[i[same]]
            d[same] = _xlogx(x + n[same, None]) - _xlogx(x)
        d[e, c] = 0
        first = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1])))
        out[i[first]] += np.add.reduceat(d, first, axis=0)
    base = np.tile(np.diag(m), (len(own), 1))
    base[line, own] -= after[line, own] + before[line, own] - twice
    out += _xlogx(base + a + b + twice[:, None]) - _xlogx(base)
    # Pairs with the word stay in the sums of its neighbours' classes wherever it goes.
    for sums, near in ((m.sum(axis=1), a), (m.sum(axis=0), b)):
        n = near.sum(axis=1) + twice
        rest = np.tile(sums, (len(own), 1))
        rest[line, own] -= n
        out -= _xlogx(rest + n[:, None]) - _xlogx(rest)
    return out


def gains(m: np.ndarray, own: int, after: np.ndarray, before: np.ndarray, twice: float) -> np.ndarray:
    """`all_gains` of one word."""
    return all_gains(m, np.array([own]), after[None, :].astype(float), before[None, :].astype(float), np.array([float(twice)]))[0]


def _swept(df: DataFrame) -> None:
    """Shuffles of ended jobs leave the disk only with the driver's garbage."""
    gc.collect()
    df.sparkSession._jvm.System.gc()


def exchange(own: DataFrame, cut: DataFrame, parts: int, asked: DataFrame | None = None) -> tuple[DataFrame, np.ndarray]:
    """Classes of each part's words (part, body) and the class bigrams; `asked` are the parts' answers to the pieces, if at hand."""

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, c in _rows(batches):
            c = np.frombuffer(c, np.int64)
            rank = np.argsort(np.argsort(-np.concatenate((c[c >= LEAST], np.zeros(GROUPS, np.int64))), kind="stable"), kind="stable")
            yield _row("part body", [part], [((rank * parts + part) % CLASSES + 1).astype(np.uint8).tobytes()])

    state = stored(own.select("part", "c").mapInArrow(begin, "part int, body binary"), "classes")
    links = linked(stored(asks(own, cut), "asks") if asked is None else asked, cut)
    _swept(own)
    ends = sum(r.n for r in links.where(f"kind = 1 and part = {TOTALS}").select("n").collect())  # one row at most
    tasks = max(min(parts, 12), parts // 3)

    def survey(of: DataFrame, turn: int) -> tuple[np.ndarray, DataFrame]:
        counted = surveyed(of, links, turn).persist(StorageLevel.DISK_ONLY)  # until the words have moved
        m = _matrix(counted)
        m[0, 0] = ends
        return m, counted

    m, counted = survey(state, 0)
    best = likelihood(m)
    for turn in range(ROUNDS):
        new = stored(moved(state, counted, m, tasks), "classes")
        counted.unpersist()
        after, counted = survey(new, turn + 1)
        if (value := likelihood(after)) > best:
            state, m, best = new, after, value
        elif turn + 1 < ROUNDS:
            counted.unpersist()
            counted = survey(state, turn + 1)[1]
        _swept(own)
    counted.unpersist()
    freed(links)
    return state, m


def classed(own: DataFrame, state: DataFrame) -> DataFrame:
    """Every training word but the end: word, c, k (its class), family (its group)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for body, c, alone, classes in _rows(batches):
            words, alone = _split(body), _split(alone)
            k = np.frombuffer(classes, np.uint8)[_places(words, dict(zip(alone, range(len(alone)))))].astype(np.int32)
            columns = [pa.array(words, pa.binary()), pa.array(np.frombuffer(c, np.int64)), pa.array(k), pa.array(list(map(group, words)), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "c", "k", "family"])

    rows = own.join(state.withColumnRenamed("body", "classes"), "part").select("body", "c", "own", "classes")
    return rows.mapInArrow(run, "word binary, c long, k int, family int")


def _kinds(own: DataFrame, state: DataFrame) -> DataFrame:
    """family, k, c, v: occurrences and number of training words by group and class."""
    k = CLASSES + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for body, c, alone, classes in _rows(batches):
            words, alone = _split(body), _split(alone)
            of = np.frombuffer(classes, np.uint8)[_places(words, dict(zip(alone, range(len(alone)))))]
            cell = np.array(list(map(group, words)), np.int64) * k + of
            v = np.bincount(cell, minlength=GROUPS * k)
            c = np.bincount(cell, np.frombuffer(c, np.int64), GROUPS * k).astype(np.int64)
            has = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array((has // k).astype(np.int32)), pa.array((has % k).astype(np.int32)), pa.array(c[has]), pa.array(v[has])], names=["family", "k", "c", "v"])

    rows = own.join(state.withColumnRenamed("body", "classes"), "part").select("body", "c", "own", "classes")
    return rows.mapInArrow(run, "family int, k int, c long, v long").groupBy("family", "k").agg(F.sum("c").alias("c"), F.sum("v").alias("v"))


def score(docs: DataFrame) -> DataFrame:
    """Scores of all texts by a model of those that are not held out."""
    spark = docs.sparkSession
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out"))
    held = spark.conf.get(BATCH_BYTES)
    spark.conf.set(BATCH_BYTES, str(HELD_BYTES))  # for all jobs up to the stored scores
    try:
        return _scored(rows)
    finally:
        spark.conf.set(BATCH_BYTES, held)


def _scored(rows: DataFrame) -> DataFrame:
    whole = stored(numbered(rows).withColumn("texts", F.col("part") < 0), "pieces", "texts")
    cut = whole.where("texts").select("block", "part", "body")
    counts = stored(_counted(whole.where("not texts")), "words")
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).head()
    total, types = int(sums.n), int(sums.v)
    parts = max(1, -(-types // PART))
    ends = sum(r.c for r in counts.where(F.length("word") == 0).collect())  # at most one row
    own = stored(owners(counts, parts), "parts")
    freed(counts)
    _swept(own)
    asked = stored(asks(own, _lists(whole.where("not texts"), parts)), "asks")
    freed(whole, "texts=false")
    _swept(own)
    state, m = exchange(own, cut, parts, asked)
    frequency, kinds = np.zeros(CLASSES + 1), np.zeros(CLASSES + 1)
    frequency[0], kinds[0] = ends, ends > 0
    in_group = np.zeros((GROUPS, CLASSES + 1))
    for r in _kinds(own, state).collect():  # at most groups x classes rows
        frequency[r.k] += r.c
        kinds[r.k] += r.v
        in_group[r.family, r.k] = r.v
    in_group[:, 1:] += in_group.sum(axis=0)[1:] / (2 * in_group.sum() + 1)  # decides where a group has no words
    unseen = in_group[:, 1:].argmax(axis=1) + 1
    emission = np.log10(frequency + kinds + 1)
    smooth = m + SMOOTH
    transition = np.log10(smooth / smooth.sum(axis=1, keepdims=True))
    floor = np.log10(total + types + 1)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in groupby(_rows(batches), lambda r: r[0]):
            classes = np.zeros(GROUPS, np.uint8)  # of a part without training words
            for _, kind, block, body in rows:
                if kind == 0:
                    classes = np.frombuffer(body, np.uint8)
                else:
                    at, places, c = _answer(body)
                    k = np.where(c > 0, classes[places], unseen[np.maximum(places - (len(classes) - GROUPS), 0)])
                    yield _row("part block body", [part], [block], [_small(len(at).to_bytes(8, "little") + _flat(at) + _flat(k.astype("<i4")) + _flat(c))])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, answers, body in _read(batches):
            ids, null, away, sizes, seq = _texts(body)
            found = [_answer(a) for _, a in answers]
            c = np.full(1 + sum(len(at) for at, _, _ in found), ends, np.int64)
            k = np.zeros(len(c), np.int64)
            for at, of, n in found:
                c[at], k[at] = n, of
            k = k[seq]
            known, logs = np.concatenate(([0], np.cumsum(c[seq] > 0))), np.log10(c + 1)[seq]
            steps, emitted = transition[np.concatenate(([0], k[:-1])), k], emission[k]  # each text ends with the end
            hi = np.cumsum(sizes)
            lo = hi - sizes
            spans = [slice(x, y) for x, y in zip(lo.tolist(), hi.tolist())]
            seen = np.array([logs[x].sum() for x in spans])
            score = seen + np.array([steps[x].sum() - emitted[x].sum() for x in spans])
            columns = [pa.array(ids, mask=null), pa.array(away), pa.array(sizes), pa.array(known[hi] - known[lo]), pa.array(np.full(len(ids), total)), pa.array(seen - sizes * floor), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    answers = _by_part(state, asked).mapInArrow(send, "part int, block long, body binary")
    return stored(_at_pieces(answers, cut).mapInArrow(judge, RESULT), "scores")
