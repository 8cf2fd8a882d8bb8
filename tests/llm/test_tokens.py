"""SentencePiece ids, unigram counts and token files against the libraries."""

import random
import zlib

import numpy as np
import public_tokenizers as files
import pytest
import sentencepiece
from tokenizers import Tokenizer, models, pre_tokenizers

from stationproof.llm import pieces, token_counts, token_file
from tests.llm.data import documents, odd

PIECES, WORDS = files.path("piece_bpe_32k.model"), files.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def strings(seed, letters, n=1500):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_pieces_equal_the_library(library):
    own = pieces.codec(pieces.model_bytes(PIECES))
    texts = ["", " ", "  a", "a  b ", "\n", "a\x00b", "x▁y", "<s>hi</s>", "²." * 3, "日本語 テスト", "a" * 3000, "   " * 50] + strings(3, "ab▁ \ńé日\U0001f600.<0x>AtheT ²")
    for text, raw in zip(texts, own.encode(texts)):
        ids = np.frombuffer(raw, "<i4").tolist()
        assert ids == library.encode(text) and own.decode(ids) == library.decode(ids)


def test_any_ids_decode_as_in_the_library(library):
    own, rng = pieces.codec(pieces.model_bytes(PIECES)), random.Random(5)
    few = [3 + 0xE2, 3 + 0x96, 3 + 0x81, 3 + 0x20, 0, 28705]
    for _ in range(1500):
        ids = [rng.choice([rng.randrange(3, 32000), rng.randrange(3, 259), rng.choice(few)]) for _ in range(rng.randint(0, 6))]
        assert own.decode(ids) == library.decode(ids)
    assert own.decode([1, 415, 2]) == library.decode([1, 415, 2])


def test_pieces_query(spark, library):
    texts = odd(random.Random(1))
    made = pieces.encode(documents(spark, texts), PIECES)
    assert made.columns == ["doc_id", "text", "lang", "source", "n_chars", "keep", "found", "_h", "block", "ids", "decoded"]
    for r in made.collect():
        assert r.ids == library.encode(r.text or "") and r.decoded == library.decode(r.ids)
    assert pieces.digests(made).count() == len(texts)
    assert pieces.decode(made.select("ids"), PIECES).where("decoded is null").count() == 0
    assert pieces.encode(documents(spark, texts).where("false"), PIECES).count() == 0


def test_counts_equal_the_unigram_model(spark):
    own = token_counts.counter(token_counts.model_bytes(PIECES))
    vocabulary = token_counts.vocabulary(token_counts.model_bytes(PIECES))
    model = Tokenizer(models.Unigram([("<unk>", 0.0), *vocabulary], 0, True))
    model.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    texts = ["", None, " ", "a\nb\n\nc", "<0x0A> <unk>", "▁▁"] + strings(1, "abthein ▁\n.,é日\U0001f600<0x>A²eeai ")
    assert own.counts(texts) == [len(model.encode(t or "", add_special_tokens=False).ids) for t in texts]
    rows = token_counts.count_tokens(documents(spark, odd(random.Random(1))), PIECES).collect()
    assert [r.n_tokens for r in rows] == own.counts([r.text for r in rows])


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in ((0, 0), (1, 0), (1, 5), (5, 0), (1000, 100_000), (3000, 2999), (700, 10), (600, 1 << 33)):
        values = np.sort(rng.integers(0, top + 1, n))
        made = token_file.EliasFano.build(values, top)
        assert made.values().tolist() == values.tolist() == [made.select(i) for i in range(n)]
        assert 8 * (len(made.low) + len(made.high)) <= n * (2 + max(1, np.log2(max(top, 1) / max(n, 1)) + 1)) + 32


def test_chunks_equal_the_library():
    model = open(WORDS, encoding="utf-8").read()
    library, own = Tokenizer.from_str(model), token_file.encoder(model)
    texts = [None, "a\x01b", "it's THE DOG's", "J̌A", "　a\xa0b\x85c", "<|endoftext|> x<|startoftext|>y", "İ ΑΣ"] + strings(2, "ab \n\t\x01́éÉJ̌'sST1.<|日\xa0\x85\x1c")
    for text, raw in zip(texts, own.encode(texts)):
        assert np.frombuffer(raw, "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids


def test_latin_texts_need_no_memory_of_chunks():
    model = open(WORDS, encoding="utf-8").read()
    library, own = Tokenizer.from_str(model), token_file.ChunkEncoder(model)
    texts = strings(4, "ab \n\t\x0b\x1c\x00'sSTREVLdm1_.<>-") + ["It'S we'Re'll 'tis ''s !'ve", "THE\x0bdog\x0c's\rcat", "<startoftext>|<"]
    texts += strings(5, "ab 's1.RE" + "".join(c for c in map(chr, range(0xC0, 0x100)) if c.isalpha()))
    for text, raw in zip(texts, own.encode(texts)):
        assert np.frombuffer(raw, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert own.parts.young and not own.known.young
    for raw, text in zip(own.encode(rest := [f"a{chr(c)}b {chr(c)} e\u0301{chr(c)}" for c in range(0x80, 0x180)]), rest):
        assert np.frombuffer(raw, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_token_file_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_file, "BLOCK", 500)
    texts = odd(random.Random(1)) + [(100 + i % 60, f"text {i} on the er") for i in range(200)]
    token_file.write(documents(spark, texts), f"file://{tmp_path}/ids", WORDS, end_id=2, shards=4)
    rows = sorted(token_file.read(spark, f"file://{tmp_path}/ids").collect(), key=lambda r: r.start)
    library = Tokenizer.from_file(WORDS)
    wanted = sorted((i if i is not None else -1, [*library.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in texts)
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_crc32) for r in rows) == sorted((i, len(x), crc(x)) for i, x in wanted)
    assert [r.doc_id if r.doc_id is not None else -1 for r in rows] == [i for i, _ in wanted]
    before = 0
    for r in rows:
        assert r.start == before
        before += r.n_tokens
    token_file.write(documents(spark, texts).where("false"), f"file://{tmp_path}/none", WORDS, end_id=2)
    assert token_file.read(spark, f"file://{tmp_path}/none").count() == 0
