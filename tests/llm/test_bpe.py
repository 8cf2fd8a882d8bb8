"""Byte-level BPE against the tokenizers library."""

import json
import random

import numpy as np
import public_tokenizers as files
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stationproof.llm import bpe
from tests.llm.data import documents, odd

PATH = files.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return bpe.codec(bpe.model_text(PATH))


def strings(seed, letters, n=1500):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_ids_and_text_equal_the_library(own, library):
    texts = ["", "  ", " a", "a  b \n", "a" * 3000, "the" * 500, " " * 500, "日本語" * 200, "\x00\x1c\x1f\x85\xa0  a", "it's we'll I'D 'S ½²", "<|endoftext", "<|endoftext|>", "x<|endoftext|><|endoftext|> y"]
    texts += strings(1, "abthe \n's1é日\U0001f600.<|>")
    texts += strings(2, [chr(c) for c in range(0x20, 0xD000, 7)] + [" "] * 900)
    texts += strings(3, [chr(c) for c in range(0xE000, 0x110000, 301)] + [" "] * 300)
    for text, raw in zip(texts, own.encode(texts)):
        ids = np.frombuffer(raw, "<i4").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids, text
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_any_ids_decode_as_in_the_library(own, library):
    rng = random.Random(5)
    for _ in range(3000):
        ids = [rng.randrange(60_000) if rng.random() < 0.3 else rng.randrange(256) for _ in range(rng.randint(0, 8))]
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_row_of_ranks_equals_heap(own):
    for text in strings(7, "abehinorst", 3000):
        word = text.encode()
        assert not word or own.merge_short(word) == own.merge_long(word)


def test_every_character_is_cut_as_in_the_library(own, library):
    letters = [chr(c) for c in range(0x80, 0x30000) if not 0xD800 <= c < 0xE000]
    text = "".join(f"a{c}1{c}!{c} " for c in letters)
    theirs = [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]
    assert own.words(text) == theirs


def test_query(spark, library):
    texts = odd(random.Random(1))
    table = documents(spark, texts).withColumn("a.b", F.lit(1))
    made = bpe.encode(table, PATH)
    assert made.columns == ["doc_id", "text", "lang", "source", "n_chars", "keep", "found", "_h", "block", "a.b", "ids", "decoded"]
    for r in made.collect():
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids and r.decoded == (r.text or "")
    assert bpe.digests(made).count() == len(texts)
    back = bpe.decode(made.select("doc_id", F.when(F.col("doc_id") != 2, F.col("ids")).alias("ids")), PATH)
    assert back.where("decoded is null").count() == 2
    assert bpe.encode(table.where("false"), PATH).count() == 0


def test_other_kinds_of_vocabulary_are_refused():
    spec = json.loads(bpe.model_text(PATH))
    spec["pre_tokenizer"]["add_prefix_space"] = True
    with pytest.raises(ValueError):
        bpe.Codec(json.dumps(spec))
