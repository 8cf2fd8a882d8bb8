"""Small odd tables for the text operators."""

import random

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, ids string, keep int, found string, _h int, block int"


def documents(spark, texts):
    """A documents table with extra columns whose names clash with inner ones; texts are (doc_id, text)."""
    rows = [(i, t, "en", "s", len(t or ""), "x", 1, "y", 2, 3) for i, t in texts]
    return spark.createDataFrame(rows, DOC)


def prose(rng: random.Random, n: int, syllables=("the", "on", "er", "re", "tion", "an", "in", "é", "st", "ou")) -> str:
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


def odd(rng: random.Random) -> list:
    """Nulls, empty, blank, very long, non-ASCII and repeated texts."""
    long = prose(rng, 20_000)
    return [(None, "null id the on er"), (1, None), (2, ""), (3, " \n\t "), (4, "x"), (5, long), (6, "ÉÉ é́ 日本\U0001f600 \x00\x1c a"), (6, "ÉÉ é́ 日本\U0001f600 \x00\x1c a"), (7, "word"), (7, "other words")]
