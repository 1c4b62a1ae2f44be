import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string, ids string, kept string, score string, id string, mix_shard string"


@pytest.fixture(scope="session")
def base_text():
    rng = random.Random(7)
    words = ["the", "of", "and", "house", "river", "stone", "light", "walks", "under", "over", "green", "quiet", "morning", "story", "paper", "wind", "glass", "train", "north", "garden"]
    return lambda seed, n: " ".join(random.Random(seed * 1000 + rng.randrange(1)).choices(words, k=n))


@pytest.fixture(scope="session")
def messy(spark, base_text):
    """Documents with nulls in every column, empty and long texts, ties, repeated rows, and columns with clashing names."""
    long = base_text(1, 30_000)
    texts = [None, "", " \n\t ", "one", "a b  c\n\n\nd", "<|endoftext|> \x00 \r\n ### </turn>", "x" * 6000, long, long, *[base_text(i, 40) for i in range(2, 12)], base_text(2, 40)]
    rows = [(i, t, [None, "en", "de"][i % 3], [None, "a", "b", "\U0001f600", "Z"][i % 5], None) for i, t in enumerate(texts)]
    rows += [rows[9], rows[9], (None, "a null id and some words to go with it", None, None, 3), (None, None, None, None, None)]
    return spark.createDataFrame([(*r, "clash", "clash", None, "clash", "clash", "clash") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
