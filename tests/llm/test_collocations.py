"""Phrase collocations against plain counting."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import collocations


def texts(seed, n=150):
    rng = random.Random(seed)
    words = ["the", "OF", "new", "york", "city", "a", "é", "la vie", "x\x01y"]
    rows = []
    for _ in range(n):
        out = []
        for _ in range(rng.randint(0, 40)):
            out.append(rng.choice(["new york city", "a a a a a a", "of the", "the of the of", *words, *words]))
            out.append(rng.choice([" ", " ", "  ", "\t", ", ", "\n", "\x0b", "! "]))
        rows.append(("".join(out), rng.choice(["en", "en", "fr", None, "und"])))
    return rows + [(None, "en"), ("", None), (" .,;:!?\n\x0c\r ", "fr"), ("one two three", "de"), ("new york city " * 300, "en"), ("new york city " * 300, "en")]


@pytest.mark.parametrize(("seed", "min_count", "top", "block"), [(1, 5, 2000, 1 << 22), (2, 3, 7, 1 << 22), (3, 5, 2000, 4)])
def test_phrases_are_those_of_plain_counting(spark, seed, min_count, top, block):
    """Whatever the number of candidates in a block."""
    rows = texts(seed)
    df = spark.createDataFrame(rows, "text string, lang string").withColumn("slot", F.lit(1)).withColumn("key", F.lit("x")).repartition(5)
    got = collocations.mine(df, min_count=min_count, top=top, block=block)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = sorted(collocations.brute(rows, min_count, top))
    assert sorted(map(tuple, got.collect())) == want and len(want) > 4


def test_words_that_few_mappers_name(spark, monkeypatch):
    """With less than one namer a word most words are missed at first."""
    monkeypatch.setattr(collocations, "NAMERS", 0.6)
    rows = texts(6)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(6)
    assert sorted(map(tuple, collocations.mine(df, min_count=5).collect())) == sorted(collocations.brute(rows, 5, 2000))


def test_nothing_frequent(spark):
    df = spark.createDataFrame(texts(4, 5), "text string, lang string")
    assert collocations.mine(df, min_count=10**6).count() == 0 and collocations.mine(df.limit(0)).count() == 0
    assert collocations.mine(spark.createDataFrame([("a, b, " * 50, "en")], "text string, lang string"), min_count=10).count() == 0


def test_sums_wider_than_64_bits(spark):
    """Scores are exact where the products pass 64 bits."""
    a, n, left, right = 3 * 10**9 + 7, 10**13 + 9, 4 * 10**9 + 1, 10**10 + 3
    df = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long")
    assert df.select(collocations._score(*map(F.col, ("a", "n", "l", "r")))).first()[0] == 1000 * a * n // (left * right)


def test_perfect_hash():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 63, 1000, 20000):
        keys = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        found = collocations.PerfectHash(keys, keys * np.uint64(3))
        assert sorted(found.slots(keys, keys * np.uint64(3)).tolist()) == list(range(len(keys)))
        others = rng.integers(0, 1 << 63, 500).astype(np.uint64)
        assert (found.slots(others, others * np.uint64(3))[~np.isin(others, keys)] == -1).all()
        assert not len(keys) or (found.slots(keys, keys) == -1).all()


def test_few_chunks_are_held(spark, monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK", 4)
    monkeypatch.setattr(collocations, "HELD", 2)
    monkeypatch.setattr(collocations, "FAN", 2)
    rows = [(np.array(v, np.int32).tobytes(),) for v in ([0, 1, -1, 9, 9], [5, 9, 13, 13, 0], [-1], [2, 2, 2])]
    got = collocations._counts(spark.createDataFrame(rows, "ids binary").repartition(4))
    assert dict(map(tuple, got.collect())) == {0: 2, 1: 1, 9: 3, 5: 1, 13: 2, 2: 3}
