"""Toxicity: the kernel against its definition, the machine on texts it has not seen."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.llm import ragged, toxicity

INSULTS = ["idiot", "moron", "worthless", "disgusting", "clown"]


def words(rng, n):
    return [rng.choice("aeiou") .join(rng.choice(["b", "d", "th", "st", "r", "l", "n", "m"]) for _ in range(rng.randint(2, 4))) for _ in range(n)]


def corpus(seed, n=400, insults=INSULTS):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        toxic = i % 4 == 0
        said = [words(rng, rng.randint(4, 12)) for _ in range(rng.randint(1, 6))]
        if toxic:
            for s in rng.sample(said, max(1, len(said) // 2)):
                s.insert(rng.randrange(len(s)), rng.choice(insults))
        rows.append((i, ". ".join(" ".join(s).capitalize() for s in said) + ".", int(toxic)))
    return rows


@pytest.fixture(scope="module")
def model():
    return toxicity.train([(t.encode(), float(y)) for _, t, y in corpus(1)])


def scores(model, texts):
    return np.concatenate([model.score(d, o) for _, _, d, o in ragged.parts(pa.array(texts, pa.string()))]) if texts else []


def test_kernel_is_that_of_the_definition():
    rng = random.Random(2)
    some = ["idiot", "i.d.i.o.t", "idxiot", "été", "a", "", "aaaaaa", "abababab", *words(rng, 20)]
    units = toxicity.of_words([w.encode() for w in some])
    known = toxicity.landmarks_of(units)
    got = known.kernel(units)
    for i, a in enumerate(some):
        for j, b in enumerate(some):
            k = toxicity.kernel_of(a, b)
            assert got[i, j] == pytest.approx(k**toxicity.POWER if k >= toxicity.FLOOR else 0.0, abs=1e-9)


def test_units():
    text = "You i d i o t. St.upid " + "x" * 40 + "\nend."
    data, offs = ragged.flat(pa.array([text, "", None], pa.string()))
    found, names, number, sentence, rows = toxicity.units(data, offs)
    letters = ["".join(chr(96 + v) if 0 < v < 27 else "." if v == 0 else "" for v in found.letters[a:b].tolist()) for a, b in zip(found.offs[:-1], found.offs[1:], strict=True)]
    said = [letters[i] for i in number]
    assert "idiot" in said and "st.upid" in said and "end" in said and said.count("x" * 24) == 2 and "x" * 16 in said
    assert len(names) == len(set(names.tolist())) and set(rows.tolist()) == {0} and sentence.max() == 2


def test_texts_not_seen(model):
    rows = corpus(7, 200)
    got = scores(model, [t for _, t, _ in rows])
    y = np.array([v for *_, v in rows])
    assert ((got >= 0.7) == (y == 1)).mean() > 0.95


@pytest.mark.parametrize("spelled", ["idiot", "IDIOT", "i d i o t", "i.d.i.o.t", "id-iot", "idxiot", "idiots", "d_i_s_g_u_s_t_i_n_g", "worth*less"])
def test_gaps_and_insertions(model, spelled):
    clean = [t for _, t, y in corpus(8, 80) if not y]
    assert (scores(model, [f"{t} You are {spelled} today." for t in clean]) >= 0.7).mean() > 0.9


def test_odd_texts(model):
    got = scores(model, ["", "   \n ", "...!!", "日本語のテキスト " * 50, "a" * 100_000, "word " * 20_000])
    assert np.isfinite(got).all() and (got < 0.7).all()


def test_spark(spark):
    rows = corpus(1)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, None), (1001, ""), (None, "no id"), (3, rows[3][1])], "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("y", F.lit(1)).repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(5, None), (None, 1)], "doc_id long, toxic int")
    fitted = toxicity.fit(docs, labels, F.col("doc_id") % 3 != 1)
    got = toxicity.score(docs, fitted)
    assert got.count() == len(rows) + 4
    held = got.join(labels, "doc_id").filter("doc_id % 3 = 1 and toxic is not null").toPandas()
    assert ((held.score >= 0.7) == (held.toxic == 1)).mean() > 0.95
    again = toxicity.fit(docs.repartition(5), labels.repartition(2), F.col("doc_id") % 3 != 1)
    assert np.allclose(again.weights, fitted.weights)
    assert toxicity.score(docs.limit(0), fitted).count() == 0
    for few in (labels.limit(0), labels.filter("toxic = 0")):
        assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, few, F.lit(True))).collect()} == {0.0}
