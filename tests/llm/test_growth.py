"""Groups that grow: one passage in many documents, forms that almost are near-duplicates."""

from __future__ import annotations

import random

import numpy as np
import pytest

from textloom.llm import ngram_join, suffix_dedup

DOCS = "doc_id long, text string"


def written(monkeypatch, module):
    """{name: tables} that a module materialises from now on."""
    tables: dict[str, list] = {}
    write = module.materialize

    def counted(df, name):
        out = write(df, name)
        tables.setdefault(name, []).append(out)
        return out

    monkeypatch.setattr(module, "materialize", counted)
    return tables


def letters(rng, n):
    return "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n))


@pytest.mark.parametrize("heavy", [4096, 100])
def test_one_passage_in_many_documents(spark, monkeypatch, heavy):
    """No task is dealt more than LARGE blocks of one core, salted or not; every copy of the passage goes."""
    monkeypatch.setattr(suffix_dedup, "HEAVY", heavy)
    tables = written(monkeypatch, suffix_dedup)
    rng = random.Random(heavy)
    passage = letters(rng, 420)
    rows = [(d, letters(rng, 150) + str(d) + "#" + passage + "#" + str(d) + letters(rng, 150)) for d in range(2300)]
    got = suffix_dedup.find_repeats(spark.createDataFrame(rows, DOCS).repartition(8)).collect()
    assert len(got) == 2300
    gone = {r.doc_id: (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), r.kept_sha256) for r in got}
    assert gone == suffix_dedup.brute(dict(rows))
    assert min(x[1] for x in gone.values()) >= 420
    contents = tables["contents"][0]
    assert contents.filter("hot").count() > 2300
    assert (contents.filter("NOT hot").groupBy("shard").count().agg({"count": "max"}).first()[0] or 0) <= suffix_dedup.LARGE


def test_large_cores_against_brute(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "LARGE", 3)
    monkeypatch.setattr(suffix_dedup, "HEAVY", 5)
    rng = random.Random(4)
    passages = [letters(rng, n) for n in (61, 75, 140)]
    rows = [(d, letters(rng, rng.randint(0, 90)) + rng.choice(passages)[rng.randint(0, 3) :] + letters(rng, rng.randint(0, 90))) for d in range(60)]
    got = {r.doc_id: (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), r.kept_sha256) for r in suffix_dedup.find_repeats(spark.createDataFrame(rows, DOCS), 60, 30).collect()}
    assert got == suffix_dedup.brute(dict(rows), 60)


def test_first_shared_is_exact_by_place():
    rng = np.random.default_rng(5)
    for percent in (80, 60):
        token, n = np.sort(rng.integers(0, 12, 200)), rng.integers(3, 40, 200)
        at = (rng.random(200) * n * 0.5).astype(np.int64)
        several = rng.random(200) < 0.1
        order = np.lexsort((n, token))
        token, n, at, several = token[order], n[order], at[order], several[order]
        want = [
            i
            for i in range(200)
            if any(token[i] == token[j] and (i != j or several[i]) and (100 + percent) * min(n[i] - at[i], n[j] - at[j]) >= percent * (n[i] + n[j]) for j in range(200))
        ]
        got = ngram_join.first_shared(token, n, at, several, percent)
        # sizes outside the ratio never reach the overlap, so both say the same
        assert got.tolist() == want
    assert len(ngram_join.first_shared(*(np.zeros(0, np.int64),) * 3, np.zeros(0, bool), 80)) == 0


@pytest.mark.parametrize("hot", [16, 4])
def test_forms_below_the_threshold_meet_nowhere(spark, monkeypatch, hot):
    """Forms of 104 words, 8 of them own: 88 of 112 shingles are shared, 0.786.  Each has a near copy, so that none is screened out before."""
    monkeypatch.setattr(ngram_join, "HOT_LEVEL", hot)
    monkeypatch.setattr(ngram_join, "BLOCK", 32)
    tables = written(monkeypatch, ngram_join)
    met, sent = {}, {}
    for size in (250, 500, 1000):
        rows = []
        for d in range(size):
            w = [f"form{i}" for i in range(104)]
            w[40:48] = [f"own{d}x{i}" for i in range(8)]
            rows += [(2 * d, " ".join(w)), (2 * d + 1, " ".join([*w, f"tail{d}"]))]
        tables.clear()
        got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
        assert got == {d: d - d % 2 for d in range(2 * size)}
        met[size] = tables["clusters"][0].count()
        sent[size] = sum(t.count() for t in tables.get("sent", []))
    assert all(met[size] <= 4 * size and sent[size] <= 4 * size for size in met), (met, sent)


def test_a_group_of_copies_meets_nothing(spark, monkeypatch):
    """Texts with an exact copy are decided by their number alone: none waits for its spans, and their join reads a table, whose side Spark deals anew."""
    tables = written(monkeypatch, suffix_dedup)
    rng = random.Random(8)
    passage, copied = letters(rng, 500), letters(rng, 900)
    rows = [(d, copied) for d in range(400)] + [(400 + d, letters(rng, 80) + passage + letters(rng, 80)) for d in range(3)] + [(403, letters(rng, 50) + copied[100:800]), (404, letters(rng, 700)), (405, None)]
    got = {r.doc_id: (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), r.kept_sha256) for r in suffix_dedup.find_repeats(spark.createDataFrame(rows, DOCS).repartition(8)).collect()}
    assert got == suffix_dedup.brute(dict(rows))
    assert tables["found"][0].count() == 4
    assert [r.copies for r in tables["copies"][0].collect()] == [400]
