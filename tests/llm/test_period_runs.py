"""Periodic runs against the definition."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from textloom.llm import period_runs, queries


def planted(rng, n, vocabulary):
    words = [rng.randrange(vocabulary) for _ in range(n)]
    for _ in range(rng.randrange(3)):
        if n > 14:
            a, p = rng.randrange(n - 12), rng.randint(1, 10)
            for i in range(a + p, rng.randint(a + 12, n)):
                words[i] = words[i - p]
    return words


@pytest.mark.parametrize(("least", "need"), [(12, 2), (12, 3), (6, 2)])
def test_runs_are_those_of_the_definition(least, need):
    rng = random.Random(least * need)
    for _ in range(400):
        words = planted(rng, rng.choice([0, 3, 11, 12, 13, 20, 40, 60]), rng.choice([1, 2, 3, 30]))
        ids = period_runs.word_ids([b"%d" % w for w in words])
        assert period_runs.runs_of(ids, least=least, need=need) == period_runs.brute(words, least, need)


def test_blocks_of_probes(monkeypatch):
    monkeypatch.setattr(period_runs, "PROBES", 7)
    rng = random.Random(3)
    for _ in range(100):
        words = planted(rng, 60, 3)
        assert period_runs.runs_of(period_runs.word_ids([b"%d" % w for w in words])) == period_runs.brute(words)


def brute_row(doc_id, text):
    """The row of the contract, by plain loops."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = period_runs.brute(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    exponent = None if best[0] is None else 1000 * best[1] // best[2]
    return (doc_id, len(runs), best[0], best[1], best[2], exponent, sha("".join(f"{s},{x},{q}\n" for s, x, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def rows_of_all_kinds():
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{x}é" for x in planted(rng, rng.choice([0, 5, 30, 90]), rng.choice([1, 3, 40])))) for i in range(150)]
    return rows + [(200, None), (201, ""), (202, " \n\t "), (203, "a\u00a0b " * 40), (204, "x\x0by\x0cz\r" * 9), (204, "x\x0by\x0cz\r" * 9), (None, "p q r " * 8), (206, "a b " * 40), (205, "long " * 300 + " ".join(map(str, range(400))) * 2)]


def test_query(spark, tmp_path):
    rows = rows_of_all_kinds()
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit(1)).withColumn("key", F.lit("x")).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_period_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(brute_row(*r)) for r in rows)
    assert any(zlib.crc32(str(d).encode()) % 10 == 0 and t for d, t in rows)


def test_ranges_of_lags(spark):
    """Documents of more lags than a unit holds, repeated rows among them, give the runs of one unit."""
    rows = rows_of_all_kinds()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("parts", F.lit(0))
    flat = lambda found: sorted((repr(r.doc_id), r.n_words, r.collapsed, repr(r.runs)) for r in found.collect())
    assert flat(period_runs.find_runs(df, lags=7)) == flat(period_runs.find_runs(df))
    assert period_runs.find_runs(df.limit(0)).count() == 0
