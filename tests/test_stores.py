"""Bucketed upserts, snapshot landings and ordered reports."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import report
from textloom.plans import store_plans
from textloom.sources.buckets import BucketStore, land, to_fetch

ROWS = "k long, at long, v string"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_upsert_writes_touched_buckets_only(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path / "s"), "k", "at", 8)
    assert store.read() is None and store.upsert(spark.createDataFrame([], ROWS)) is None
    assert store.upsert(spark.createDataFrame([(k, 1, f"a{k}") for k in range(200)], ROWS), 0) == 1
    before = store.manifest()
    assert len(before.folders) == 8
    assert store.upsert(spark.createDataFrame([(7, 2, "new"), (7, 3, "newer"), (9000, 0, "more")], ROWS), 1) == 2
    after = store.manifest()
    changed = {b for b in after.folders if after.folders[b] != before.folders.get(b)}
    assert 1 <= len(changed) <= 2
    want = {k: (k, 1, f"a{k}") for k in range(200)} | {7: (7, 3, "newer"), 9000: (9000, 0, "more")}
    assert rows_of(store.read()) == sorted(want.values(), key=repr)
    # a batch that is in already changes nothing, nor does an older row
    assert store.upsert(spark.createDataFrame([(7, 9, "again")], ROWS), 1) is None
    store.upsert(spark.createDataFrame([(7, 1, "older")], ROWS), 2)
    assert rows_of(store.read()) == sorted(want.values(), key=repr)
    store.upsert(spark.createDataFrame([(7, 3, "tie: the later batch")], ROWS), 3)
    assert store.read().filter("k = 7").first().v == "tie: the later batch"
    held = rows_of(store.read())
    assert store.vacuum(1) > 0 and rows_of(store.read()) == held and store.vacuum(1) == 0


def test_failed_batch_leaves_the_last_version(spark, tmp_path, monkeypatch):
    store = BucketStore(spark, str(tmp_path / "s"), "k", "at", 4)
    store.upsert(spark.createDataFrame([(1, 1, "a"), (None, 1, "null")], ROWS), 0)
    held = rows_of(store.read())
    with monkeypatch.context() as m:
        m.setattr(BucketStore, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            store.upsert(spark.createDataFrame([(1, 2, "b")], ROWS), 1)
    assert rows_of(store.read()) == held and store.manifest().batch == 0
    assert store.upsert(spark.createDataFrame([(1, 2, "b"), (None, 2, "later")], ROWS), 1) == 2
    assert rows_of(store.read()) == sorted([(1, 2, "b"), (None, 2, "later")], key=repr)


def test_upsert_against_a_plain_loop(spark, tmp_path):
    rng, want = random.Random(6), {}
    store = BucketStore(spark, str(tmp_path / "s"), "k", "at", 5)
    for batch in range(4):
        rows = [(rng.randrange(30), 100 * rng.randrange(50) + i, f"{batch}.{i}") for i in range(40)]
        for r in sorted(rows, key=lambda r: r[1]):
            if r[0] not in want or r[1] >= want[r[0]][1]:
                want[r[0]] = r
        store.upsert(spark.createDataFrame(rows, ROWS), batch)
    assert rows_of(store.read()) == sorted(want.values(), key=repr)


def test_landing_twice_writes_nothing_new(spark, tmp_path):
    pages = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "page_id long, html string")
    store = BucketStore(spark, str(tmp_path / "s"), "page_id", "landed", 4)
    assert to_fetch(store, pages).count() == 3
    assert land(store, pages, "html") == 1 and land(store, pages, "html") is None
    assert to_fetch(store, pages.unionByName(spark.createDataFrame([(4, "d")], pages.schema))).select("page_id").collect() == [(4,)]
    assert to_fetch(store, pages, F.col("page_id") == 2).select("page_id").collect() == [(2,)]
    assert land(store, spark.createDataFrame([(2, "B"), (1, "a")], pages.schema), "html") == 2
    assert rows_of(store.read().select("page_id", "html", "landed")) == [(1, "a", 1), (2, "B", 2), (3, None, 1)]


@pytest.mark.parametrize("per_file", [7, 1000])
def test_report_is_in_one_order(spark, tmp_path, per_file):
    rng = random.Random(per_file)
    rows = [(rng.choice(["x", "y", None]), i, "é" * rng.randrange(4) if i % 9 else None) for i in range(100)]
    df = spark.createDataFrame(rows, "a string, i long, t string").repartition(5)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    want, at = {}, 0
    for n, (_, i, t) in enumerate(ordered):
        want[i] = (n + 1, at)
        at += len((t or "").encode()) + 1
    got = {r.i: (r.line_no, r.starts_at) for r in report.numbered(df, ["a", "i"], "t", per_file).collect()}
    assert got == want
    report.write_report(df, ["a", "i"], "t", str(tmp_path / "r"), per_file)
    files = sorted((tmp_path / "r").glob("part-*"))
    assert "".join(f.read_text() for f in files) == "".join((t or "") + "\n" for _, _, t in ordered)
    assert (tmp_path / "r/_SUCCESS").exists() and (per_file > 100 or len(files) > 5)
    assert report.numbered(df.limit(0), ["a", "i"], "t").count() == 0


@pytest.mark.parametrize("name", ["bucket_upserts", "snapshot_landing", "report_order"])
def test_queries_against_their_twins(spark, name):
    import duckdb

    sf_dir = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("events", "pages", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got = getattr(store_plans, name)(spark, sf_dir)
    found = con.execute(store_plans.query.__globals__["SQL"][name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(got.columns)
    assert rows_of(got.select(*names)) == sorted(found.fetchall(), key=repr)
