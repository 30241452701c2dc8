"""Queries against their SQL twins on rows that the given tables hold seldom or never."""

from __future__ import annotations

import duckdb

from textloom import registry


def rows_and_twin(spark, folder, name, **tables):
    """Sorted rows of a query and of its twin over small tables."""
    twin = duckdb.connect()
    twin.execute("SET TimeZone = 'UTC'")
    for table, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        twin.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    ours = [tuple(r) for r in registry.queries()[name](spark, str(folder)).collect()]
    return sorted(ours, key=repr), sorted(twin.execute(registry.oracle_sql()[name]).fetchall(), key=repr)


def test_time_labels_of_nothing_and_below(spark, tmp_path):
    values = [0.0, 0.2, 0.25, -0.4, -70.0, -31.0, None, 0.5, 1.0, 29.9, 30.0, 35.0, 44.99, 45.0, 50.0, 59.5, 80.0, 150.0, 560.21]
    events = spark.createDataFrame(list(enumerate(values)), "event_id long, value double")
    ours, theirs = rows_and_twin(spark, tmp_path, "time_labels", events=events)
    assert ours == theirs


def test_eviction_over_ranges_of_odd_rows(spark, tmp_path, monkeypatch):
    """Many ranges, equal times, unknown times, kinds and sizes, sizes below zero; the sums are told by the twin."""
    import random
    from datetime import datetime, timedelta

    from textloom.operators import cache

    monkeypatch.setattr(cache, "RANGE_ROWS", 50)
    r = random.Random(3)
    start = datetime(2024, 1, 3)
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    some = [(i, None if r.random() < 0.02 else start + timedelta(minutes=r.choice((r.randrange(9000), 700, 4000))), i % 7, r.choice(("view", "click", "error", None)) if i % 50 == 0 else "view", r.choice((r.random() * 900, -40.0, None))) for i in range(3000)]
    for n, rows in enumerate((some, [(*x[:4], x[4] and abs(x[4])) for x in some], [(i, start + timedelta(hours=60), 1, "view", 120.0) for i in range(2000)], some[:40], [])):
        folder = tmp_path / str(n)
        folder.mkdir()
        ours, theirs = rows_and_twin(spark, folder, "cache_evict_all", events=spark.createDataFrame(rows, schema))
        assert ours == theirs


def test_eviction_does_not_sum_anew_for_each_row(spark, tmp_path):
    events = spark.range(50).selectExpr("id AS event_id", "timestamp_seconds(id) AS ts", "id AS user_id", "'view' AS event_type", "1.0D AS value")
    events.write.parquet(str(tmp_path / "events.parquet"))
    for name in ("cache_evict", "cache_evict_all"):
        plan = registry.queries()[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert "Window" in plan and "unboundedfollowing" not in plan.lower()


def scored(spark, tmp_path):
    docs = [
        (0, "a", "One small step, l'Été was Red. 'quoted' café"), (1, "a", "STEP"), (2, "a", "One small"), (3, "a", ""), (4, "a", "..."), (5, "a", None), (6, "b", "été"), (7, "b", "Ístanbul was fine DON’T don`t x2 'tis"), (8, "b", "red one"),
        (9, "c", "nothing of it here at all"), (10, None, "One small step"), (11, "b", "one small step one small step for l'ete was red"),
    ]
    items = [(0, "One small step for"), (1, "step by step"), (3, "l’été was red"), (5, "istanbul was fine don't x2"), (6, "red one " * 30)]
    documents = spark.createDataFrame(docs, "doc_id long, source string, text string")
    return dict(documents=documents, benchmark=spark.createDataFrame(items, "item_id long, text string"))


def test_extraction_score_counts_where_texts_lie(spark, tmp_path, monkeypatch):
    from textloom.operators import evaluate

    def refuse(*_):
        raise AssertionError("documents were joined pair by pair")

    with monkeypatch.context() as m:
        m.setattr(evaluate, "found", refuse)
        ours, theirs = rows_and_twin(spark, tmp_path, "extraction_score", **scored(spark, tmp_path))
    assert ours == theirs
    # a reference too large to be held is joined, with the same figures
    monkeypatch.setattr(evaluate, "HELD", 3)
    assert sorted((tuple(r) for r in registry.queries()["extraction_score"](spark, str(tmp_path)).collect()), key=repr) == ours


def test_scores_of_pages_with_references_of_their_own(spark, monkeypatch):
    from textloom.operators import evaluate

    blocks = spark.createDataFrame([("a", 1, "text", "one two three four"), ("a", 2, "heading", "five"), ("b", 1, "text", "two three"), ("b", 2, "text", "one two three"), ("c", 1, "text", "one two three"), ("d", 1, "text", "one"), ("f", 1, "text", "İstanbul σας fine don't x2 iv")], "page string, block long, kind string, text string")
    texts = spark.createDataFrame([("a", 7, "one two five three four"), ("b", 7, "one two three"), ("b", 8, "five"), ("c", 7, "three two one"), ("e", 1, "one two three"), ("c", 9, "two"), ("c", 10, None), ("f", 7, "İstanbul ΣΑΣ ﬁne don’t don`t x² Ⅳ"), ("f", 8, "ΣΑΣ Straße")], "page string, block long, text string")
    reference = evaluate.tokenised(blocks, "page", "block", "kind")
    want = sorted(map(tuple, evaluate.score(reference, evaluate.tokenised(texts, "page", "block"), "page", "block").collect()))
    assert sorted(map(tuple, evaluate.score_texts(reference, texts, "page", "block").collect())) == want
