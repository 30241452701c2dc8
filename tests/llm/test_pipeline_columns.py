"""Extra columns of any name pass through every stage of the pipeline."""

from __future__ import annotations

import shutil

from pyspark.sql import functions as F

import corpus_pipeline

#: Names that a stage adds or an operator uses for itself, in other case, and names that need quotes.
NAMES = (
    "score", "ambiguous", "lang_pred", "n_grams", "__text", "size", "source_size", "target", "copies", "taken", "mix_size", "__rows", "__r", "__d", "__k", "__s", "__n",
    "key", "removed", "spans", "items", "n_words", "component_id", "n_shingles", "__extra0", "SCORE", "a.b", "with space", "rows", "x",
)


def extended(spark, base, folder):
    docs = spark.read.parquet(f"{base}/documents.parquet")
    for i, name in enumerate(n for n in NAMES if n != "SCORE"):
        docs = docs.withColumn(name, F.concat(F.lit(f"{i}:"), F.col("doc_id").cast("string")))
    docs.write.parquet(f"{folder}/documents.parquet")
    shutil.copy(f"{base}/benchmark.parquet", f"{folder}/benchmark.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_every_stage_keeps_them(spark, tmp_path):
    base = "/root/testdata/sf0.001"
    docs = extended(spark, base, tmp_path)
    plain = spark.read.parquet(f"{base}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out, want = stage(spark, docs, str(tmp_path)), stage(spark, plain, base)
        last = name == corpus_pipeline.STAGES[-1][0]
        assert out.columns[: len(docs.columns)] == docs.columns and (last or out.columns == docs.columns)
        rows = out.collect()
        assert sorted(repr(r.doc_id) for r in rows) == sorted(repr(r.doc_id) for r in want.select("doc_id").collect())
        for r in rows[:50]:
            assert all(r[c] == f"{i}:{r.doc_id}" for i, c in enumerate(n for n in NAMES if n != "SCORE"))
        if last:
            added = out.columns[len(docs.columns) :]
            assert added == ["mix_mix_size", "mix_source_size", "mix_target", "mix_copies", "mix_taken"]
            mixed = {(r.doc_id, r.size, r.taken) for r in want.collect()}
            assert {(r.doc_id, r.mix_mix_size, r.mix_taken) for r in rows} == mixed


def test_other_case(spark):
    """A column that differs from one of documents, or from an added one, by case alone."""
    with_case = spark.conf.get("spark.sql.caseSensitive")
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("TEXT", F.lit("other")).withColumn("Size", F.lit(1))
    finally:
        spark.conf.set("spark.sql.caseSensitive", with_case)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns[:7] == docs.columns and len(out.limit(3).toPandas()) == 3
