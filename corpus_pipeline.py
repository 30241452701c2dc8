"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet to the
shared folder and reads again as the next stage's docs.  All but the last return the columns of
documents; the last returns the mix: those columns with size, source_size, target, copies and taken.

Columns beyond those of COLUMNS, whatever their names, pass through every stage: inside a stage they bear names of their own.  Where the input has a
column of the name of one that the mix adds, upper and lower case alike, the added one gets `mix_` before its name, as often as it takes.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import decontaminate, langid, line_dedup, mixing, ngram_join
from textloom.llm.sampling import remainder
from textloom.llm.storage import settle

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: What the stages read and may change.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def apart(stage: Stage) -> Stage:
    """The stage with the further columns of its documents under names that nothing else has."""

    @wraps(stage)
    def run_apart(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        own = [c if c in COLUMNS else f"__extra{i}" for i, c in enumerate(docs.columns)]
        out = stage(spark, docs.toDF(*own), sf_dir)
        taken = {c.lower() for c in docs.columns}
        names = list(docs.columns)
        for c in out.columns[len(own) :]:
            while c.lower() in taken:
                c = f"mix_{c}"
            taken.add(c.lower())
            names.append(c)
        return out.toDF(*names)

    return run_apart


@apart
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those that fit no language better than another, of whatever length; the rest stays as it is."""
    model = langid.fit(docs, remainder(F.col("doc_id"), 3) != 1)
    judged = langid.predict(docs, model, carry=tuple(c for c in docs.columns if c != "text") + ("text",))
    rejected = (F.col("lang_pred") == "und") | F.col("ambiguous")
    return judged.filter(~rejected).select(*docs.columns)


@apart
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line, up to one word, go; every document stays, n_chars follows its text."""
    left = line_dedup.apply(docs, settle(lambda: line_dedup.decide(docs), "lines"))
    return left.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*docs.columns)


@apart
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by shingles one stays, the one of the smallest id; documents without words stay."""
    found = settle(lambda: ngram_join.near_duplicates(docs), "groups")
    group = F.when(F.col("n_shingles") > 0, F.col("component_id"))
    # repeated rows of the smallest id are one document; of different texts of that id the first by hash stays
    first = found.filter(group.isNotNull() & group.eqNullSafe(F.col("doc_id"))).groupBy("doc_id").agg(F.min(F.struct("key")).alias("x"), F.count("*").alias("rows"))
    keep = first.select("doc_id", "x.key", "rows").unionByName(found.filter(group.isNull()).select("doc_id", "key", F.lit(1).cast("long").alias("rows")).distinct())
    keep = keep.select(F.col("doc_id").alias("__d"), F.col("key").alias("__k"), F.col("rows").alias("__rows"))
    kept = docs.join(keep, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.xxhash64("text") == F.col("__k")))
    if first.filter("rows > 1").limit(1).count():
        kept = kept.filter("__rows = 1").unionByName(kept.filter("__rows > 1").dropDuplicates(["doc_id", "text"]))
    return kept.select(*docs.columns)


@apart
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more of the words lie in benchmark passages go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = settle(lambda: decontaminate.decontaminate(docs, benchmark), "hits")
    hit = decontaminate.n_hit(F.col("spans"))
    bad = found.filter((hit > 0) & (20 * hit >= F.col("n_words"))).select(F.col("doc_id").alias("__d"), F.col("key").alias("__k"))
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.xxhash64("text") == F.col("__k")), "left_anti").select(*docs.columns)


@apart
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the number of copies and of words that the mix takes of it."""
    mixed = settle(lambda: mixing.plan(docs), "mix").select("doc_id", "source", "size", "source_size", "target", "copies", "taken")
    mixed = mixed.withColumnsRenamed({"doc_id": "__d", "source": "__s", "size": "__n"})
    joined = docs.join(mixed, F.col("doc_id").eqNullSafe(F.col("__d")) & F.col("source").eqNullSafe(F.col("__s")) & (mixing.n_words(F.col("text")) == F.col("__n")), "left")
    return joined.select(*docs.columns, F.col("__n").alias("size"), "source_size", "target", "copies", "taken")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", lines),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", decontamination),
    ("source_mixing", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(partial(stage, spark, docs, sf_dir), f"pipeline-{name}")
    return docs


#: Language identification is a trained model, which SQL cannot express.
ORACLE_SQL = None
