"""Queries over keyed stores and ordered reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import report
from ..sources.buckets import BucketStore, land
from ..storage import shared_dir
from .catalog import query, table


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/textloom/{name}-{uuid.uuid4().hex}"


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def bucket_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user, out of three batches that arrive in the wrong order; the second comes twice."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    store = BucketStore(spark, _folder(spark, "store"), "user_id", "event_id", 16)
    for batch, part in enumerate((2, 0, 0, 1)):
        store.upsert(events.filter(F.col("event_id") % 3 == part), batch)
    return store.read()


@query("""
SELECT page_id, CASE WHEN page_id % 7 = 0 AND html IS NOT NULL THEN 2 ELSE 1 END::BIGINT AS landed,
  sha256(CASE WHEN page_id % 7 = 0 THEN html || '<!-- later -->' ELSE html END) AS sha FROM pages
""")
def snapshot_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages landed, landed again when some have changed, and once more when none has."""
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    later = pages.withColumn("html", F.when(F.col("page_id") % 7 == 0, F.concat("html", F.lit("<!-- later -->"))).otherwise(F.col("html")))
    store = BucketStore(spark, _folder(spark, "snapshots"), "page_id", "landed", 16)
    for now in (pages, later, later):
        land(store, now, "html")
    return store.read().select("page_id", "landed", "sha")


@query("""
SELECT doc_id, row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST) AS line_no,
  CAST(coalesce(sum(coalesce(strlen(text), 0) + 1) OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS starts_at FROM documents
""")
def report_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document's line stands in one report of all, by source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return report.numbered(docs, ["source", "doc_id"], "text").select("doc_id", "line_no", "starts_at")
