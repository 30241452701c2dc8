"""Evaluation corpora and fixtures as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXPECT = "has array<string>, lacks array<string>, first string, count map<string,int>"


def host_of(url: Column) -> Column:
    """Host without a leading www., empty for what is no link."""
    return F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")), r"^www\.", "")


def slug_of(url: Column) -> Column:
    return F.concat(host_of(url), F.lit("-"), F.substring(F.sha1(url.cast("binary")), 1, 6))


def read_corpus(spark: SparkSession, path: str, only: str | None = None) -> DataFrame:
    """(category, url, slug) of a text file of lines "category url"; blank lines and those that start with # are left out."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    parts = F.split("line", r"\s+")
    rows = lines.select(parts[0].alias("category"), parts[1].alias("url")).withColumn("slug", slug_of(F.col("url")))
    return rows if only is None else rows.filter(F.col("url").contains(only) | F.col("category").contains(only))


def expectation(html: Column) -> Column:
    """STRUCT<has, lacks, first, count> written as JSON in a comment of a fixture page."""
    return F.from_json(F.regexp_extract(html, r"(?s)<!--\s*expect:\s*(\{.*?\})\s*-->", 1), EXPECT)


def read_fixtures(spark: SparkSession, path: str) -> DataFrame:
    """(name, html, want) of a folder of pages."""
    files = spark.read.text(path, wholetext=True).select(F.col("value").alias("html"), F.regexp_extract(F.input_file_name(), r"([^/]+)\.html?$", 1).alias("name"))
    return files.select("name", "html", expectation(F.col("html")).alias("want"))
