"""Reports in one global order, without a task that holds them whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize

PER_FILE = 1_000_000


def _ranged(rows: DataFrame, order: list[str], per_file: int) -> DataFrame:
    return rows.repartitionByRange(max(-(-rows.count() // per_file), 1), *order)


def numbered(rows: DataFrame, order: list[str], text: str, per_file: int = PER_FILE) -> DataFrame:
    """Rows with line_no, from 1, and starts_at, the byte at which each line of `text` begins where every line ends in one line feed.

    The order has to tell all rows apart, so that ranges can part them; nulls come first, and a null text is an empty line.  Ranges are
    written, numbered within, and moved on by the sums of the ranges before: one small row a range.
    """
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    ranged = materialize(_ranged(rows, order, per_file).select("*", F.spark_partition_id().alias("__range"), size.alias("__size")), "ranged")
    sums = ranged.groupBy("__range").agg(F.count("*").alias("__n"), F.sum("__size").alias("__bytes"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("__range").alias("__r"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__lines"), F.coalesce(F.sum("__bytes").over(before), F.lit(0)).alias("__offset"))
    within = Window.partitionBy("__range").orderBy(*order)
    upto = within.rowsBetween(Window.unboundedPreceding, -1)
    # one row a range, of which there are as many as files
    out = ranged.join(F.broadcast(starts), F.col("__range") == F.col("__r"))
    out = out.withColumn("line_no", F.row_number().over(within) + F.col("__lines")).withColumn("starts_at", F.coalesce(F.sum("__size").over(upto), F.lit(0)) + F.col("__offset"))
    return out.drop("__range", "__r", "__size", "__lines", "__offset")


def write_report(rows: DataFrame, order: list[str], text: str, path: str, per_file: int = PER_FILE) -> None:
    """Lines of `text` as files whose names are in the order of their lines; the folder has _SUCCESS once all are there."""
    ranged = _ranged(rows, order, per_file).sortWithinPartitions(*order)
    ranged.select(F.coalesce(text, F.lit("")).alias("value")).write.text(path)
