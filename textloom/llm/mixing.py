"""Mixing sources to target weights by Pareto order sampling.

Sources get shares of the total size by weight, each at most `limit` times its own
size, what lies above reshared by weight among the others.  A document's expected
number of copies is its source's share of size times its own relative weight: the whole
part is certain, the rest is an inclusion probability p.  Documents of a source are ranked by
random odds over inclusion odds, (u / (1 - u)) / (p / (1 - p)), and taken in that
order up to the words the certain copies leave open; the document whose size
fits the gap left at the end best, if one narrows it, closes the sample.

No source is sorted in one task: the rank at which the order is cut is found in
two histograms of 1024 cells a source, pre-aggregated before the shuffle, and only
the rows of the one cell where the cut lies, a millionth of the source, are put in exact order.  What is known of the sources
is one small table that each step writes anew with more columns; documents are joined with nothing else.

Defined cases: a null text has size 0; a null source is a source, last in order;
documents of size 0 are never taken; with all sizes 0 every target is 0; ties of rank go
to the smaller doc_id; repeated rows are drawn together or not at all; an empty table gives
an empty result; other columns are ignored.  Reruns agree: u is a hash of the id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sampling import unit
from .storage import materialize

CELLS = 1024
#: Sources up to which their table is broadcast; beyond, Spark joins as it sees fit.
FEW_SOURCES = 10_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights: tuple[int, ...] = (1, 2, 3), limit: int = 3) -> DataFrame:
    """(source, source_size, target) of every source of a table (source, source_size); one row a source is all that meets in one task."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = totals.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1)).withColumn("most", F.col("source_size") * limit)
    order = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(everything) - before) / open_weight
    filled = weighed.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return filled.select("source", "source_size", F.least(F.col("most").cast("double"), F.col("level") * F.col("w")).alias("target"))


def plan(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), limit: int = 3, weight_col: str | None = None, salt: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, p, rank_key, copies, taken, rows): one row for all rows of equal id, source, size and weight, `rows` of them.

    `weight_col`: relative weight of a document within its source (default: all alike); expected copies stop at `limit`.
    """
    own = F.lit(1.0) if weight_col is None else F.greatest(F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0)), F.lit(0.0))
    each = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), own.alias("own"))
    each = each.groupBy("doc_id", "source", "size", "own").agg(F.count("*").alias("rows"))
    each = materialize(each.withColumn("u", unit(F.col("doc_id"), salt)).withColumn("words", F.col("size") * F.col("rows")), "mix-sizes")

    sums = each.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum(F.col("own") * F.col("words")).alias("weighted"))
    sums = materialize(sums, "mix-sums")
    few = sums.count() <= FEW_SOURCES
    state = materialize(_beside(targets(sums, weights, limit), sums.select("source", "weighted")), "mix-goals")

    def ranked(state: DataFrame) -> DataFrame:
        """Every row with its copies for certain, inclusion probability and rank, beside what is known of its source."""
        rows = _beside(each, F.broadcast(state) if few else state)
        expected = F.when((F.col("size") > 0) & (F.col("own") > 0), F.least(F.try_divide(F.col("target") * F.col("own"), F.col("weighted")), F.lit(float(limit))))
        rows = rows.withColumn("expected", F.coalesce(expected, F.lit(0.0))).withColumn("certain", F.floor("expected")).withColumn("p", F.col("expected") - F.col("certain"))
        odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
        rows = rows.withColumn("rank_key", F.when(F.col("p") > 0, odds / (1 + odds)))
        return rows.withColumn("cell", F.floor(F.col("rank_key") * CELLS)).withColumn("fine", F.floor((F.col("rank_key") * CELLS - F.col("cell")) * CELLS))

    def cut(counts: DataFrame, cell: str, within: str) -> DataFrame:
        """(source, cell, before) of the cell of each source in which the words `within` run out, and the words of the cells before it."""
        upto = Window.partitionBy("source").orderBy(cell)
        cum = counts.withColumn("before", F.coalesce(F.sum("words").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        return cum.filter((F.col("before") <= F.col(within)) & (F.col("before") + F.col("words") > F.col(within)))

    cells = ranked(state).groupBy("source", "cell").agg(F.sum("words").alias("words"), F.sum(F.col("certain") * F.col("words")).alias("sure"))
    cells = materialize(cells, "mix-cells")
    state = _beside(state, cells.groupBy("source").agg(F.sum("sure").alias("sure"))).withColumn("open", F.col("target") - F.col("sure"))
    first = cut(_beside(cells.filter("cell IS NOT NULL").drop("sure"), state.select("source", "open")), "cell", "open").select("source", F.col("cell").alias("cut_cell"), F.col("before").alias("before1"))
    state = materialize(_beside(state, first), "mix-cut").withColumn("open1", F.col("open") - F.col("before1"))

    fine = ranked(state).filter(F.col("cell") == F.col("cut_cell")).groupBy("source", "fine").agg(F.sum("words").alias("words"), F.max("open1").alias("open1"))
    second = cut(fine, "fine", "open1").select("source", F.col("fine").alias("cut_fine"), F.col("before").alias("before2"))
    state = materialize(_beside(state, second), "mix-fine").withColumn("open2", F.col("open1") - F.col("before2"))

    here = F.struct("rank_key", "doc_id", "size", "own")
    last = ranked(state).filter((F.col("cell") == F.col("cut_cell")) & (F.col("fine") == F.col("cut_fine")))
    within = Window.partitionBy("source").orderBy("rank_key", "doc_id", "size", "own")
    last = last.withColumn("upto", F.sum("words").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    # the rank of the last document taken: everything at or before it is in
    edge = last.filter(F.col("upto") <= F.col("open2")).groupBy("source").agg(F.max(here).alias("edge"), F.max("upto").alias("upto"))
    gap = F.col("target") - (F.col("sure") + F.col("before1") + F.col("before2") + F.coalesce("upto", F.lit(0)))
    state = materialize(_beside(state, edge).withColumn("gap", gap).drop("open", "open1", "open2", "sure", "before1", "before2", "upto"), "mix-edge")

    def drawn(rows: DataFrame) -> DataFrame:
        past_fine = (F.col("fine") > F.col("cut_fine")) | ((F.col("fine") == F.col("cut_fine")) & (F.col("edge").isNull() | (here > F.col("edge"))))
        past = (F.col("cell") > F.col("cut_cell")) | ((F.col("cell") == F.col("cut_cell")) & past_fine)
        return rows.withColumn("drawn", (F.col("p") > 0) & ~F.coalesce(past, F.lit(False)))

    off = F.abs(F.col("words") - F.col("gap"))
    left = drawn(ranked(state)).filter((F.col("p") > 0) & ~F.col("drawn") & (F.col("gap") > 0) & (off < F.col("gap")))
    closing = left.groupBy("source").agg(F.min(F.struct(off.alias("off"), here.alias("row"))).alias("c")).select("source", F.col("c.row").alias("closing"))
    state = materialize(_beside(state, closing), "mix-closing")
    rows = drawn(ranked(state))
    closes = F.coalesce((F.col("p") > 0) & here.eqNullSafe(F.col("closing")), F.lit(False))
    copies = F.col("certain") + (F.col("drawn") | closes).cast("int")
    return rows.select("doc_id", "source", "size", "source_size", "target", "p", "rank_key", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "rows")


def mix(docs: DataFrame, *args, **options) -> DataFrame:
    """(doc_id, source, size, source_size, target, p, rank_key, copies, taken) of every row; options as of plan()."""
    planned = plan(docs, *args, **options)
    return planned.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))).drop("row", "rows")


def _beside(rows: DataFrame, of_source: DataFrame) -> DataFrame:
    """Rows with the columns of a table of one row a source; the null source is one like any other."""
    theirs = of_source.withColumnRenamed("source", "__source")
    return rows.join(theirs, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")


#: What mix() returns with its default parameters, as DuckDB SQL over a view `documents`.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    (CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w FROM d GROUP BY source
), f AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
      / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s WINDOW o AS (ORDER BY 3 * source_size / w, source ASC NULLS LAST)
), t AS (
  SELECT source, source_size, least((3 * source_size)::DOUBLE, max(level) OVER () * w) AS target FROM f
), e AS (
  SELECT d.*, source_size, target, CASE WHEN size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS expected
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), p AS (
  SELECT *, floor(expected) AS certain, expected - floor(expected) AS p FROM e
), k AS (
  SELECT *, CASE WHEN p > 0 THEN ((u / (1 - u)) / (p / (1 - p))) / (1 + (u / (1 - u)) / (p / (1 - p))) END AS rank_key,
    target - sum(certain * size) OVER (PARTITION BY source) AS open
  FROM p
), r AS (
  SELECT *, p > 0 AND sum(CASE WHEN p > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rank_key ASC NULLS LAST, doc_id, size ROWS UNBOUNDED PRECEDING) <= open AS drawn
  FROM k
), g AS (
  SELECT *, target - sum((certain + drawn::INT) * size) OVER (PARTITION BY source) AS gap FROM r
), c AS (
  SELECT *, p > 0 AND NOT drawn AND gap > 0 AND abs(size - gap) < gap AS fits FROM g
), z AS (
  SELECT *, fits AND row_number() OVER (PARTITION BY source, fits ORDER BY abs(size - gap), rank_key, doc_id) = 1 AS closing FROM c
)
SELECT doc_id, size, source_size, target, CAST((certain + (drawn OR closing)::INT) * size AS BIGINT) AS taken FROM z
"""
