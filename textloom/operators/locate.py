"""Finding text in text: folded search, pairing of equal texts, word ends, containment in intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WS


def folded(c: Column) -> Column:
    """Quotes, dashes and case folded, length unchanged."""
    return F.lower(F.translate(c, "‘’‚‛“”„‟‐‑‒–—―− ", "''''\"\"\"\"------- "))


def find_from(hay: str, needle: str, start: str) -> Column:
    return F.expr(f"coalesce(nullif(locate({needle}, {hay}, {start} + 1), 0), locate({needle}, {hay})) - 1")


def nearest(hay: str, needle: str, around: str) -> Column:
    """Offset of the hit nearest to `around`, the earlier of two equally near, -1 for none."""
    after = f"locate({needle}, {hay}, greatest({around}, 0) + 1)"
    head = f"substring({hay}, 1, {around} + length({needle}))"
    before = f"CASE WHEN {around} > 0 AND locate(reverse({needle}), reverse({head})) > 0 THEN length({head}) - locate(reverse({needle}), reverse({head})) - length({needle}) + 2 ELSE 0 END"
    return F.expr(f"CASE WHEN {after} = 0 THEN ({before}) - 1 WHEN ({before}) = 0 THEN {after} - 1 WHEN {around} - (({before}) - 1) <= ({after} - 1) - {around} THEN ({before}) - 1 ELSE {after} - 1 END")


def word_ends(text: Column) -> Column:
    """End offsets of the runs without white space."""
    found = F.regexp_extract_all(text, F.lit(f"[{WS}]*[^{WS}]+"), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("ends"))
    step = lambda acc, w: F.struct((acc["at"] + F.length(w)).alias("at"), F.concat(acc["ends"], F.array(acc["at"] + F.length(w))).alias("ends"))
    return F.aggregate(found, start, step, lambda acc: acc["ends"])


def word_at(ends: Column, target: Column, strict: bool = False) -> Column:
    """Index of the first word that ends at or (strict) after a target, else the last."""
    hits = F.filter(F.transform(ends, lambda e, i: F.when(e > target if strict else e >= target, i)), lambda i: i.isNotNull())
    return F.coalesce(F.try_element_at(hits, F.lit(1)), F.size(ends) - 1)


def pair_equal(left: DataFrame, right: DataFrame, text: str, order_left: str, order_right: str) -> DataFrame:
    """Left rows with the right row of the same text, first with first, second with second."""
    number = lambda df, by: df.withColumn("__n", F.row_number().over(Window.partitionBy(text).orderBy(by)))
    return number(left, order_left).join(number(right, order_right), [text, "__n"], "left").drop("__n")


def enclosing(points: DataFrame, intervals: DataFrame, page: str) -> DataFrame:
    """Points (page, point) with the innermost interval (page, id, start, end, depth) that holds them; always joined by page, so never a nested loop over pages."""
    met = points.join(intervals, page).filter((F.col("start") <= F.col("point")) & (F.col("point") <= F.col("end")))
    inner = F.max(F.struct("depth", "start", *[c for c in intervals.columns if c not in (page, "depth", "start")]))
    return met.groupBy(page, "point").agg(inner.alias("__i")).select(page, "point", "__i.*")


def in_document(hay: str, needle: str, start: str) -> Column:
    """Offset of a segment in a folded page from a place on, else anywhere; of one over 80 characters its first 60 will do; -1 for none."""
    whole = find_from(hay, needle, start)
    return F.when(whole >= 0, whole).when(F.length(needle) > 80, F.expr(f"coalesce(nullif(locate(substring({needle}, 1, 60), {hay}, {start} + 1), 0), locate(substring({needle}, 1, 60), {hay})) - 1")).otherwise(-1)


def in_block(block: str, segment: str, base: str) -> Column:
    """Offset of a segment in its block's text: where it was, if it still stands there, else the nearest hit of its folded form; -1 for none."""
    there = F.expr(f"substring({block}, {base} + 1, length({segment})) = {segment}")
    return F.when(there, F.col(base)).otherwise(nearest(f"__{block}", f"__{segment}", base))


def resolved(rows: DataFrame, block: str, base: str, page: str, start: str, segment: str) -> DataFrame:
    """Adds at and by: the offset of a segment in its block, or else in the page, and which of the two; -1 and null for none."""
    out = rows.withColumns({f"__{c}": folded(F.col(c)) for c in (block, segment, page)})
    out = out.withColumn("__b", in_block(block, segment, base)).withColumn("__d", in_document(f"__{page}", f"__{segment}", start))
    out = out.withColumn("by", F.when(F.col("__b") >= 0, "block").when(F.col("__d") >= 0, "page")).withColumn("at", F.when(F.col("__b") >= 0, F.col("__b")).otherwise(F.col("__d")))
    return out.drop(f"__{block}", f"__{segment}", f"__{page}", "__b", "__d")


def relocated(old: DataFrame, new: DataFrame, key: str, tag: str, place: str, text: str) -> DataFrame:
    """Old blocks with found: the first new block of the same key, tag, length and text."""
    first = new.groupBy(key, tag, text).agg(F.min(place).alias("found"))
    return old.join(first, [key, tag, text], "left")


def node_at(lens: Column, offset: Column) -> Column:
    """STRUCT<node, offset> of the node, of those with such lengths end to end, that holds an offset; null past the end."""
    zero = F.struct(F.lit(0).alias("node"), offset.cast("int").alias("offset"), F.lit(False).alias("found"))

    def step(acc: Column, n: Column) -> Column:
        here = acc["found"] | (acc["offset"] < n)
        return F.struct(F.when(here, acc["node"]).otherwise(acc["node"] + 1).alias("node"), F.when(here, acc["offset"]).otherwise(acc["offset"] - n).alias("offset"), here.alias("found"))

    return F.aggregate(lens, zero, step, lambda acc: F.when(acc["found"] & (offset >= 0), F.struct(acc["node"].alias("node"), acc["offset"].alias("offset"))))


def is_live(then: Column, now: Column, start: Column, end: Column) -> Column:
    """Whether the nodes behind a range have kept their lengths; an empty range, or one past the end, has none."""
    a, b = node_at(then, start)["node"], node_at(then, end - 1)["node"]
    same = F.forall(F.sequence(a, b), lambda k: F.coalesce(F.try_element_at(then, k + 1) == F.try_element_at(now, k + 1), F.lit(False)))
    return F.coalesce((end > start) & same, F.lit(False))


def paragraph_at(points: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """Points (key, point) with index: the block (key, index, start, end) around each, else the first that follows, else 0."""
    met = points.join(blocks, key, "left")
    inside = F.max(F.when((F.col("start") <= F.col("point")) & (F.col("point") < F.col("end")), F.col("index")))
    after = F.min(F.when(F.col("start") > F.col("point"), F.col("index")))
    return met.groupBy(key, "point").agg(F.coalesce(inside, after, F.lit(0)).alias("index"))
