"""Benchmark decontamination by a prefix-filtered set join over item-sized windows.

An item's windows are its runs of `window` consecutive words (an item of fewer words,
but not none, is one window).  A window is the ordered set of its word shingles; a document
contains it only if it has every one, so a prefix of one shingle is enough: the
rarest, by counts over all documents.  Documents are joined with windows on that
shingle; the window must fit the document around it (length and position bounds), and
then its words are compared one by one with the document's.

Items never become a broadcast that grows with them: document shingles are
thinned by a bitmap sized by their number, then joined with the windows by Spark's own choice of join.

Defined cases: a null or empty text has no words; a document without words has no hit
and is not contaminated; an item without words has no window; equal windows of
several items count for each of them; repeated rows get a row each; empty tables give empty
results or no hits; columns not named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ragged
from .marks import Marks
from .storage import materialize, share

WINDOW, SHINGLE = 13, 5


def _words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, word starts, word ends, first word of each row, word hashes) by slices."""
    for a, z, data, offs in ragged.parts(column):
        data = ragged.LOWER[data]
        starts, ends, first = ragged.spans(data, offs, ragged.ALNUM)
        yield a, z, data, starts, ends, first, ragged.span_hashes(data, starts, ends)


def _grams(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of its first word) of the k-word shingles inside rows."""
    full = np.flatnonzero(np.diff(first) >= k)
    if not len(full):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(len(words) - k + 1, np.uint64) + words[: len(words) - k + 1]
    with np.errstate(over="ignore"):
        for j in range(1, k):
            h = h * np.uint64(0x9FB21C651E98DF25) + words[j : j + len(h)]
        h = ragged.mix(h + np.uint64(k))
    inside = np.zeros(len(h) + 1, np.int64)
    np.add.at(inside, first[full], 1)
    np.add.at(inside, first[full + 1] - k + 1, -1)
    at = np.flatnonzero(np.cumsum(inside)[:-1] > 0)
    return h[at], at


def item_windows(items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, words, n, shingles, offsets) of every window; n: words of it, offsets: place of each shingle's first word."""
    schema = pa.schema([("item_id", pa.string()), ("words", pa.string()), ("n", pa.int32()), ("shingles", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int32()))])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, _, data, starts, ends, first, hashes in _words(b.column(1)):
                out: list[list] = [[], [], [], [], []]
                for r in range(len(first) - 1):
                    lo, hi = first[r], first[r + 1]
                    n = min(window, hi - lo)
                    k = min(shingle, n)
                    for s in range(lo, hi - n + 1) if n else ():
                        h, at = _grams(hashes[s : s + n], np.array([0, n]), k)
                        row = (b.column(0)[a + r].as_py(), b" ".join(data[x:y].tobytes() for x, y in zip(starts[s : s + n], ends[s : s + n], strict=True)).decode(), n, ragged.signed(h), at)
                        for column, v in zip(out, row, strict=True):
                            column.append(v)
                yield ragged.batch(schema, *out)

    rows = items.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, "item_id string, words string, n int, shingles array<long>, offsets array<int>")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, key, n_words, spans, items) of every row of `docs`.

    key: hash of the text, so that (doc_id, key) tells rows apart; spans: disjoint [start, end) word ranges that are hit; items:
    sorted ids, as strings, of the items with occurring windows.
    """
    spark = docs.sparkSession
    each = materialize(item_windows(items, window, shingle, item_id_col, item_text_col), "windows")
    owners = each.groupBy("words").agg(F.array_sort(F.collect_set("item_id")).alias("owners"))
    windows = each.dropDuplicates(["words"]).drop("item_id")
    parts = windows.select("words", "n", F.explode(F.arrays_zip("shingles", "offsets")).alias("x")).select("words", "n", F.col("x.shingles").alias("s"), F.col("x.offsets").alias("offset"))
    lengths = sorted(r["k"] for r in windows.select(F.least(F.col("n"), F.lit(shingle)).alias("k")).distinct().collect())
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    seen = share(spark, Marks.of(parts, "s"))
    counted = pa.schema([("s", pa.int64()), ("c", pa.int64())])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, _, _, _, first, hashes in _words(b.column(0)):
                for k in lengths:
                    h, _ = _grams(hashes, first, k)
                    s, c = np.unique(h[seen.value.marked(h)], return_counts=True)
                    yield ragged.batch(counted, ragged.signed(s), c)

    counts = rows.select("text").mapInArrow(count, "s long, c long").groupBy("s").agg(F.sum("c").alias("c"))
    ranked = parts.join(counts, "s", "left").groupBy("words", "n").agg(F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "s", "offset")).alias("x"))
    probes = materialize(ranked.filter("x.c > 0").select("words", "n", F.col("x.s").alias("s"), F.col("x.offset").alias("offset")), "probes")
    wanted = share(spark, Marks.of(probes, "s"))
    found_type = pa.list_(pa.struct([("s", pa.int64()), ("at", pa.int32()), ("left", pa.int32()), ("around", pa.string())]))
    matched = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n_words", pa.int64()), ("found", found_type)])

    def match(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, z, data, starts, ends, first, hashes in _words(b.column(2)):
                found: list[list[dict]] = [[] for _ in range(z - a)]
                for k in lengths:
                    h, at = _grams(hashes, first, k)
                    hit = np.flatnonzero(wanted.value.marked(h))
                    for s, i, r in zip(ragged.signed(h[hit]).tolist(), at[hit].tolist(), (np.searchsorted(first, at[hit], "right") - 1).tolist(), strict=True):
                        lo, hi = max(int(first[r]), i - window + k), min(int(first[r + 1]), i + window)
                        around = b" ".join(data[x:y].tobytes() for x, y in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist(), strict=True))
                        found[r].append({"s": s, "at": i - int(first[r]), "left": i - lo, "around": around.decode()})
                yield ragged.batch(matched, b.column(0)[a:z], b.column(1)[a:z], np.diff(first), found)

    keyed = rows.select("doc_id", F.xxhash64("text").alias("key"), "text")
    met = materialize(keyed.mapInArrow(match, "doc_id long, key long, n_words long, found array<struct<s:long,at:int,left:int,around:string>>"), "matches")
    candidates = met.filter(F.size("found") > 0).select("doc_id", "key", "n_words", F.explode("found").alias("x")).select("doc_id", "key", "n_words", "x.*").distinct()
    start = F.col("at") - F.col("offset")
    pairs = candidates.join(probes, "s").filter((start >= 0) & (start + F.col("n") <= F.col("n_words")) & (F.col("left") >= F.col("offset")))
    same = F.array_join(F.slice(F.split("around", " "), F.col("left") - F.col("offset") + 1, F.col("n")), " ") == F.col("words")
    hits = pairs.filter(same).select("doc_id", "key", "words", start.alias("start"), (start + F.col("n")).alias("end"))
    hits = materialize(hits, "hits")
    covered = hits.groupBy("doc_id", "key").agg(_disjoint(F.array_sort(F.collect_set(F.struct("start", "end")))).alias("spans"))
    # windows of the same items count once a document, so a passage of many items gives one row, not one an item
    sets = hits.select("doc_id", "key", "words").distinct().join(owners, "words").select("doc_id", "key", "owners").distinct()
    named = sets.groupBy("doc_id", "key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("owners")))).alias("items"))
    base = met.select("doc_id", "key", "n_words")
    for other in (covered, named):
        other = other.withColumnsRenamed({"doc_id": "d", "key": "k"})
        base = base.join(other, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left").drop("d", "k")
    empty = "cast(array() as array<struct<start:int,end:int>>)"
    return base.select("doc_id", "key", "n_words", F.coalesce("spans", F.expr(empty)).alias("spans"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items")).withColumnRenamed("doc_id", id_col)


def _disjoint(spans: Column) -> Column:
    """Sorted spans with overlapping and touching ones made one."""
    one = lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"))
    empty = F.expr("cast(array() as array<struct<start:int,end:int>>)")

    def add(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"].cast("int")).alias("end"))
        return F.when((F.size(done) > 0) & (s["start"] <= F.try_element_at(done, F.lit(-1))["end"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(one(s))))

    return F.aggregate(spans, empty, add)


def n_hit(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


#: The digest that the registered query returns, as DuckDB SQL over views `documents` and `benchmark`.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark
), i AS (
  SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS words
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM (SELECT *, least(13, len(w)) AS n FROM b WHERE len(w) > 0))
), g AS (
  SELECT r, p, n, array_to_string(w[p:p + n - 1], ' ') AS words
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n)
), h AS (
  SELECT g.r, g.p, g.n, i.item_id FROM g JOIN i USING (n, words)
), hit AS (
  SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM h) GROUP BY r
), it AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM h) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""
