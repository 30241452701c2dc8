"""Exact top-k search by MaxScore over integer vectors.

A query's terms are its non-zero components.  In a block of similar candidates a term
adds at most |q| times the spread of that component above the block's floor, so a
block has an upper bound, and blocks that cannot reach the k-th score so far
are never opened.  Over the blocks left, terms are ordered by bound: the largest are
essential, the rest together cannot lift a candidate from the floor past the
threshold.  The essential components are summed for all candidates left; the others
are probed only for candidates whose sum plus the bounds still open is competitive.
Each shard of candidates returns its k best a query and the shards' lists are merged.

Queries go to the shards in blocks of at most about QUERY_BYTES, so what is
broadcast does not grow with the data.

Defined cases: vectors that are null, or hold a null or non-finite component, and rows of
null id take no part; missing components of shorter vectors count as 0; equal scores go to
the smaller id; a repeated row is a candidate for its twin and gets its own results; fewer than k
candidates give all; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize

#: Bytes of query vectors that are broadcast at once, and of candidates that a task holds.
QUERY_BYTES, SHARD_BYTES = 1 << 24, 1 << 27
#: Fewer rows than this are not worth a shard of their own.
LEAST_SHARD = 8_192
BLOCK_ROWS = 256
PIVOTS = 48


class Shard:
    """Candidates of one task, laid out in blocks of similar vectors."""

    def __init__(self, uid: np.ndarray, ids: np.ndarray, vectors: np.ndarray):
        pivots = vectors[np.linspace(0, len(vectors) - 1, min(PIVOTS, len(vectors))).astype(int)].astype(np.float32)
        length = np.maximum(np.sqrt((pivots**2).sum(axis=1)), 1)
        near = np.concatenate([(vectors[i : i + 65536].astype(np.float32) @ (pivots / length[:, None]).T).argmax(axis=1) for i in range(0, len(vectors), 65536)])
        order = np.lexsort((ids, near))
        self.uid, self.ids, self.vectors = uid[order], ids[order], np.ascontiguousarray(vectors[order])
        cuts = np.flatnonzero(np.diff(near[order])) + 1
        begins = sorted({b for a, z in zip([0, *cuts], [*cuts, len(order)], strict=True) for b in range(a, z, BLOCK_ROWS)})
        self.begins = np.array([*begins, len(order)])
        self.low = np.minimum.reduceat(self.vectors, self.begins[:-1], axis=0)
        self.high = np.maximum.reduceat(self.vectors, self.begins[:-1], axis=0)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """queries x blocks: the most that a member of the block can score."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, q: np.ndarray, own: int, most: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(row numbers, scores) of the k best candidates, best first."""
        order = np.argsort(-most, kind="stable")
        sizes = np.diff(self.begins)
        lead = int(np.searchsorted(np.cumsum(sizes[order]), k + 1)) + 1  # enough blocks for k candidates beside the query's own
        rows = self._rows(order[:lead])
        score = self.vectors[rows] @ q
        rows, score = self._best(rows, score, own, k)
        floor = score[-1] if len(rows) == k else -np.inf
        rest = order[lead:]
        rest = rest[most[rest] >= floor]
        if len(rest):
            more, values = self._competitive(q, rest, floor)
            rows, score = self._best(np.concatenate([rows, more]), np.concatenate([score, values]), own, k)
        return rows, score

    def _rows(self, blocks: np.ndarray) -> np.ndarray:
        return np.concatenate([np.arange(self.begins[b], self.begins[b + 1]) for b in blocks])

    def _competitive(self, q: np.ndarray, blocks: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        low, high = self.low[blocks].min(axis=0), self.high[blocks].max(axis=0)
        terms = np.flatnonzero(q)
        top = np.where(q > 0, q * high, q * low)[terms]
        base = np.where(q > 0, q * low, q * high)[terms]
        bound = top - base
        by_bound = np.argsort(-bound, kind="stable")
        terms, bound, base = terms[by_bound], bound[by_bound], base[by_bound]
        # open[i]: what the terms from i on can add to the floor
        open_ = np.concatenate([np.cumsum(bound[::-1])[::-1], [0]])
        essential = int(np.searchsorted(-open_, -(threshold - base.sum()), "right")) if np.isfinite(threshold) else len(terms)
        essential = max(1, min(essential, len(terms)))
        rows = self._rows(blocks)
        score = self.vectors[np.ix_(rows, terms[:essential])] @ q[terms[:essential]]
        at = essential
        while at < len(terms):
            alive = score + open_[at] + base[at:].sum() >= threshold
            rows, score = rows[alive], score[alive]
            step = min(len(terms), at + 8)
            score = score + self.vectors[np.ix_(rows, terms[at:step])] @ q[terms[at:step]]
            at = step
        return rows, score

    def _best(self, rows: np.ndarray, score: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        keep = self.uid[rows] != own
        rows, score = rows[keep], score[keep]
        if len(rows) > 4 * k:  # ties at the k-th score stay in
            edge = np.partition(score, len(score) - k)[len(score) - k]
            rows, score = rows[score >= edge], score[score >= edge]
        order = np.lexsort((self.ids[rows], -score))[:k]
        return rows[order], score[order]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offs = np.asarray(column.offsets)
    values = np.asarray(column.values)[offs[0] : offs[-1]] if len(column) else np.zeros(0, np.int64)
    n = np.diff(offs)
    out = np.zeros((len(column), dims), np.int64)
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(values)) - (offs[:-1] - offs[0])[row]] = values
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of largest inner product of floor(scale * x), for rows where `is_query`, over a column vec_id, holds."""
    spark = vectors.sparkSession
    x = F.col(vector_col)
    sound = F.col(id_col).isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    ints = F.transform(x, lambda v: F.floor(v.cast("double") * scale))
    rows = materialize(vectors.filter(sound).select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("vec_id"), ints.alias("v")), "vectors")
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims"), F.max(F.aggregate("v", F.lit(0.0), lambda a, v: a + v.cast("double") * v)).alias("norm"), F.sum(is_query.cast("int")).alias("queries")).first()
    dims = max(facts["dims"] or 1, 1)
    # an inner product and its partial sums stay within 4 times the largest square, so these types hold them exactly
    widest = 4.0 * (facts["norm"] or 0.0) * 8
    kind = np.float32 if widest < 2**24 else np.float64 if widest < 2**53 else np.int64
    shards = max(-(-facts["n"] * dims * 8 // SHARD_BYTES), min(-(-facts["n"] // LEAST_SHARD), spark.sparkContext.defaultParallelism), 1)
    dealt = rows.repartition(shards)
    result = "query_uid long, query_id long, vec_id long, score long"
    schema = pa.schema([(n, pa.int64()) for n in ("query_uid", "query_id", "vec_id", "score")])
    n_blocks = max(1, -(-(facts["queries"] or 0) * dims * 8 // QUERY_BYTES))
    found = None
    for block in range(n_blocks):
        mine = rows.filter(is_query & (F.pmod(F.xxhash64("uid"), F.lit(n_blocks)) == block)).toArrow()
        queries = spark.sparkContext.broadcast((np.array(mine.column("uid"), np.int64), np.array(mine.column("vec_id"), np.int64), _matrix(mine.column("v"), dims).astype(kind)))

        def search(batches: Iterable[pa.RecordBatch], queries=queries) -> Iterator[pa.RecordBatch]:
            parts = [(np.array(b.column(0), np.int64), np.array(b.column(1), np.int64), _matrix(b.column(2), dims).astype(kind)) for b in batches if b.num_rows]
            uids, ids, qs = queries.value
            if not parts or not len(qs):
                return
            shard = Shard(*(np.concatenate(p) for p in zip(*parts, strict=True)))
            for a in range(0, len(qs), 1024):
                most = shard.bounds(qs[a : a + 1024])
                got = [shard.search(q, u, m, k) for q, u, m in zip(qs[a : a + 1024], uids[a : a + 1024], most, strict=True)]
                n = [len(r) for r, _ in got]
                at = np.concatenate([r for r, _ in got]).astype(np.int64)
                score = np.concatenate([s for _, s in got])
                yield pa.record_batch([np.repeat(uids[a : a + 1024], n), np.repeat(ids[a : a + 1024], n), shard.ids[at], score.astype(np.int64)], schema=schema)

        part = dealt.mapInArrow(search, result)
        if n_blocks > 1:
            part = materialize(part, "top")
            queries.unpersist()
        found = part if found is None else found.unionByName(part)
    best = Window.partitionBy("query_uid").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The registered query as DuckDB SQL over a view `embeddings`.
SQL = """
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM e q, e c WHERE q.vec_id % 20 = 0 AND q.r <> c.r
)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
