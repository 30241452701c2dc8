"""Periodic runs of words: all-lag scan.

A run is a stretch of consecutive words with smallest period q (words q apart are equal), at least max(least, min_exp * q) words
long, that no neighbouring word extends.  The words of a text become an array of ids; for every lag q up to n / min_exp the array is
compared with itself shifted by q, and the stretches of equality are run-length coded: one of m words is a stretch of period q and of m + q words.
A stretch that has a smaller period too has, by Fine and Wilf, the same ends at that period, so of equal ends the smallest lag stays.

Most lags need no full comparison.  What a lag must show, max(q, least - q) equal words in a row, holds equal 4-word hashes at every
position of a grid that fine, so the lag is first probed on its grid, all lags of a range in one gather; it is compared in full where a probe
meets.  This skips nothing that could be a run, and takes n log n probes for a text without runs.

Spark deals the work out: a document of up to LAGS lags is one unit; of longer ones every range of LAGS lags is a unit of its
own, with the document's words, and their runs meet again by document.

Defined cases: a null or empty text has no words and no runs; repeated rows each get their row; an empty table gives an empty result;
further columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lags in a unit of work.
LAGS = 4096
LEAST, MIN_EXP = 12, 2
#: Grid positions probed at once.
PROBES = 1 << 20
#: Words of a probe; a lag shows at least 6 equal words in a row.
SHINGLE = 4
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUNS_SQL = "array<struct<start: long, length: long, period: long>>"


def word_ids(words: list[bytes]) -> np.ndarray:
    """Equal words, and only they, get equal numbers."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words))


def _probed(ids: np.ndarray, lo: int, hi: int, least: int, need: int) -> np.ndarray:
    """Lags of [lo, hi) where a grid position has equal hashes of SHINGLE words at both ends."""
    h = np.zeros(len(ids) - SHINGLE + 1, np.uint64)
    for j in range(SHINGLE):
        h = h * np.uint64(0x9E3779B97F4A7C15) + (ids[j : j + len(h)].astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    lags = np.arange(lo, hi)
    step = np.maximum(np.maximum(lags * (need - 1), least - lags) - SHINGLE + 1, 1)
    count = np.maximum((len(h) - lags + step - 1) // step, 0)
    total, found, at = np.concatenate([[0], count.cumsum()]), [], 0
    while at < len(lags):
        to = max(at + 1, int(np.searchsorted(total, total[at] + PROBES, "right")) - 1)
        lag = np.repeat(lags[at:to], count[at:to])
        place = (np.arange(len(lag)) - np.repeat(total[at:to] - total[at], count[at:to])) * np.repeat(step[at:to], count[at:to])
        found.append(np.unique(lag[h[place] == h[place + lag]]))
        at = to
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def runs_of(ids: np.ndarray, lo: int = 1, hi: int | None = None, least: int = LEAST, need: int = MIN_EXP) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of smallest period among the lags [lo, hi), by start, then period."""
    hi = min(len(ids) // need + 1, len(ids) if hi is None else hi)
    if hi <= lo or len(ids) < least:
        return []
    best: dict[tuple[int, int], int] = {}
    # a stretch that must be shorter than a probe cannot be probed: every lag is compared
    lags = _probed(ids, lo, hi, least, need) if least // 2 - SHINGLE >= 0 and (need - 1) * least >= SHINGLE * need else np.arange(lo, hi)
    for q in lags.tolist():
        same = np.concatenate([[False], ids[:-q] == ids[q:], [False]])
        ends = np.flatnonzero(same[1:] != same[:-1])
        starts, ends = ends[::2], ends[1::2]
        for s, e in zip(*(x[ends - starts >= max(q * (need - 1), least - q)].tolist() for x in (starts, ends)), strict=True):
            best.setdefault((s, e + q), q)
    return sorted((s, e - s, q) for (s, e), q in best.items())


def collapsed(n: int, runs: Iterable[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those that no run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for s, length, q in runs:
        edge[s + q] += 1
        edge[s + length] -= 1
    return edge[:-1].cumsum() == 0


def _words(value: bytes | None) -> list[bytes]:
    return (value or b"").split()  # at \x20 and \x09-\x0D, which is what bytes.split takes for white space


def find_runs(docs: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), least: int = LEAST, need: int = MIN_EXP, lags: int = LAGS) -> DataFrame:
    """The `carry` columns with n_words, runs (array of start, length, period: word numbers from 0, by start, then period) and
    collapsed, the text with each run cut to its first period and words joined by one space."""
    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)], F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    kept = ", ".join(f"c{i} {rows.schema[i].dataType.simpleString()}" for i in range(len(carry)))
    k = len(carry)

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs are found here, or stand in the column after the text."""
        for b in batches:
            counts, found, left = [], [], []
            for i, text in enumerate(b.column(k)):
                words = _words(text.as_py())
                ids = word_ids(words)
                runs = runs_of(ids, least=least, need=need) if b.num_columns == k + 1 else _least(b.column(k + 1)[i].as_py() or [])
                stay = collapsed(len(words), runs)
                counts.append(len(words))
                found.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs])
                left.append(b" ".join(w for w, keep in zip(words, stay.tolist(), strict=True) if keep).decode() if runs else b" ".join(words).decode())
            columns = [*b.columns[:k], pa.array(counts, pa.int64()), pa.array(found, pa.list_(RUN)), pa.array(left, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names[:k], "n_words", "runs", "collapsed"])

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of one range of lags."""
        for b in batches:
            found = []
            for key, text, lo in zip(*(b.column(j).to_pylist() for j in range(3)), strict=True):
                runs = runs_of(word_ids(_words(text)), lo, lo + lags, least, need)
                found.append((key, [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs]))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.list_(RUN))], names=["key", "part"])

    out = f"{kept}, n_words long, runs {RUNS_SQL}, collapsed string"
    # so many words take at least so many bytes
    few = F.octet_length("text") < 2 * need * lags
    n = F.regexp_count(F.col("text").cast("string"), F.lit(r"[^\x20\x09-\x0D]+"))
    long = rows.filter(~few).withColumn("key", F.sha2("text", 256)).withColumn("n", n)
    units = long.select("key", "text", "n").dropDuplicates(["key"]).select("key", "text", F.explode(F.sequence(F.lit(1), F.greatest(F.col("n") / need, F.lit(1)).cast("int"), F.lit(lags))).alias("lo"))
    parts = units.repartition("key", "lo").mapInArrow(scan, f"key string, part {RUNS_SQL}").groupBy("key").agg(F.flatten(F.collect_list("part")).alias("parts"))
    whole = long.join(parts, "key", "left").select(*[f"c{i}" for i in range(k)], "text", "parts").mapInArrow(finish, out)
    both = rows.filter(few).mapInArrow(finish, out).unionByName(whole)
    return both.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], "n_words", "runs", "collapsed")


def _least(parts: list[dict]) -> list[tuple[int, int, int]]:
    """Of runs with equal ends, found in different ranges, that of the smallest period."""
    best: dict[tuple[int, int], int] = {}
    for r in parts:
        ends = (r["start"], r["length"])
        best[ends] = min(r["period"], best.get(ends, r["period"]))
    return sorted((s, n, q) for (s, n), q in best.items())


def repeated_tail(text: Column, doc_id: Column) -> Column:
    """The words of a text, joined by one space; in a tenth of the documents, by crc32 of the id, those from some word on repeat the first ones there.  A null id changes nothing."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    bound = lambda value, use: F.get(F.transform(F.array(value), use), 0)  # noqa: E731  a value computed once for all words

    def repeated(words: Column) -> Column:
        n, g = F.size(words), F.floor(h / 10)
        a = (g % F.greatest(n, F.lit(1))).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return bound(F.struct(a.alias("a"), p.alias("p")), lambda x: F.transform(words, lambda w, i: F.when(i < x["a"], w).otherwise(F.get(words, x["a"] + (i - x["a"]) % x["p"]))))

    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    return F.when(h % 10 == 0, F.array_join(bound(words, repeated), " ")).otherwise(text)


def brute(words: list, least: int = LEAST, need: int = MIN_EXP) -> list[tuple[int, int, int]]:
    """All runs by the definition: every start and period extended word by word, and tested for a smaller period."""
    found, n = [], len(words)
    for s in range(n):
        for q in range(1, n - s):
            e = s + q
            while e < n and words[e] == words[e - q]:
                e += 1
            if e - s >= max(least, need * q) and (s == 0 or words[s - 1] != words[s - 1 + q]):
                if not any(all(words[i] == words[i + p] for i in range(s, e - p)) for p in range(1, q)):
                    found.append((s, e - s, q))
    return found
