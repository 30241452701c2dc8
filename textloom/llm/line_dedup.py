"""Line dedup by a deletion-neighbourhood join.

A line is its sequence of words (A-Z folded to a-z).  A line goes if an earlier line, by
document id and line number, has the same words, or lies within one word inserted, deleted or replaced, and within a similarity of
`percent`: words of the longer line, less the one, to all of them.  That is one rule for lines of every length; at 80 %
it leaves nothing to lines of which the longer has four words, and a word to all others.  The variants of a line are the
line itself and the line less one word; two lines within the bound share one, at the same place or one of them
as the whole line.  Equal variants are joined by two hashes of 64 bits; each late line is then compared, word by word, with the
earliest line that the join found for it, and goes only if their edit distance is within the bound.

So that few lines emit a variant a word, all first emit coarser ones.  Words fall into four classes by
their own hash; a coarse variant is the line less all words of two classes.  One word inserted, deleted or replaced
touches two classes at most, so lines within the bound share a coarse variant whatever their length, and only in lines that share
one with a different line are words, those of the two classes, left out one by one.  Coarse variants under REST words would
tell few lines apart; such lines emit the variants of single words at once.

A variant that very many lines share is a hot key: each slice of the input sends on only its first line for it, having paired the others with that
one, and the rest is streamed in order, so no task holds a group.

Defined cases: lines without a word are never removed; a null text has no lines and stays null;
an emptied document stays, with an empty text; equal ids are told apart by the hash of the text, and
of fully repeated rows each keeps the lines that one of them would keep; null ids come first; an
empty table gives an empty result; further columns pass through apply() untouched.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ragged
from .marks import Marks, bits_for
from .storage import materialize, share

PERCENT, REST = 80, 3
U = np.uint64
#: Pairs of the four word classes that a coarse variant keeps.
KEPT = [(i, j) for i in range(4) for j in range(i)]


def least_words(percent: int) -> int:
    """Words of the shortest line that may differ from another, as long or shorter, by one."""
    return -(-100 // (100 - percent)) if percent < 100 else 1 << 62


class Lines:
    """Lines of a slice that have words: hashes and variants by array arithmetic."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, rank: np.ndarray, least: int):
        """rank: place of each row in the order of documents; least: words from which a line may lack one."""
        self.rank, self.least = rank, least
        data = ragged.LOWER[data]
        newline = np.flatnonzero(data == 10)
        starts, ends, first = ragged.spans(data, offs, ragged.SPACED)
        self.words = ragged.span_hashes(data, starts, ends)
        row = np.repeat(np.arange(len(offs) - 1), np.diff(first))
        number = np.searchsorted(newline, starts) - np.searchsorted(newline, offs)[row]  # lines before this one in its row
        new = np.ones(len(starts), bool)
        new[1:] = (row[1:] != row[:-1]) | (number[1:] != number[:-1])
        self.first = np.flatnonzero(new)
        self.row, self.number = row[self.first], number[self.first]
        self.n = np.diff(np.append(self.first, len(starts)))
        self._up, self._down = ragged._power_tables(len(starts) + 2)
        with np.errstate(over="ignore"):
            self.total = np.zeros(len(starts) + 1, U)
            np.cumsum(self.words * self._up[: len(starts)], dtype=U, out=self.total[1:])
        with np.errstate(over="ignore"):
            self.other = np.zeros(len(starts) + 1, U)
            np.cumsum(ragged.mix(self.words) * self._up[: len(starts)], dtype=U, out=self.other[1:])
        everything = np.arange(len(self.first))
        self.full, self.check = (self.without(everything, self.first, self.first, t) for t in (self.total, self.other))
        self.data, self.starts, self.ends = data, starts, ends

    def said(self, line: int) -> str:
        """Words of a line with single spaces."""
        a = self.first[line]
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.starts[a : a + self.n[line]].tolist(), self.ends[a : a + self.n[line]].tolist(), strict=True)).decode()

    def without(self, line: np.ndarray, a: np.ndarray, b: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Hash, by one of the two running totals, of each line less its words [a, b)."""
        s, e = self.first[line], self.first[line] + self.n[line]
        with np.errstate(over="ignore"):
            h = (total[a] - total[s]) * self._down[s] + (total[e] - total[b]) * self._down[s + b - a]
            return ragged.mix(h + (e - s - (b - a)).astype(U) * U(0xD1B54A32D192ED03))

    def coarse(self, shared: Marks | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(line, key) of coarse variants of the first line of each content; two masks of words to leave out one by one.

        The first mask has the words of lines of too short a coarse variant; the second, given the bitmap of shared keys, those that the lines'
        shared variants lack.
        """
        lines, keys = [], []
        short, lacking = np.zeros(len(self.words), bool), np.zeros(len(self.words), bool)
        order = np.lexsort((self.number, self.rank[self.row]))
        _, once = np.unique(self.full[order], return_index=True)
        able = np.zeros(len(self.n), bool)
        able[order[once]] = True
        able &= self.n >= self.least - 1  # a word longer, they may lack one
        long_word = np.repeat(able, self.n)
        kind = (self.words >> U(40)) & U(3)
        stop = self.first + self.n
        for tag, (i, j) in enumerate(KEPT):
            kept = (kind == U(i)) | (kind == U(j))
            place = np.zeros(len(self.words) + 1, np.int64)
            np.cumsum(kept, out=place[1:])
            held = self.words[kept]
            total = np.zeros(len(held) + 1, U)
            with np.errstate(over="ignore"):
                np.cumsum(held * self._up[: len(held)], dtype=U, out=total[1:])
                s, e = place[self.first], place[stop]
                key = ragged.mix((total[e] - total[s]) * self._down[s] + (e - s).astype(U) * U(0xD1B54A32D192ED03) + U(tag + 1))
            enough = e - s >= REST
            use = np.flatnonzero(able & enough)
            lines.append(use)
            keys.append(key[use])
            short |= np.repeat(able & ~enough, self.n)
            if shared is not None:
                hit = np.zeros(len(self.n), bool)
                hit[use[shared.marked(key[use])]] = True
                lacking |= np.repeat(hit, self.n) & ~kept
        return np.concatenate(lines), np.concatenate(keys), short & long_word, lacking

    def single(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(line, place, hash, second hash) of the lines less one of the words of a mask, where they are long enough, and of the whole lines at place -1."""
        at = np.flatnonzero(words)
        owner = np.searchsorted(self.first, at, "right") - 1
        whole = np.unique(owner)
        long = self.n[owner] >= self.least
        at, owner = at[long], owner[long]
        v, w = (np.concatenate([self.without(owner, at, at + 1, t), f[whole]]) for t, f in ((self.total, self.full), (self.other, self.check)))
        return np.concatenate([owner, whole]), np.concatenate([at - self.first[owner], np.full(len(whole), -1)]), v, w


def _rank(rows: pa.RecordBatch) -> np.ndarray:
    """Places of rows in the order of id, null first, and key."""
    ids = rows.column(0)
    order = np.lexsort((np.array(rows.column(1), np.int64), np.array(ids.fill_null(0), np.int64), np.array(ids.is_valid(), bool)))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank


def _per_row(rows: int, row: np.ndarray, *values: np.ndarray) -> list[pa.Array]:
    """Values, whose rows come in order, as one list a row."""
    offsets = pa.array(np.searchsorted(row, np.arange(rows + 1)), pa.int32())
    return [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in values]


def decide(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", bits: tuple[int, int] = (64, 64)) -> DataFrame:
    """(doc_id, key, n_lines, removed) of every row: key is the hash of its text, removed the sorted numbers (from 0) of the lines that go.

    bits: of the two hashes of variants; fewer make them collide, for tests.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    least = least_words(percent)

    longs = pa.list_(pa.int64())
    noted = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n_lines", pa.int64()), ("line", longs), ("h", longs), ("check", longs), ("n_variants", longs), ("v", longs)])

    def note(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, z, data, offs in ragged.parts(b.column(2)):
                x = Lines(data, offs, _rank(b.slice(a, z - a)), least)
                line, key, short, _ = x.coarse()
                owner, _, word_key, _ = x.single(short)
                owner, key = np.concatenate([line, owner]), np.concatenate([key, word_key])
                order = np.argsort(owner, kind="stable")
                owner, key = owner[order], key[order]
                texts = b.column(2)[a:z]
                n_lines = ragged.row_sums((data == 10).astype(np.int64), offs) + np.array(texts.is_valid(), np.int64)
                lists = _per_row(z - a, x.row, x.number, ragged.signed(x.full), ragged.signed(x.check), np.bincount(owner, minlength=len(x.n)))
                yield ragged.batch(noted, b.column(0)[a:z], b.column(1)[a:z], n_lines, *lists, *_per_row(z - a, x.row[owner], ragged.signed(key)))

    sql = "doc_id long, key long, n_lines long, line array<long>, h array<long>, check array<long>, n_variants array<long>, v array<long>"
    table = materialize(rows.mapInArrow(note, sql), "lines")
    shared = share(spark, _shared_variants(table))

    spelled = pa.schema([("v", pa.int64()), ("w", pa.int64()), ("place", pa.int32()), ("doc_id", pa.int64()), ("key", pa.int64()), ("line", pa.int64()), ("d0", pa.int64()), ("k0", pa.int64()), ("l0", pa.int64()), ("said", pa.string())])

    def spell(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Variants; those that an earlier line of the slice has at the same place name that line (d0, k0, l0), and are done."""
        for b in batches:
            for a, z, data, offs in ragged.parts(b.column(2)):
                x = Lines(data, offs, _rank(b.slice(a, z - a)), least)
                _, _, short, lacking = x.coarse(shared.value)
                one = x.single(short & ~lacking)
                keep = shared.value.marked(one[2])
                owner, place, v, w = (np.concatenate([p[keep], q]) for p, q in zip(one, x.single(lacking), strict=True))
                v, w = (h & U((1 << n) - 1) for h, n in zip((v, w), bits, strict=True))
                order = np.lexsort((x.number[owner], x.rank[x.row[owner]], place, w, v))
                owner, place, v, w = owner[order], place[order], v[order], w[order]
                first = np.arange(len(v))
                if len(v):
                    first[1:][(v[1:] == v[:-1]) & (w[1:] == w[:-1]) & (place[1:] == place[:-1])] = 0
                    first = np.maximum.accumulate(first)
                late = owner != owner[first]
                use = np.flatnonzero(late | (first == np.arange(len(v))))
                owner, place, v, w, late, first = owner[use], place[use], v[use], w[use], late[use], owner[first[use]]
                told, at_first = np.unique(owner, return_index=True)
                said = np.full(len(owner), None, object)
                said[at_first] = [x.said(i) for i in told.tolist()]
                of = lambda i: (b.column(0).take(pa.array(a + x.row[i])), b.column(1).take(pa.array(a + x.row[i])), pa.array(x.number[i], pa.int64()))
                none = pa.array(np.where(late, first, -1))
                before = [pc.if_else(pc.greater_equal(none, 0), c, pa.scalar(None, pa.int64())) for c in of(first)]
                yield ragged.batch(spelled, ragged.signed(v), ragged.signed(w), place, *of(owner), *before, said)

    sql = "v long, w long, place int, doc_id long, key long, line long, d0 long, k0 long, l0 long, said string"
    near = materialize(rows.mapInArrow(spell, sql), "variants")
    late = _verified(_late(near), near.filter("said IS NOT NULL").select("doc_id", "key", "line", "said").distinct())
    o = F.struct("doc_id", "key", "line").alias("o")

    occurrences = table.select("doc_id", "key", F.explode(F.arrays_zip("line", "h", "check")).alias("x")).select("doc_id", "key", "x.*").withColumn("o", o)
    heads = occurrences.groupBy("h", "check").agg(F.min("o").alias("first"), F.max("o").alias("last")).filter(F.col("first") != F.col("last")).drop("last")
    again = occurrences.join(materialize(heads, "heads"), ["h", "check"]).filter(F.col("o") > F.col("first")).select("o.*")
    gone = again.unionByName(late).groupBy(F.col("doc_id").alias("d"), F.col("key").alias("k")).agg(F.array_sort(F.collect_set("line")).alias("removed"))
    out = table.select("doc_id", "key", "n_lines").join(gone, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
    return out.select("doc_id", "key", "n_lines", F.coalesce("removed", F.expr("cast(array() as array<long>)")).alias("removed"))


def _shared_variants(table: DataFrame) -> Marks:
    """Bits of the coarse variants that two different lines have."""
    # few of the variants are shared
    marks = Marks(bits_for((table.select(F.sum(F.size("v"))).first()[0] or 0) // 8))

    def unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(2).flatten(), pa.array(np.repeat(np.array(b.column(0).flatten(), np.int64), np.array(b.column(1).flatten(), np.int64)))], names=["v", "h"])

    def repeated(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Places of the variants with two lines; rows come in order, so that of the last one only its extremes are held."""
        held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            v, h = (np.array(c, np.int64) for c in b.columns)
            v, low, high = (np.concatenate(x) for x in zip(held, (v, h, h), strict=True))
            if not len(v):
                continue
            begins = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
            v, low, high = v[begins], np.minimum.reduceat(low, begins), np.maximum.reduceat(high, begins)
            held = v[-1:], low[-1:], high[-1:]
            at = np.unique(v[low != high].view(U) >> U(64 - marks.bits))
            yield pa.record_batch([pa.array((at << U(64 - marks.bits)).view(np.int64))], names=["v"])

    pairs = table.select("h", "n_variants", "v").mapInArrow(unpack, "v long, h long").repartition("v").sortWithinPartitions("v")
    return Marks.of(pairs.mapInArrow(repeated, "v long"), "v", bits=marks.bits)


def _late(near: DataFrame) -> DataFrame:
    """(doc_id, key, line, d0, k0, l0) of lines and the earliest line with which each shares a variant, at the same place or one of them whole.

    Rows come in order of variant and line, so a task holds one variant's first lines, not its rows; of each slice of the input only a
    variant's first line at a place gets here, however many share it.
    """
    names = ["doc_id", "key", "line", "d0", "k0", "l0"]

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, whole, less, same, count = None, None, None, {}, 0
        for b in batches:
            if not b.num_rows:
                continue
            v, w = np.array(b.column(0), np.int64), np.array(b.column(1), np.int64)
            starts = np.concatenate([[(int(v[0]), int(w[0])) != now], (v[1:] != v[:-1]) | (w[1:] != w[:-1])])
            alone = starts[:-1] & starts[1:]  # but for the last row, whose variant may go on
            use = np.flatnonzero(~np.append(alone, False))
            part = b.take(pa.array(use))
            out = []
            for opens, vw, place, *o in zip(starts[use].tolist(), zip(v[use].tolist(), w[use].tolist(), strict=True), *(c.to_pylist() for c in part.columns[2:]), strict=True):
                if opens:
                    now, whole, less, same = vw, None, None, {}
                # rows before this one are of earlier lines, or of this one at another place
                found = [f for f in ((whole, less) if place < 0 else (whole, same.get(place))) if f is not None and f[1] != o]
                if found:
                    out.append((*o, *min(found)[1]))
                count += 1
                if place < 0:
                    whole = whole or (count, o)
                else:
                    less = less or (count, o)
                    same.setdefault(place, (count, o))
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    fresh = near.filter("l0 IS NULL").select("v", "w", "place", "doc_id", "key", "line").repartition("v").sortWithinPartitions("v", "w", F.col("doc_id").asc_nulls_first(), "key", "line", "place")
    across = fresh.mapInArrow(meet, ", ".join(f"{n} long" for n in names))
    return near.filter("l0 IS NOT NULL").select(*names).unionByName(across).distinct()


def _verified(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, key, line) of the pairs whose words differ in one at most."""
    o, first = (F.struct(*c).alias(n) for c, n in ((("doc_id", "key", "line"), "o"), (("d0", "k0", "l0"), "first")))
    said = lines.select(o, "said")
    found = pairs.select(o, first).join(said, "o").join(said.withColumnsRenamed({"o": "first", "said": "before"}), "first")
    return found.filter(_near(F.col("said"), F.col("before"))).select("o.*").distinct()


@F.pandas_udf(T.BooleanType())
def _near(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_within_one(x.split(" "), y.split(" ")) for x, y in zip(a, b, strict=True)], dtype=bool)


def apply(docs: DataFrame, decisions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs`, all columns and rows, with the lines that `decisions` removes taken out of the text."""
    cut = decisions.filter(F.size("removed") > 0).select(F.col("doc_id").alias("__d"), F.col("key").alias("__k"), F.col("removed").alias("__r")).dropDuplicates(["__d", "__k"])
    joined = docs.join(cut, F.col(id_col).cast("long").eqNullSafe(F.col("__d")) & (F.xxhash64(text_col) == F.col("__k")), "left")
    lines = F.split(F.col(text_col), "\n", -1)
    marked = F.transform(lines, lambda x, i: F.when(~F.array_contains("__r", i.cast("long")), x))
    left = F.array_join(F.filter(marked, lambda x: x.isNotNull()), "\n")
    return joined.select(*[F.when(F.col("__r").isNull(), F.col(text_col)).otherwise(left).alias(text_col) if c == text_col else F.col(c) for c in docs.columns])


def brute(rows: list[tuple[int, str | None]]) -> dict[int, list[int]]:
    """Reference decisions for a few rows of distinct ids: {doc_id: removed line numbers}."""
    seen: list[list[str]] = []
    out: dict[int, list[int]] = {}
    for doc, text in sorted(rows):
        out[doc] = []
        for i, line in enumerate((text or "").split("\n")):
            w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line).replace("\t", " ").split(" ") if x]
            if not w:
                continue
            if any(w == s or (max(len(w), len(s)) >= least_words(PERCENT) and _within_one(w, s)) for s in seen):
                out[doc].append(i)
            seen.append(w)
    return out


def _within_one(a: list[str], b: list[str]) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


#: The registered query as DuckDB SQL over a view `documents` of distinct ids.
SQL = r"""
WITH t AS (
  SELECT doc_id, text, unnest(string_split(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents
), w AS (
  SELECT doc_id, line, doc_id * 1000000 + line AS o, regexp_extract_all(l, '[^\x20\x09-\x0D]+') AS w FROM t
), n AS (
  SELECT doc_id, line, o, w, len(w) AS n, array_to_string(w, ' ') AS x FROM w WHERE len(w) > 0
), v AS (
  SELECT o, doc_id, line, 0 AS place, x AS v FROM n WHERE n >= 4
  UNION ALL SELECT o, doc_id, line, place, array_to_string(w[:place - 1] || w[place + 1:], ' ') FROM (SELECT *, unnest(range(1, n + 1)) AS place FROM n WHERE n >= 5)
), f AS (
  SELECT *, min(o) OVER (PARTITION BY v, place) AS same, min(CASE WHEN place = 0 THEN o END) OVER (PARTITION BY v) AS whole, min(CASE WHEN place > 0 THEN o END) OVER (PARTITION BY v) AS less FROM v
), gone AS (
  SELECT doc_id, line FROM f WHERE same < o OR (place = 0 AND less < o) OR (place > 0 AND whole < o)
  UNION SELECT doc_id, line FROM (SELECT *, min(o) OVER (PARTITION BY x) AS first FROM n) WHERE first < o
), g AS (
  SELECT doc_id, count(*) AS n, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS lines FROM gone GROUP BY doc_id
)
SELECT doc_id, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(text) - len(replace(text, chr(10), '')) + 1 END AS BIGINT) AS n_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(lines, '') AS removed
FROM documents LEFT JOIN g USING (doc_id)
"""
