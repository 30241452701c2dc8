"""Phrase collocations by level-wise counting with minimal perfect hashes.

Level 1 are the words of a language, level k the phrases of k words.  At each level
1. a sieve finds the candidates: mappers sum the phrases whose two sub-phrases of k - 1 words are both candidates, words by hashed slots of
   SLOT_BITS bits, phrases by the pair of their parts, each sum up to `min_count`; what does not reach it cannot be frequent;
2. a minimal perfect hash numbers the candidates, and the key stored in a slot tells a candidate from any other phrase;
3. mappers replace each phrase by its slot, bincount the slots into numpy arrays, and a tree of sums adds the arrays.

A phrase of k words is the pair of slots of its first and last k - 1 words, so from level 2 on keys are exact pairs and each
level reads the arrays of slots of the level before, which shrink; words are told apart by 128 bits.  The counts of every first and last
part of a phrase are reached through these pairs, so cuts are read by slot, by joins on slots.

Nothing that grows with the corpus is held whole: beyond BLOCK candidates a level is resolved in several passes, one block
of candidates broadcast at a time; arrays of counts are cut into chunks of CHUNK slots, of which a mapper holds HELD at most and
hands the others on; a node of the tree adds the arrays of
FAN mappers.  Languages are few: their totals come to a broadcast table up
to LANGUAGES rows, beyond that to a join.

Defined cases: a null text has no words; a null language is `und`, as is the language of that name; an empty table gives an empty result; repeated rows count each time;
ties are broken as documented in mine(); further columns are not read.
"""

from __future__ import annotations

import gc
import hashlib
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import ragged
from .marks import LARGEST, Marks
from .storage import materialize, release, share

U = np.uint64
SLOT_BITS = 44
BLOCK = 1 << 22
CHUNK, HELD, FAN = 1 << 15, 256, 64
#: Different keys that a mapper gathers before it hands them on.
GATHERED = 1 << 20
LANGUAGES = 10_000
#: Mappers that name a word, about.
NAMERS = 8
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORD = ragged.byte_class("..,,;;::!!??\x0a\x0d  \t\t")
_PIECE = ~ragged.byte_class("..,,;;::!!??\x0a\x0d")
#: A second numbering of bytes, for the other half of a word's 128 bits.
_OTHER = np.random.default_rng(11).permutation(256).astype(np.uint8)


class PerfectHash:
    """Numbers 0 to n - 1 for n different 64-bit keys; a slot's stored check tells a key of the set from any other.

    Keys that fall alone on a bit of a table of two bits a key are settled there, the others go on to the next, smaller table; a
    key's number is the rank of its bit.
    """

    def __init__(self, keys: np.ndarray, checks: np.ndarray):
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []
        left, base = keys, 0
        while len(left):
            size = -(-2 * len(left) // 64) * 64
            at = self._place(left, len(self.tables), size)
            alone = np.bincount(at, minlength=size) == 1
            words = np.packbits(alone, bitorder="little").view(U)
            self.tables.append((words, base + np.concatenate([[0], np.bitwise_count(words).astype(np.int64).cumsum()[:-1]])))
            base += int(alone.sum())
            left = left[~alone[at]]
        self.checks = np.zeros(len(keys), U)
        self.checks[self._rank(keys)] = checks

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (ragged.mix(keys + U((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % U(size)).astype(np.int64)

    def _rank(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (words, ranks) in enumerate(self.tables):
            at = self._place(keys[open_], level, 64 * len(words))
            word, bit = words[at >> 6], (at & 63).astype(U)
            hit = (word >> bit) & U(1) != 0
            out[open_[hit]] = ranks[at[hit] >> 6] + np.bitwise_count(word[hit] & ((U(1) << bit[hit]) - U(1)))
            open_ = open_[~hit]
        return out

    def slots(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """The number of every key, -1 for keys that are not of the set."""
        out = self._rank(keys)
        held = out >= 0
        held[held] = self.checks[out[held]] == checks[held]
        return np.where(held, out, -1)


def _salt(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "big")


def _words(column: pa.Array, langs: pa.Array, seed: int = 0) -> Iterator[tuple]:
    """(row of each word, key, check, whether a piece ends before it, bytes, starts, ends, first row, end row) for slices of texts."""
    salts: dict[str, int] = {}
    for a, z, data, offs in ragged.parts(column):
        data = ragged.LOWER[data]
        starts, ends, first = ragged.spans(data, offs, _WORD)
        row = np.repeat(np.arange(z - a), np.diff(first))
        marks = np.zeros(len(data) + 1, np.int64)
        np.cumsum(_PIECE[data], out=marks[1:])
        cut = np.ones(len(starts), bool)
        cut[1:] = (marks[starts[1:]] != marks[ends[:-1]]) | (row[1:] != row[:-1])
        of = [langs[i].as_py() for i in range(a, z)]
        salt = np.array([salts.setdefault(x, _salt(x)) for x in of], U)[row]
        check = ragged.mix(ragged.span_hashes(_OTHER[data], starts, ends) + (salt ^ U(0xA24BAED4963EE407)))
        yield row, _key(ragged.mix(ragged.span_hashes(data, starts, ends) + salt), check, seed), check, cut, data, starts, ends, of


def _key(h: np.ndarray, check: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit key of a word's 128 bits; another seed gives other keys."""
    return h if not seed else ragged.mix(h + check * U(2 * seed + 1))


def _pairs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, key) of the phrases whose first and last parts both have a slot."""
    at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
    return at, ids[at].astype(U) << U(32) | ids[at + 1].astype(U)


def _squeezed(ids: np.ndarray) -> np.ndarray:
    """Runs of places without a slot become one."""
    none = ids < 0
    return ids[~(none & np.concatenate([[True], none[:-1]]))]


def _arrays(batches: Iterable[pa.RecordBatch], column: int = 0) -> Iterator[np.ndarray]:
    for b in batches:
        for v in b.column(column):
            yield np.frombuffer(v.as_py(), np.int32)


class _Gather:
    """Sums by key, handed on when there are many."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        found, n = np.unique(keys, return_counts=True)
        self.parts.append((found, n))
        self.size += len(found)
        if self.size > GATHERED:
            keys, n = self._merged()
            self.parts, self.size = [(keys, n)], len(keys)
            if self.size > GATHERED // 2:
                self.parts, self.size = [], 0
                yield keys, n

    def _merged(self) -> tuple[np.ndarray, np.ndarray]:
        keys, n = (np.concatenate([p[i] for p in self.parts]) for i in (0, 1))
        found, place = np.unique(keys, return_inverse=True)
        return found, np.bincount(place, weights=n, minlength=len(found)).astype(np.int64)

    def rest(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.parts:
            yield self._merged()


def _sieve(source: DataFrame, keys_of: Callable[[Iterable[pa.RecordBatch]], Iterator[np.ndarray]], min_count: int) -> tuple[DataFrame, Broadcast | None]:
    """The slots that reach min_count and a bitmap of them, None if there are none."""
    schema = pa.schema([("slot", pa.int64()), ("n", pa.int64())])

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Gather()
        for keys in keys_of(batches):
            for out in held.add((keys >> U(64 - SLOT_BITS)).astype(np.int64)):
                yield ragged.batch(schema, *out)
        for out in held.rest():
            yield ragged.batch(schema, *out)

    left = source.mapInArrow(summed, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)
    left = materialize(left.select("slot"), "slots")
    n = left.count()
    return left, share(source.sparkSession, Marks.of(left.select(F.shiftleft("slot", 64 - SLOT_BITS).alias("h")), "h", min(max((256 * n).bit_length(), 20), LARGEST))) if n else None


def _hashes(keys: DataFrame, block: int) -> Iterator[tuple[int, int, Broadcast]]:
    """(number of the block's first slot, seed, perfect hash) for blocks of the candidates' columns key and check."""
    blocks = -(-keys.count() // block)
    base = 0
    for b in range(blocks):
        part = keys.filter(F.pmod(F.xxhash64("key", "check"), F.lit(blocks)) == b).select("key", "check").toArrow().sort_by([("key", "ascending"), ("check", "ascending")])
        h, check = (np.array(part.column(i), np.int64).view(U) for i in (0, 1))
        seed = next(s for s in range(64) if len(np.unique(_key(h, check, s))) == len(h))
        yield base, seed, share(keys.sparkSession, PerfectHash(_key(h, check, seed), check))
        base += len(h)


def _counts(ids: DataFrame) -> DataFrame:
    """(slot, a): how often every slot stands in the arrays of slots: chunks of bincounts, added up a tree."""
    schema = pa.schema([("chunk", pa.int64()), ("counts", pa.binary())])

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for x in _arrays(batches):
            x = np.sort(x[x >= 0])
            chunk = x // CHUNK
            cuts = np.append(np.flatnonzero(np.diff(chunk, prepend=-1)), len(x))
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                c = int(chunk[s])
                if c not in held:
                    if len(held) == HELD:
                        yield ragged.batch(schema, list(held), [zlib.compress(v.tobytes(), 1) for v in held.values()])
                        held.clear()
                    held[c] = np.zeros(CHUNK, np.int64)
                held[c] += np.bincount(x[s:e] - c * CHUNK, minlength=CHUNK)
        if held:
            yield ragged.batch(schema, list(held), [zlib.compress(v.tobytes(), 1) for v in held.values()])

    def added(table: pa.Table) -> pa.Table:
        total = np.zeros(CHUNK, np.int64)
        for v in table.column("counts"):
            total += np.frombuffer(zlib.decompress(v.as_py()), np.int64)
        return pa.table({"chunk": table.column("chunk")[:1], "branch": table.column("branch")[:1], "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    def slots(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c, v in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                n = np.frombuffer(zlib.decompress(v), np.int64)
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(at + c * CHUNK), pa.array(n[at])], names=["slot", "a"])

    leaves = materialize(ids.mapInArrow(counted, "chunk long, counts binary").select("chunk", F.spark_partition_id().cast("long").alias("branch"), "counts"), "counts")
    widest = leaves.agg(F.max("branch")).first()[0] or 0
    tree = leaves
    while True:
        widest //= FAN
        tree = tree.withColumn("branch", F.floor(F.col("branch") / FAN)).groupBy("chunk", "branch").applyInArrow(added, "chunk long, branch long, counts binary")
        if not widest:
            break
    out = materialize(tree.mapInArrow(slots, "slot long, a long"), "counted")
    release(leaves)
    return out


def _first_level(docs: DataFrame, min_count: int, block: int) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """(words: slot, lang, word, a; totals: lang, n; arrays of slots of the texts), None if no word is frequent."""
    slots, marks = _sieve(docs, lambda batches: (x[1] for b in batches for x in _words(b.column(0), b.column(1))), min_count)
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("key", pa.int64()), ("check", pa.int64()), ("n", pa.int64())])

    def candidates(wanted: Broadcast | None, share_of: float, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words of the slots wanted, and how many words each language has; of the words a mapper names a share, by hash."""
        totals: dict[str, int] = {}
        mine = ragged.mix(np.array([TaskContext.get().partitionId()], U))[0]
        seen = np.zeros(0, U)
        for b in batches:
            for row, key, check, _, data, starts, ends, langs in _words(b.column(0), b.column(1)):
                for lang, n in zip(langs, np.bincount(row, minlength=len(langs)).tolist(), strict=True):
                    totals[lang] = totals.get(lang, 0) + n
                at = np.flatnonzero(wanted.value.marked(key)) if wanted else np.zeros(0, np.int64)
                if share_of < 1:
                    at = at[ragged.mix(key[at] ^ mine) < U(int(share_of * 2**64))]
                at = at[np.unique(key[at] ^ check[at] * U(3), return_index=True)[1]]
                at = at[~np.isin(key[at] ^ check[at] * U(3), seen)]
                seen = np.concatenate([seen, key[at] ^ check[at] * U(3)]) if len(seen) < GATHERED else np.zeros(0, U)
                raw = data.tobytes()
                yield ragged.batch(schema, [langs[r] for r in row[at]], [raw[s:e].decode() for s, e in zip(starts[at], ends[at], strict=True)], ragged.signed(key[at]), ragged.signed(check[at]), np.zeros(len(at), np.int64))
        yield ragged.batch(schema, list(totals), pa.nulls(len(totals), pa.string()), np.zeros(len(totals), np.int64), np.zeros(len(totals), np.int64), list(totals.values()))

    # some NAMERS mappers name each word; words of which none of them had an occurrence are few, and named by all that have
    out, by = "lang string, word string, key long, check long, n long", ("lang", "word", "key", "check")
    share_of = min(1.0, NAMERS / max(docs.rdd.getNumPartitions(), 1))
    found = materialize(docs.mapInArrow(partial(candidates, marks, share_of), out).groupBy(*by).agg(F.sum("n").alias("n")), "words")
    keys, totals = found.filter("word is not null").select("lang", "word", "key", "check"), found.filter("word is null").select("lang", "n")
    if marks is not None and share_of < 1:
        left = keys.select(F.shiftrightunsigned("key", 64 - SLOT_BITS).alias("slot")).distinct()
        missed = materialize(slots.join(left, "slot", "left_anti"), "missed")
        if missed.limit(1).count():
            rest = share(docs.sparkSession, Marks.of(missed.select(F.shiftleft("slot", 64 - SLOT_BITS).alias("h")), "h", LARGEST))
            more = docs.mapInArrow(partial(candidates, rest, 1.0), out).filter("word is not null")
            keys = materialize(keys.unionByName(more.select(*by)).distinct(), "words")
    if marks is None:
        return None

    def resolve(base: int, seed: int, table: Broadcast, first: bool, last: bool, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts, a slice of them a row, become arrays of slots, cut where pieces end; each block fills in its own."""
        for b in batches:
            for texts, langs, before in _slices(b) if first else _packed(b):
                ids = []
                for _, key, check, cut, *_ in _words(texts, langs, seed):
                    slots = table.value.slots(key, check)
                    ids.append(np.insert(np.where(slots >= 0, slots + base, -1).astype(np.int32), np.flatnonzero(cut), -1))
                now = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                now = now if first else np.maximum(now, before)
                out = pa.array([(_squeezed(now) if last else now).tobytes()], pa.binary())
                kept = [] if last else [pa.array([v.to_pylist()], pa.list_(pa.string())) for v in (texts, langs)]
                yield pa.RecordBatch.from_arrays([*kept, out], names=["ids"] if last else ["texts", "langs", "ids"])

    blocks = -(-keys.count() // block)
    rows, named = docs, None
    for i, (base, seed, table) in enumerate(_hashes(keys, block)):
        last = i + 1 == blocks
        rows = rows.mapInArrow(partial(resolve, base, seed, table, i == 0, last), "ids binary" if last else "texts array<string>, langs array<string>, ids binary")
        rows = materialize(rows, "ids" if last else "texts")
        part = keys.mapInArrow(_numbered(base, seed, table, 2), "lang string, word string, slot long")
        named = part if named is None else named.unionByName(part)
    ids = rows
    return materialize(named.join(_counts(ids), "slot"), "words"), totals, ids


def _slices(b: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.Array, None]]:
    """(texts, languages, None) of a batch, about a megabyte at a time."""
    for a, z, *_ in ragged.parts(b.column(0)):
        yield b.column(0)[a:z], b.column(1)[a:z], None


def _packed(b: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """(texts, languages, slots so far) of rows that hold a slice each."""
    for i in range(b.num_rows):
        yield *(pa.array(b.column(j)[i].as_py(), pa.string()) for j in (0, 1)), np.frombuffer(b.column(2)[i].as_py(), np.int32)


def _numbered(base: int, seed: int, table: Broadcast, carry: int) -> Callable:
    """Candidates of one block with their slots: `carry` columns, then key and check."""

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, check = (np.array(b.column(carry + i), np.int64).view(U) for i in (0, 1))
            slots = table.value.slots(_key(h, check, seed), check)
            mine = np.flatnonzero(slots >= 0)
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(mine)) for c in b.columns[:carry]), pa.array(slots[mine] + base)], names=[*b.schema.names[:carry], "slot"])

    return number


def _next_level(ids: DataFrame, min_count: int, block: int) -> tuple[DataFrame, DataFrame] | None:
    """(phrases one word longer: slot, hi, lo, a; their arrays of slots), None if none is frequent."""
    schema = pa.schema([("hi", pa.int32()), ("lo", pa.int32()), ("n", pa.int32())])

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Gather()
        split = lambda pair, n: ragged.batch(schema, (pair >> U(32)).astype(np.int32), (pair & U(0xFFFFFFFF)).astype(np.int32), np.minimum(n, min_count).astype(np.int32))
        for x in _arrays(batches):
            for out in held.add(_pairs(x)[1]):
                yield split(*out)
        for out in held.rest():
            yield split(*out)

    pairs = ids.mapInArrow(summed, "hi int, lo int, n int").groupBy("hi", "lo").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)
    keys = materialize(pairs.select(F.col("hi").cast("long"), F.col("lo").cast("long"), (F.shiftleft(F.col("hi").cast("long"), 32) + F.col("lo")).alias("key"), (F.shiftleft(F.col("hi").cast("long"), 32) + F.col("lo")).alias("check")), "phrases")
    if not keys.limit(1).count():
        return None

    def resolve(base: int, table: Broadcast, first: bool, last: bool, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                x = np.frombuffer(b.column(0)[i].as_py(), np.int32)
                at, key = _pairs(x)
                slots = table.value.slots(key, key)
                out = np.full(len(x), -1, np.int32) if first else np.frombuffer(b.column(1)[i].as_py(), np.int32).copy()
                out[at[slots >= 0]] = slots[slots >= 0] + base
                if not last:
                    yield pa.RecordBatch.from_arrays([b.column(0)[i : i + 1], pa.array([out.tobytes()], pa.binary())], names=["ids", "now"])
                elif out.max(initial=-1) >= 0:
                    yield pa.RecordBatch.from_arrays([pa.array([_squeezed(out).tobytes()], pa.binary())], names=["ids"])

    blocks = -(-keys.count() // block)
    rows, named = ids, None
    for i, (base, seed, table) in enumerate(_hashes(keys, block)):
        if seed:
            raise AssertionError("pairs are their own keys")
        last = i + 1 == blocks
        rows = materialize(rows.mapInArrow(partial(resolve, base, table, i == 0, last), "ids binary" if last else "ids binary, now binary"), "ids" if last else "pairs")
        part = keys.mapInArrow(_numbered(base, 0, table, 2), "hi long, lo long, slot long")
        named = part if named is None else named.unionByName(part)
    after = rows
    return named.join(_counts(after), "slot"), after


def _forget(spark: SparkSession) -> None:
    """Shuffle files of a level that is written out go with the plans that made them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 * a * n / (left * right)) in decimals of 38 digits."""
    whole = lambda x: x.cast("decimal(19,0)")
    return F.floor(F.call_function("div", whole(1000 * a) * whole(n), whole(left) * whole(right))).cast("long")


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = 100, top: int = 2000, longest: int = 5, block: int = BLOCK) -> DataFrame:
    """Each language's first `top` phrases of 2 to `longest` words: lang, rank, phrase, a, l, r, n, score.

    a, l and r count the phrase and the two parts of its lowest-scoring cut (of equal scores the one of fewest first words), n all words of the language; score is
    floor(1000 * a * n / (l * r)).  A phrase inside a longer candidate that is as frequent is left out.  Order: score and a descending, phrase ascending.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(text_col).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    empty = spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    first = _first_level(rows, min_count, block)
    if first is None:
        return empty
    words, totals, ids = first
    one = F.array("a")
    level = materialize(words.filter(F.col("a") >= min_count).select("slot", "lang", F.array("word").alias("words"), one.alias("pre"), one.alias("suf"), "a"), "level")
    levels = []
    _forget(spark)
    while len(levels) + 2 <= longest:
        found = _next_level(ids, min_count, block)
        release(ids)
        if found is None:
            break
        phrases, ids = found
        head = level.select(F.col("slot").alias("hi"), "lang", "words", "pre")
        tail = level.select(F.col("slot").alias("lo"), F.element_at("words", -1).alias("last"), "suf")
        joined = phrases.filter(F.col("a") >= min_count).join(head, "hi").join(tail, "lo")
        level = materialize(joined.select("slot", "hi", "lo", "lang", F.concat("words", F.array("last")).alias("words"), F.concat("pre", one).alias("pre"), F.concat("suf", one).alias("suf"), "a"), "level")
        levels.append(level)
        _forget(spark)
    kept = None
    for i, now in enumerate(levels):
        if i + 1 < len(levels):
            longer = levels[i + 1]
            held = longer.select(F.col("hi").alias("slot"), "a").unionByName(longer.select(F.col("lo").alias("slot"), "a")).distinct()
            now = now.join(held, ["slot", "a"], "left_anti")
        now = now.select("lang", F.array_join("words", " ").alias("phrase"), "a", "pre", "suf")
        kept = now if kept is None else kept.unionByName(now)
    if kept is None:
        return empty
    scored = kept.join(F.broadcast(totals) if totals.limit(LANGUAGES + 1).count() <= LANGUAGES else totals, "lang")
    size = F.size("pre")
    cut = lambda k: F.struct(_score(F.col("a"), F.col("n"), F.get("pre", k - 1), F.get("suf", size - k - 1)).alias("score"), k.alias("k"), F.get("pre", k - 1).alias("l"), F.get("suf", size - k - 1).alias("r"))
    best = scored.withColumn("x", F.array_min(F.transform(F.sequence(F.lit(1), size - 1), cut))).select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return best.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def brute(rows: Iterable[tuple[str | None, str | None]], min_count: int, top: int, longest: int = 5) -> list[tuple]:
    """The same from (text, lang) pairs by plain loops."""
    import re
    from collections import Counter, defaultdict

    low = str.maketrans(LETTERS, LETTERS.lower())
    f: dict[str, Counter] = defaultdict(Counter)
    total: Counter = Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(low)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        inside = {q for p, a in found.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and a >= counts[q := p[i:j]]}
        scored = []
        for p, a in found.items():
            if p not in inside:
                s, _, left, right = min((1000 * a * total[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                scored.append((-s, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top])]
    return out


_GRAM = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
  FROM documents),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
total AS (SELECT lang, count(*) AS n FROM places GROUP BY lang),
grams AS (SELECT lang, w, i, unnest(range(1, least(5, len(w) - i + 1) + 1)) AS k FROM places),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, any_value(w[i:i + k - 1]) AS words, count(*) AS a FROM grams GROUP BY lang, k, phrase),
candidates AS (SELECT * FROM f WHERE k >= 2 AND a >= 100),
"""
SQL = (
    _GRAM
    + r"""
parts AS (SELECT lang, words, a, k, unnest(range(1, k + 1)) AS s FROM candidates),
inside AS (SELECT lang, a, k, words, s, unnest(range(s + 1, k + 1)) AS e FROM parts),
held AS (SELECT lang, array_to_string(words[s:e], ' ') AS phrase, max(a) AS longer FROM inside WHERE e - s + 1 < k GROUP BY ALL),
kept AS (SELECT c.* FROM candidates c LEFT JOIN held h ON h.lang = c.lang AND h.phrase = c.phrase WHERE h.longer IS NULL OR 100 * h.longer < 100 * c.a),
cuts AS (SELECT lang, phrase, words, a, k, unnest(range(1, k)) AS c FROM kept),
scored AS (
  SELECT x.lang, x.phrase, x.a, x.c, p.a AS l, q.a AS r, t.n, (1000::HUGEINT * x.a * t.n) // (p.a::HUGEINT * q.a) AS score
  FROM cuts x JOIN f p ON p.lang = x.lang AND p.k = x.c AND p.phrase = array_to_string(x.words[1:x.c], ' ')
  JOIN f q ON q.lang = x.lang AND q.k = x.k - x.c AND q.phrase = array_to_string(x.words[x.c + 1:x.k], ' ') JOIN total t ON t.lang = x.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""
)
