"""Removal of long repeated byte strings by difference-cover suffix arrays.

A byte goes if some string of `length` bytes that covers it also starts anywhere else, in
the same text or another.  Sorting all suffixes of the corpus would move many times its size, so
suffixes are thinned without loss before they are sorted:

1. Every window of `length` bytes owns an anchor, the position of the least 16-byte hash
   among its first WINDOW positions; equal windows have equal anchors at equal offsets and share
   the bytes from the anchor to where the earliest of such windows would end (its core).  Windows whose core
   occurs once cannot repeat.
2. The starts left are cut into blocks of at most STARTS neighbours.  Blocks of the same bytes repeat as
   a whole; blocks whose inner core, common to all their windows, occurs once do not.
3. The bytes of the other blocks meet by inner core, and a task sorts their suffixes by the
   difference-cover algorithm: triples at positions 1 and 2 modulo 3 are sorted and named, the string of names
   is sorted by recursion, the suffixes at 0 modulo 3 are ordered by first byte and the rank behind it, both
   orders are merged, and adjacent suffixes that start a window are compared over `length` bytes.

Texts with an exact copy repeat throughout and are sorted once a task only.  Inner cores of more than LARGE
blocks are not sorted: each of their starts is a row of its own, and an aggregate over the windows' bytes, combined before the
shuffle, tells which windows start at two places or more.  The starts join those windows, salted where a window has over
HEAVY starts.  So no task holds an unbounded group, and two places decide, however many there are.

Defined cases: null and short texts lose nothing; matches never cross texts; equal rows are copies of each other; an
empty table gives an empty result; other columns are ignored.  Windows of large inner cores are told apart by their bytes; cores,
blocks, and neighbours in a suffix array by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ragged
from .marks import Marks, bits_for
from .storage import materialize, share

LENGTH, WINDOW, GRAM, STARTS = 400, 256, 16, 64
LARGE = 2048
#: Starts of one window from which on they are dealt out over SALTS tasks.
HEAVY, SALTS = 4096, 32
#: Bytes whose suffixes a task sorts at once, whole groups at least.
SORTED_BYTES = 1 << 19
REMEMBERED = 1_000_000
U = np.uint64


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Start of every suffix of an array of positive integers, in order, by the difference-cover algorithm modulo 3."""
    n = len(t)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: tuple(t[i:])), np.int64)
    x = np.concatenate([t.astype(np.int64), np.zeros(3, np.int64)])
    dummy = n % 3 == 1  # a sample at n closes the string of names of positions 1 modulo 3
    ones, twos = np.arange(1, n + dummy, 3), np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    names = _names(x[sample], x[sample + 1], x[sample + 2])
    if names.max() < len(sample):
        order = suffix_array(names)
    else:
        order = np.argsort(names, kind="stable")
    sample = sample[order]
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = np.arange(1, len(sample) + 1)
    if dummy:
        sample = sample[sample != n]
    zeros = np.arange(0, n, 3)
    zeros = zeros[np.argsort(_key(x[zeros], rank[zeros + 1], n))]
    one, two = sample[sample % 3 == 1], sample[sample % 3 == 2]
    below = np.searchsorted(_key(x[one], rank[one + 1], n), _key(x[zeros], rank[zeros + 1], n))
    pairs = _names(np.concatenate([x[two], x[zeros]]), np.concatenate([x[two + 1], x[zeros + 1]]))
    below += np.searchsorted(_key(pairs[: len(two)], rank[two + 2], n), _key(pairs[len(two) :], rank[zeros + 2], n))
    at = np.arange(len(zeros)) + below
    out = np.empty(n, np.int64)
    free = np.ones(n, bool)
    free[at] = False
    out[at], out[free] = zeros, sample
    return out


def _key(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    return a * (n + 2) + b


def _names(*columns: np.ndarray) -> np.ndarray:
    """Ranks, from 1, of the rows of the columns among the distinct rows."""
    key = columns[0]
    for c in columns[1:]:
        width = int(c.max(initial=0)) + 1
        if int(key.max(initial=0)) >= (1 << 62) // width:
            key = np.unique(key, return_inverse=True)[1]
        key = key * width + c
    return np.unique(key, return_inverse=True)[1] + 1


def _argmin(keys: np.ndarray, width: int) -> np.ndarray:
    """Least key of every run of `width` keys."""
    have = 1
    while have < width:
        step = min(have, width - have)
        keys = np.minimum(keys[: len(keys) - step], keys[step:])
        have += step
    return keys


class Text:
    """Windows of one text of at least `length` bytes."""

    def __init__(self, data: np.ndarray, length: int, window: int):
        self.data, self.length, self.core, self.starts = data, length, length - window + 1, min(STARTS, length // 2)
        self.up, self.down = ragged._power_tables(len(data) + 1)
        self.total = np.zeros(len(data) + 1, U)
        with np.errstate(over="ignore"):
            np.cumsum(ragged.BYTE_CODES[data] * self.up[: len(data)], dtype=U, out=self.total[1:])
        grams = np.arange(len(data) - GRAM + 1)
        bits = U(max(int(len(data)).bit_length(), 20))
        least = _argmin(((self.hash(grams, grams + GRAM) >> bits) << bits) | grams.astype(U), window)[: len(data) - length + 1]
        anchor = (least & ((U(1) << bits) - U(1))).astype(np.int64)
        self.first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))  # first start of each anchor
        self.last = np.append(self.first[1:], len(anchor)) - 1
        self.anchor = anchor[self.first]

    def hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ragged.mix((self.total[b] - self.total[a]) * self.down[a])

    def cores(self) -> np.ndarray:
        return self.hash(self.anchor, self.anchor + self.core)

    def blocks(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first start, last start, inner core, hash of all bytes) of the blocks of some anchors' starts."""
        first, last, anchor = self.first[some], self.last[some], self.anchor[some]
        # cuts lie at fixed distances before the anchor, so that equal windows fall into blocks cut alike
        most, least = (anchor - first) // self.starts, (anchor - last) // self.starts
        n = most - least + 1
        owner = np.repeat(np.arange(len(n)), n)
        back = np.repeat(most, n) - (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        a = np.maximum(anchor[owner] - (back + 1) * self.starts + 1, first[owner])
        z = np.minimum(anchor[owner] - back * self.starts, last[owner])
        near = anchor[owner] - back * self.starts  # latest and earliest start the block could have
        with np.errstate(over="ignore"):
            place = ragged.mix(back.astype(U) + U(1))
            # near may lie beyond the last start, but the inner core is inside every window of the block
            inner = self.hash(near, np.minimum(near - self.starts + 1 + self.length, len(self.data))) ^ place
            return a, z, inner, self.hash(a, z + self.length) ^ ragged.mix((near - a).astype(U) + U(3)) ^ place


def repeated_starts(texts: list[bytes], starts: list[int], length: int) -> list[np.ndarray]:
    """For each text, which of its first `starts` positions begin a window that also begins at such a position of another text here, or of the same."""
    sizes = np.array([len(x) for x in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    begins = np.cumsum(sizes) - sizes
    # a separator after each text
    t = np.zeros(len(data) + len(texts), np.int64)
    t[np.arange(len(data)) + np.repeat(np.arange(len(texts)), sizes)] = data.astype(np.int64) + 2
    t[t == 0] = 1
    begins = begins + np.arange(len(texts))
    valid = np.zeros(len(t), bool)
    where = np.concatenate([np.arange(b, b + s) for b, s in zip(begins, starts, strict=True)])
    valid[where] = True
    order = suffix_array(t)
    order = order[valid[order]]
    up, down = ragged._power_tables(len(t) + 1)
    total = np.zeros(len(t) + 1, U)
    with np.errstate(over="ignore"):
        np.cumsum(ragged.mix(t.astype(U)) * up[: len(t)], dtype=U, out=total[1:])
        h = (total[order + length] - total[order]) * down[order]
    same = h[1:] == h[:-1]
    again = np.zeros(len(t), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return [again[b : b + s] for b, s in zip(begins, starts, strict=True)]


def find_repeats(docs: DataFrame, length: int = LENGTH, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, n_bytes, spans, kept_sha256) of every row: key is the hash of its text, spans the disjoint [start, end) byte ranges that go."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    facts = materialize(rows.select("doc_id", "key", n_bytes.alias("n_bytes"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha")), "facts")
    counts = facts.filter(F.col("n_bytes") >= length).groupBy(F.col("key").alias("k"), F.col("sha").alias("s")).agg(F.count("*").alias("copies"))
    # written out, a join deals both sides anew, and Spark can split a group of copies
    copies = materialize(counts.filter("copies > 1"), "copies")
    twins = materialize(counts.groupBy("k").agg(F.min("copies").alias("least")).filter("least > 1").select("k"), "twins")
    long_rows = rows.filter(n_bytes >= length)

    def texts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, int, Text]]:
        """(batch, row, number of equal texts of the batch, text): each text of a task once, as far as memory of them goes."""
        passed: set[int] = set()
        for b in batches:
            keys = b.column(1).to_pylist()
            data, offs = ragged.flat(b.column(2))
            for i, key in enumerate(keys):
                if key not in passed:
                    passed.add(key)
                    yield b, i, 1, Text(data[offs[i] : offs[i + 1]], length, window)
            if len(passed) > REMEMBERED:
                passed.clear()

    core_schema = pa.schema([("core", pa.int64()), ("many", pa.bool_())])

    def cores(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for _, _, _, text in texts(batches):
            held.append(text.cores())
            n += len(held[-1])
            if n > 1 << 18:
                c, k = np.unique(np.concatenate(held), return_counts=True)
                yield ragged.batch(core_schema, ragged.signed(c), k > 1)
                held, n = [], 0
        if n:
            c, k = np.unique(np.concatenate(held), return_counts=True)
            yield ragged.batch(core_schema, ragged.signed(c), k > 1)

    # a corpus has some core in 128 bytes, of which a part repeats
    size = facts.filter(F.col("n_bytes") >= length).agg(F.sum("n_bytes")).first()[0] or 0
    room = bits_for(size // 512)

    def several(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Places of the cores that occur again; rows come in order, so that only the last core is held."""
        held = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            core, n = np.concatenate([held[0], np.array(b.column(0), np.int64)]), np.concatenate([held[1], np.array(b.column(1), bool) + np.int64(1)])
            if not len(core):
                continue
            begins = np.flatnonzero(np.concatenate([[True], core[1:] != core[:-1]]))
            core, n = core[begins], np.minimum(np.add.reduceat(n, begins), 2)
            held = core[-1:], n[-1:]
            at = np.unique(core[n > 1].view(U) >> U(64 - room))
            yield pa.record_batch([pa.array((at << U(64 - room)).view(np.int64))], names=["core"])

    met = long_rows.mapInArrow(cores, "core long, many boolean").repartition("core").sortWithinPartitions("core").mapInArrow(several, "core long")
    known = share(spark, Marks.of(met, "core", room))
    block_schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("start", pa.int64()), ("n", pa.int32()), ("inner", pa.int64()), ("block", pa.int64())])

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, i, _, text in texts(batches):
            some = np.flatnonzero(known.value.marked(text.cores()))
            if len(some):
                a, z, inner, block = text.blocks(some)
                yield ragged.batch(block_schema, [b.column(0)[i].as_py()] * len(a), [b.column(1)[i].as_py()] * len(a), a, z - a + 1, ragged.signed(inner), ragged.signed(block))

    cut = materialize(long_rows.mapInArrow(_joined(blocks, block_schema), "doc_id long, key long, start long, n int, inner long, block long"), "blocks")
    alike = materialize(cut.groupBy("inner", "block").agg(F.count("*").alias("c"), F.max("n").alias("n")), "alike")
    mixed = alike.groupBy("inner").agg(F.count("*").alias("kinds"), F.min("c").alias("least")).filter("kinds > 1 AND least = 1")
    mixed = materialize(mixed, "mixed")
    unsure = share(spark, (Marks.of(mixed, "inner"), Marks.of(mixed.filter(F.col("kinds") > LARGE), "inner")))
    bytes_schema = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("hot", pa.bool_()), ("bytes", pa.binary())])

    def contents(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed: set[int] = set()
        for _, _, _, text in texts(batches):
            some = np.flatnonzero(known.value.marked(text.cores()))
            if not len(some):
                continue
            a, z, inner, block = text.blocks(some)
            out: list[tuple] = []
            large = unsure.value[1].marked(inner)
            for j in np.flatnonzero(unsure.value[0].marked(inner)).tolist():
                name = int(block[j])
                if name in passed:
                    continue
                passed.add(name)
                s, e = int(a[j]), int(z[j])
                if large[j]:
                    p = np.arange(s, e + 1)
                    out += [(h, name, k - s, 1, True, text.data[k : k + length].tobytes()) for h, k in zip(ragged.signed(text.hash(p, p + length)).tolist(), p.tolist(), strict=True)]
                else:
                    out.append((ragged.signed(inner[j : j + 1])[0], name, 0, e - s + 1, False, text.data[s : e + length].tobytes()))
            if len(passed) > REMEMBERED:
                passed.clear()
            if out:
                shard, name, start, n, hot, data = zip(*out, strict=True)
                yield ragged.batch(bytes_schema, shard, ragged.signed(np.array(name, U)), start, n, hot, data)

    parts = materialize(long_rows.mapInArrow(_joined(contents, bytes_schema), "shard long, block long, start int, n int, hot boolean, bytes binary"), "contents")
    # a block may come from several tasks: one of its texts stands for all
    few = parts.filter("NOT hot").join(mixed.select(F.col("inner").alias("m")), F.col("shard") == F.col("m"), "left_semi")
    one = few.groupBy("shard", "block", "start").agg(F.first(F.struct("n", "bytes")).alias("x")).select("shard", "block", "start", "x.*")
    mark_schema = pa.schema([("block", pa.int64()), ("marks", pa.list_(pa.int32()))])

    def order(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Starts, counted from the block's first, that repeat."""
        held: list[tuple] = []
        size, last = 0, None
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if size > SORTED_BYTES and row[0] != last:
                    yield from flush(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
                last = row[0]
        yield from flush(held)

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        if len(held) > 1:
            found = repeated_starts([r[4] for r in held], [r[3] for r in held], length)
            got = [(r[1], np.flatnonzero(f) + r[2]) for r, f in zip(held, found, strict=True) if f.any()]
            yield ragged.batch(mark_schema, [x for x, _ in got], [y for _, y in got])

    marks = one.repartition("shard").sortWithinPartitions("shard", "block", "start").mapInArrow(order, "block long, marks array<int>")
    whole = alike.filter("c > 1").select(F.col("block").alias("b"), F.lit(None).cast("array<int>").alias("marks"))
    marks = marks.unionByName(_repeated_windows(parts.filter("hot").select("shard", "block", "start", "bytes")))
    parted = marks.groupBy(F.col("block").alias("b")).agg(F.flatten(F.collect_list("marks")).alias("marks"))
    once = alike.filter("c = 1").select(F.col("block").alias("b")).distinct()
    decided = materialize(whole.unionByName(parted.join(once, "b", "left_semi")), "decided")
    found = cut.join(decided, F.col("block") == F.col("b")).select("doc_id", "key", "start", "n", "marks")
    # texts with an exact copy go whole, so that their copies meet nothing here
    found = found.join(twins, F.col("key") == F.col("k"), "left_anti")
    per_text = found.groupBy("key").agg(F.collect_list(F.struct("start", "n", "marks")).alias("found"))
    per_text = materialize(per_text.withColumnRenamed("key", "k"), "found")

    partial = share(spark, Marks.of(per_text, "k"))

    def touched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(partial.value.marked(np.array(b.column(1), np.int64).view(U))))

    cut_schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.string())])

    def remove(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                data, offs = ragged.flat(part.column(2))
                gone = _covered(part.column(3), offs, length)
                first = np.zeros(len(gone) + 1, bool)
                first[offs] = True
                begins = np.flatnonzero(gone & np.concatenate([[True], ~gone[:-1]]) | gone & first[:-1])
                ends = np.flatnonzero(gone & np.concatenate([~gone[1:], [True]]) | gone & first[1:]) + 1
                cut = np.searchsorted(begins, offs)
                spans = [[{"start": s, "end": e} for s, e in zip((begins[x:y] - o).tolist(), (ends[x:y] - o).tolist(), strict=True)] for x, y, o in zip(cut[:-1], cut[1:], offs[:-1], strict=True)]
                kept = [hashlib.sha256(data[x:y][~gone[x:y]].tobytes()).hexdigest() for x, y in zip(offs[:-1], offs[1:], strict=True)]
                yield ragged.batch(cut_schema, part.column(0), part.column(1), spans, kept)

    spans_type = "array<struct<start:bigint,end:bigint>>"
    some = long_rows.mapInArrow(touched, "doc_id long, key long, text string").join(per_text, F.col("key") == F.col("k")).select("doc_id", "key", "text", "found")
    parted = some.mapInArrow(remove, f"doc_id long, key long, spans {spans_type}, kept string").dropDuplicates(["doc_id", "key"]).withColumnsRenamed({"doc_id": "d", "key": "k2"})
    out = facts.join(copies, (F.col("key") == F.col("k")) & (F.col("sha") == F.col("s")) & (F.col("n_bytes") >= length), "left")
    out = out.join(parted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k2")), "left")
    everything = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    twin = F.col("copies").isNotNull()
    return out.select("doc_id", "key", "n_bytes", F.when(twin, everything).otherwise(F.coalesce("spans", F.expr(f"cast(array() as {spans_type})"))).alias("spans"), F.when(twin, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"))


def _repeated_windows(starts: DataFrame) -> DataFrame:
    """(block, marks) of the rows (shard, block, start, bytes) whose bytes are those of another row too; shard is a hash of the bytes."""
    places = [f(c).alias(f"{name}_{c}") for c in ("block", "start") for name, f in (("least", F.min), ("most", F.max))]
    windows = starts.groupBy("shard", "bytes").agg(F.count("*").alias("c"), *places)
    windows = windows.filter("least_block <> most_block OR least_start <> most_start").select(F.col("shard").alias("w"), F.col("bytes").alias("same"), "c")
    windows = materialize(windows, "windows")
    heavy = share(starts.sparkSession, Marks.of(windows.filter(F.col("c") > HEAVY), "w"))

    def flag(df: DataFrame) -> DataFrame:
        """Whether the bitmap marks the first column; both sides of the join ask the same bitmap."""
        names = [*df.columns, "heavy"]

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(heavy.value.marked(np.array(b.column(0), np.int64).view(U)))], names=names)

        return df.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) + ", heavy boolean")

    dealt = flag(starts).withColumn("salt", F.when(F.col("heavy"), F.pmod("block", F.lit(SALTS))).otherwise(F.lit(0).cast("long")))
    salts = F.when(F.col("heavy"), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    windows = flag(windows.drop("c")).select("w", "same", F.explode(salts).alias("s"))
    met = dealt.join(windows, (F.col("shard") == F.col("w")) & (F.col("salt") == F.col("s")) & (F.col("bytes") == F.col("same")), "left_semi")
    return met.select("block", F.array("start").alias("marks"))


def _covered(found: pa.Array, offs: np.ndarray, length: int) -> np.ndarray:
    """Which bytes of some texts, laid end to end, lie in repeated windows; `found` lists each text's blocks (start, n, marks)."""
    lists, blocks = np.asarray(found.offsets), found.flatten()
    base = np.repeat(offs[:-1], np.diff(lists))
    start, n, marks = np.array(blocks.field(0), np.int64) + base, np.array(blocks.field(1), np.int64), blocks.field(2)
    whole = np.array(marks.is_null(), bool)
    some = np.array(pa.compute.list_value_length(marks).fill_null(0), np.int64)
    single = np.repeat(start, some) + np.array(marks.flatten(), np.int64)
    opens = np.concatenate([start[whole], single])
    closes = np.concatenate([start[whole] + n[whole] - 1 + length, single + length])
    size = int(offs[-1])
    return np.cumsum(np.bincount(opens, minlength=size + 1)[:size] - np.bincount(closes, minlength=size + 1)[:size]) > 0


def _joined(produce, schema: pa.Schema, rows: int = 20_000):
    """The same batches, small ones put together."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in produce(batches):
            held.append(b)
            n += b.num_rows
            if n >= rows:
                yield from pa.Table.from_batches(held, schema).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held, schema).combine_chunks().to_batches()

    return run


def brute(texts: dict[int, str | None], length: int = LENGTH) -> dict[int, tuple[int, int, int, str]]:
    """{doc_id: (n_bytes, n_removed, n_spans, kept_sha256)} of a few texts."""
    data = {d: (x or "").encode() for d, x in texts.items()}
    seen: dict[bytes, list[tuple[int, int]]] = {}
    for d, x in data.items():
        for p in range(len(x) - length + 1):
            seen.setdefault(x[p : p + length], []).append((d, p))
    gone = {d: np.zeros(len(x), bool) for d, x in data.items()}
    for places in seen.values():
        for d, p in places if len(places) > 1 else ():
            gone[d][p : p + length] = True
    out = {}
    for d, x in data.items():
        g = gone[d]
        n_spans = int((g & ~np.concatenate([[False], g[:-1]])).sum()) if len(g) else 0
        out[d] = (len(x), int(g.sum()), n_spans, hashlib.sha256(np.frombuffer(x, np.uint8)[~g].tobytes()).hexdigest())
    return out
