"""Near-duplicate documents by a prefix-tree join of word n-gram sets.

A document is the set of its distinct n-word shingles (one shingle of all words, if
fewer).  Shingles are ordered globally, rare ones first: by a level from a count
sketch of fixed size over all documents, then by hash.  Two sets of Jaccard similarity t
or more share a shingle among the first |x| - ceil(t |x|) + 1 of each, so sets that meet
in a prefix shingle come together in a cluster.  A cluster is named by the most central set of the
shingle's group, its pivot: the one whose shingles are the most frequent on average, from which the others most likely stem.

Before that, sets that cannot be similar to any are screened out.  Similar sets share not one prefix shingle but, the closer their sizes, the more
of them, as shared shingles come in the same order in both; a set stays only if it shares enough with sets of some sizes.  And a set enters a shingle's
group only if there the shingle can be the first that it shares with a similar set, by what follows it in both: forms that differ a little too
much to be similar meet nowhere, however many they are.

Inside a cluster the ordered sets form a trie.  A set walks the trie once for all
others: partial overlaps are counted once a shared path, and a subtree is left as
soon as what remains of the set and of the longest member below cannot reach the overlap
needed.  The pivot walks first; sets connected with it need no walk of their own, the others walk too.

Clusters of BLOCK sets or more are cut by size classes, whose neighbours alone can be similar, and these into blocks,
each with the pivot.  The sets that no block and no other cluster has connected with the pivot then walk the tries of the other
blocks of neighbouring classes.  So no pair is missed, no task holds an unbounded cluster, and every task gives
at most one link a set, however many pairs are similar: links only join what is still apart.

Equal sets are one from the start.  Components of the links come from star contractions.

Defined cases: null and empty texts have no shingles and link with nothing, not even each other; repeated
rows are equal sets; a row of null id can be linked but gives no component its name unless all
are null; an empty table gives an empty result; other columns are ignored.  Sets are compared as 48-bit shingle hashes, of
which 6 bits follow from the others through the level: 42 bits tell shingles of equal level apart.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ragged
from .components import components
from .marks import Marks
from .storage import materialize, share

SHINGLE, PERCENT = 5, 80
SKETCH_BITS, CHUNK = 20, 1 << 14
BLOCK = 256
#: Shingles from this level on, of some 2^15 documents or more, are grouped by an aggregate and a join, which Spark splits, not in one task.
HOT_LEVEL = 16
#: Sets that a task remembers in order to pass each on once.
REMEMBERED = 500_000
U = np.uint64


def _sets(column: pa.Array, k: int, levels: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, shingles, offsets) by slices: the sorted distinct shingles of each row, in global order if levels are given."""
    for a, z, data, offs in ragged.parts(column):
        data = ragged.LOWER[data]
        starts, ends, first = ragged.spans(data, offs, ragged.SPACED)
        h, row = ragged.shingles(ragged.span_hashes(data, starts, ends), first, k)
        h = h >> U(6)
        if levels is not None:
            h = (levels[_slots(h)].astype(U) << U(58)) | h
        cut = np.searchsorted(row, np.arange(z - a + 1))
        each = [np.unique(h[s:e]) for s, e in zip(cut[:-1], cut[1:], strict=True)]
        yield a, z, np.concatenate([*each, np.zeros(0, U)]), np.cumsum([0, *map(len, each)])


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> U(58 - SKETCH_BITS)).astype(np.int64)


def _names(shingles: np.ndarray, offs: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit name of each set, whatever the levels of its members."""
    plain = shingles & U((1 << 58) - 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(shingles) + 1, U)
        np.cumsum(ragged.mix(plain ^ (U(salt) << U(58))), dtype=U, out=total[1:])
        return ragged.mix(total[offs[1:]] - total[offs[:-1]] + np.diff(offs).astype(U))


def _levels(sketch: np.ndarray) -> np.ndarray:
    """Frequency levels, 0 to 63, of the slots: 0 up to chance, then the binary magnitude of what lies above."""
    mean = np.median(sketch)
    above = sketch - mean - 4 * np.sqrt(mean + 1) - 4
    return np.where(above > 0, np.minimum(np.log2(np.maximum(above, 1)) + 1, 63), 0).astype(np.uint8)


def need(a: int, b: int, percent: int) -> int:
    """The least overlap of sets of a and b members at that Jaccard percentage."""
    return -(-percent * (a + b) // (100 + percent))


class Trie:
    """Radix trie of ordered sets; each edge keeps its run of members as an array."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        keys = [s.astype(">u8").tobytes() for s in sets]
        self.order = sorted(range(len(sets)), key=keys.__getitem__)
        self.root = self._build(0, len(sets), 0)

    def _build(self, lo: int, hi: int, depth: int) -> list:
        """[segment, end depth, shortest, longest, sets that end here, children] of the sorted sets lo to hi, alike up to depth."""
        a, b = self.sets[self.order[lo]], self.sets[self.order[hi - 1]]
        end = len(a) if lo + 1 == hi else depth + self._common(a[depth:], b[depth:])
        here, at, children = [], lo, []
        while at < hi and len(self.sets[self.order[at]]) == end:
            here.append(self.order[at])
            at += 1
        sizes = [len(self.sets[self.order[i]]) for i in range(lo, hi)]
        while at < hi:
            token, to = self.sets[self.order[at]][end], at + 1
            while to < hi and self.sets[self.order[to]][end] == token:
                to += 1
            children.append((at, to))
            at = to
        return [a[depth:end], end, min(sizes), max(sizes), here, [self._build(x, y, end) for x, y in children]]

    @staticmethod
    def _common(a: np.ndarray, b: np.ndarray) -> int:
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        return int(differ[0]) if len(differ) else n

    def similar(self, q: np.ndarray, percent: int) -> list[int]:
        """Sets of the trie within the similarity of q."""
        out, n, stack = [], len(q), [(self.root, 0, 0)]
        while stack:
            (segment, end, short, long, here, children), overlap, i = stack.pop()
            if 100 * long < percent * n or percent * short > 100 * n:
                continue
            least = need(n, max(short, -(-percent * n // 100)), percent)
            start, step, dead = 0, 256, False
            while start < len(segment):
                part = segment[start : start + step]
                at = np.searchsorted(q, part)
                overlap += int((q[np.minimum(at, n - 1)] == part).sum())
                i = int(np.searchsorted(q, part[-1], "right"))
                start += len(part)
                step *= 2
                if overlap + min(n - i, long - (end - len(segment) + start)) < least:
                    dead = True
                    break
            if dead:
                continue
            out += [s for s in here if overlap >= need(n, len(self.sets[s]), percent)]
            stack += [(c, overlap, i) for c in children]
        return out


class Joined:
    """Which of some things are connected already."""

    def __init__(self) -> None:
        self.to: dict[int, int] = {}

    def find(self, x: int) -> int:
        while self.to.get(x, x) != x:
            self.to[x] = self.to.get(self.to[x], self.to[x])
            x = self.to[x]
        return x

    def join(self, x: int, y: int) -> bool:
        """Connect two things; whether they were apart."""
        x, y = self.find(x), self.find(y)
        self.to[y] = x
        return x != y


def links_within(sets: list[np.ndarray], percent: int) -> tuple[list[tuple[int, int]], list[int]]:
    """Places of sets whose links connect what is similar, of which the first walks first, then those not connected with it; and the places never connected with it."""
    trie, group = Trie(sets), Joined()
    out: list[tuple[int, int]] = []
    for i in range(len(sets)):
        # of two similar sets one connected with the first, the other not, the other walks
        if i == 0 or group.find(i) != group.find(0):
            out += [(i, j) for j in trie.similar(sets[i], percent) if group.join(i, j)]
    return out, [i for i in range(1, len(sets)) if group.find(i) != group.find(0)]


def _groups(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of equal leading columns, which come one after another."""
    key, rows = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[:keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield key, rows


def _unpack(packed: bytes) -> np.ndarray:
    wide = np.zeros((len(packed) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    return wide.view("<u8").reshape(-1)


def _survey(rows: DataFrame, shingle: int) -> tuple[DataFrame, np.ndarray]:
    """((doc_id, key, n, name, twin) of every row, the levels of the slots)."""
    slots = 1 << SKETCH_BITS
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("name", pa.int64()), ("twin", pa.int64()), ("chunk", pa.int32()), ("counts", pa.binary())])

    def survey(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Size and names of every set; then the task's sketch, in chunks."""
        sketch = np.zeros(slots, np.int64)
        for b in batches:
            for a, z, h, offs in _sets(b.column(2), shingle):
                sketch += np.bincount(_slots(h), minlength=slots)
                n = z - a
                yield ragged.batch(schema, b.column(0)[a:z], b.column(1)[a:z], np.diff(offs), ragged.signed(_names(h, offs, 1)), ragged.signed(_names(h, offs, 2)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()))
        if sketch.any():
            # counts beyond 16 bits saturate: such shingles are at the end of the order anyway
            low = np.minimum(sketch, 65535).astype("<u2")
            parts = [low[i : i + CHUNK].tobytes() for i in range(0, slots, CHUNK)]
            none = pa.nulls(len(parts), pa.int64())
            yield ragged.batch(schema, none, none, none, none, none, np.arange(len(parts)), parts)

    def total(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(counts, "<u2").astype(np.int64)
        if sums:
            yield pa.record_batch([pa.array(sums, pa.int32()), pa.array([np.minimum(v, 2**32 - 1).astype("<u4").tobytes() for v in sums.values()], pa.binary())], names=["chunk", "counts"])

    seen = materialize(rows.mapInArrow(survey, "doc_id long, key long, n long, name long, twin long, chunk int, counts binary"), "surveyed")
    sketched = seen.filter("chunk IS NOT NULL").select("chunk", "counts").repartition("chunk").mapInArrow(total, "chunk int, counts binary").toArrow()
    sketch = np.zeros(slots, np.int64)
    for chunk, counts in zip(sketched.column("chunk").to_pylist(), sketched.column("counts").to_pylist(), strict=True):
        sketch[chunk * CHUNK : (chunk + 1) * CHUNK] = np.frombuffer(counts, "<u4")
    return seen.filter("chunk IS NULL").drop("chunk", "counts"), _levels(sketch)


def _unpacked(token: np.ndarray, name: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """(token, name, centrality, size, prefix place) in order of token, size and name, each set of a token once."""
    central, n, at = place >> 55, (place >> 27) & ((1 << 28) - 1), place & ((1 << 27) - 1)
    order = np.lexsort((name, n, token))
    columns = tuple(x[order] for x in (token, name, central, n, at))
    # the same set may come from several tasks
    once = np.concatenate([[True], (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])])
    return tuple(x[once] for x in columns)


def least_shared(m: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """Prefix shingles that similar sets of m and n members share at least.

    Of a prefix, at most the members that the sets do not share are missing in the other set, and shared members keep their order: the first ones of
    them lie in both prefixes.  Two less than that, at least 1, so that the bound falls the further the sizes are apart, whatever is rounded.
    """
    overlap = -(-percent * (m + n) // (100 + percent))
    prefix = lambda k: k + (-percent * k // 100) + 1
    return np.maximum(np.minimum(prefix(m) - (m - overlap), prefix(n) - (n - overlap)) - 2, 1)


def _needs(token: np.ndarray, name: np.ndarray, place: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(name, need) of the sets that share their token with one of a size that allows a link: the least that it and any of those must share in all."""
    token, name, _, n, _ = _unpacked(token, name, place)
    group = np.cumsum(np.concatenate([[True], token[1:] != token[:-1]])) - 1
    key, own = (group << 30) + n, np.arange(len(n))
    low = np.searchsorted(key, (group << 30) - (-percent * n // 100))
    high = np.searchsorted(key, (group << 30) + 100 * n // percent, "right") - 1
    some = high > low
    low, high, own, n_own = low[some], high[some], own[some], n[some]
    # the bound is least for the sizes furthest off
    low, high = np.where(low == own, low + 1, low), np.where(high == own, high - 1, high)
    return name[some], np.minimum(least_shared(n_own, n[low], percent), least_shared(n_own, n[high], percent))


def first_shared(token: np.ndarray, n: np.ndarray, at: np.ndarray, several: np.ndarray, percent: int) -> np.ndarray:
    """Rows whose token can be the first shingle shared with a similar set of another row of the token.

    Rows come by token and size, at: the token's place in the set.  Where it is the first shared, the sets share what follows in both at
    most, the lesser of n - at and n' - at', and similar ones share percent (n + n') / (100 + percent) or more.  A row that stands for
    `several` sets may meet itself.
    """
    group = np.cumsum(np.concatenate([[True], token[1:] != token[:-1]])[: len(token)])
    sure = np.flatnonzero(several | (np.bincount(group)[group] > 1))
    if not len(sure):
        return sure
    group, n, at, several = group[sure] << 30, n[sure], at[sure], several[sure]
    key, own = group + n, np.arange(len(n))
    room = (100 + percent) * (n - at) - percent * n  # of a partner: percent times the own size at least
    low = np.searchsorted(key, group - (-percent * n // 100))
    most = np.minimum(100 * n // percent, (100 + percent) * (n - at) // percent - n)
    high = np.maximum(np.searchsorted(key, group + np.maximum(most, 0), "right"), low)
    runs = [room]  # greatest room of 1, 2, 4, ... neighbours
    while 2 << (len(runs) - 1) <= (high - low).max():
        half = 1 << (len(runs) - 1)
        runs.append(np.maximum(runs[-1][:-half], runs[-1][half:]))

    def greatest(a: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Of rows a to z - 1; below every room where there are none."""
        out = np.full(len(a), np.iinfo(np.int64).min)
        power = np.frexp(np.maximum(z - a, 0).astype(float))[1] - 1
        for k, run in enumerate(runs):
            of = np.flatnonzero(power == k)
            out[of] = np.maximum(run[a[of]], run[z[of] - (1 << k)])
        return out

    best = np.maximum(greatest(low, np.minimum(own, high)), greatest(np.maximum(own + 1, low), high))
    best = np.where(several & (low <= own) & (own < high), np.maximum(best, room), best)
    return sure[best >= percent * n]


def _pairs(token: np.ndarray, name: np.ndarray, place: np.ndarray, percent: int) -> np.ndarray:
    """Distinct rows (pivot, name) of whole groups of equal tokens; place: centrality, size and prefix place of the set, packed."""
    token, name, central, n, at = _unpacked(token, name, place)
    some = first_shared(token, n, at, np.zeros(len(n), bool), percent)
    token, name, central, n, at = token[some], name[some], central[some], n[some], at[some]
    if not len(token):
        return np.zeros((0, 2), np.int64)
    # sizes ascend inside a group: where one is too small for the next, nothing before is similar to anything after
    new = np.concatenate([[True], (token[1:] != token[:-1]) | (100 * n[:-1] < percent * n[1:])])
    begins, part = np.flatnonzero(new), np.cumsum(new) - 1
    best = np.lexsort((name, -central, part))[begins]
    pivot = name[best][part]
    pairs_only = begins[np.diff(np.append(begins, len(token))) == 2]
    most = np.minimum(n - at, np.roll(n - at, -1))[pairs_only] + np.minimum(at, np.roll(at, -1))[pairs_only]
    far = pairs_only[(100 + percent) * most < percent * (n[pairs_only] + np.roll(n, -1)[pairs_only])]
    pivot[far], pivot[far + 1] = name[far], name[far + 1]
    apart = pivot != name
    return np.unique(np.stack([pivot[apart], name[apart]], axis=1), axis=0)


def _tokens(rows: DataFrame, levels: Broadcast, shingle: int, percent: int, alive: Broadcast | None = None) -> DataFrame:
    """(token, name, place) of every prefix shingle of every set, each set of a task once; with `alive` only of the sets that it marks."""
    schema = pa.schema([("token", pa.int64()), ("name", pa.int64()), ("place", pa.int64())])

    def prefixes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed: set[int] = set()
        for b in batches:
            for _, _, h, offs in _sets(b.column(0), shingle, levels.value):
                raw, n = _names(h, offs, 1), np.diff(offs)
                central = np.minimum(4 * ragged.row_sums((h >> U(58)).astype(np.int64), offs) // np.maximum(n, 1), 255)
                fresh = np.zeros(len(n), bool)
                for i in np.flatnonzero((n > 0) & (alive.value.marked(raw) if alive is not None else True)).tolist():
                    if int(raw[i]) not in passed:
                        fresh[i] = True
                        passed.add(int(raw[i]))
                if len(passed) > REMEMBERED:
                    passed.clear()
                take = np.where(fresh, n - -(-percent * n // 100) + 1, 0)
                at = np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)
                place = np.repeat((central << 55) | (n << 27), take) | at
                yield ragged.batch(schema, ragged.signed(h[at + np.repeat(offs[:-1], take)]), ragged.signed(np.repeat(raw, take)), place)

    return rows.select("text").mapInArrow(prefixes, "token long, name long, place long")


def _by_token(tokens: DataFrame, work, sql: str) -> DataFrame:
    """Rows that `work` makes of whole groups of equal tokens, which come in order: the last token's rows wait for more."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for b in batches:
            new = tuple(np.array(c, np.int64) for c in b.columns)
            if not len(new[0]):
                continue
            cut = int(np.searchsorted(new[0], new[0][-1]))
            if cut or (held and held[0][0][0] != new[0][-1]):
                yield given([*held, tuple(c[:cut] for c in new)])
                held = []
            held.append(tuple(c[cut:] for c in new))
        if held:
            yield given(held)

    def given(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        made = work(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return pa.record_batch([pa.array(c) for c in made], names=[x.split()[0] for x in sql.split(", ")])

    return tokens.repartition("token").sortWithinPartitions("token").mapInArrow(run, sql)


def _clusters(rows: DataFrame, levels: Broadcast, shingle: int, percent: int) -> DataFrame:
    """Distinct (pivot, name): sets that meet the pivot, or each other and the pivot, in a prefix shingle.

    Sets are screened first: one goes if for no number it shares so many prefix shingles with sets of which the sizes ask for no more.
    """
    level = F.expr("shiftrightunsigned(token, 58)")
    is_hot = int(levels.value.max()) >= HOT_LEVEL
    cool = lambda tokens: tokens.filter(level < HOT_LEVEL) if is_hot else tokens
    every = _tokens(rows, levels, shingle, percent)
    needs = _by_token(cool(every), lambda t, name, place: _needs(t, name, place, percent), "name long, need long").groupBy("name", "need").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("name").orderBy("need"))
    alive = needs.withColumn("upto", upto).filter("upto >= need").select("name")
    if is_hot:  # these meet so many others that they stay
        alive = alive.unionByName(every.filter(level >= HOT_LEVEL).select("name"))
    marks = share(rows.sparkSession, Marks.of(materialize(alive.distinct(), "alive"), "name"))
    tokens = _tokens(rows, levels, shingle, percent, marks)

    def meet(token: np.ndarray, name: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pairs = _pairs(token, name, place, percent)
        return pairs[:, 0], pairs[:, 1]

    met = _by_token(cool(tokens), meet, "pivot long, name long")
    if is_hot:
        hot = materialize(tokens.filter(level >= HOT_LEVEL), "hot")
        hot = _hot_meetings(hot, percent)
        first = hot.groupBy(F.col("token").alias("t")).agg(F.min(F.struct(-F.shiftright("place", 55), F.col("name").alias("pivot"))).alias("x")).select("t", "x.pivot")
        met = met.unionByName(hot.join(first, F.col("token") == F.col("t")).filter("pivot <> name").select("pivot", "name"))
    return materialize(met.distinct(), "clusters")


def _hot_meetings(hot: DataFrame, percent: int) -> DataFrame:
    """The rows (token, name, place) of frequent tokens that first_shared() leaves, judged by the sizes and places that a token has, not by its sets."""
    size, at = F.expr("shiftright(place, 27) & ((1L << 28) - 1)"), F.expr("place & ((1L << 27) - 1)")
    kinds = hot.groupBy("token", size.alias("n"), at.alias("at")).agg(F.count("*").alias("c"))

    def judge(token: np.ndarray, n: np.ndarray, at: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort((at, n, token))
        token, n, at, c = token[order], n[order], at[order], c[order]
        some = first_shared(token, n, at, c > 1, percent)
        return token[some], n[some], at[some]

    left = _by_token(kinds, judge, "token long, n long, at long").select(F.xxhash64("token", "n", "at").alias("kind"))
    marks = share(hot.sparkSession, Marks.of(materialize(left, "kinds"), "kind"))

    def kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(marks.value.marked(np.array(b.column(3), np.int64).view(U)))).select([0, 1, 2])

    found = hot.select("token", "name", "place", F.xxhash64("token", size, at).alias("kind"))
    return materialize(found.mapInArrow(kept, "token long, name long, place long"), "hot_kept")


def _stored(rows: DataFrame, met: DataFrame, levels: Broadcast, shingle: int) -> DataFrame:
    """(member, n, shingles) of every set of a cluster, once: shingles of 6 bytes in global order."""
    names = met.select("name").unionByName(met.select(F.col("pivot").alias("name")))
    wanted = share(rows.sparkSession, Marks.of(names, "name"))
    schema = pa.schema([("member", pa.int64()), ("n", pa.int64()), ("shingles", pa.binary())])

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed: set[int] = set()
        for b in batches:
            for _, _, h, offs in _sets(b.column(0), shingle, levels.value):
                raw, n = _names(h, offs, 1), np.diff(offs)
                found = []
                for i in np.flatnonzero(wanted.value.marked(raw) & (n > 0)).tolist():
                    if int(raw[i]) not in passed:
                        passed.add(int(raw[i]))
                        found.append(i)
                if len(passed) > REMEMBERED:
                    passed.clear()
                bare = (h >> U(16)).view(np.uint8).reshape(-1, 8)[:, :6]
                yield ragged.batch(schema, ragged.signed(raw[found]), n[found], [bare[offs[i] : offs[i + 1]].tobytes() for i in found])

    return materialize(rows.select("text").mapInArrow(pack, "member long, n long, shingles binary").dropDuplicates(["member"]), "sets")


def _placed(met: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """((pivot, class, block, name) of every set and, in every block, of the pivot; (pivot, class, blocks)): small clusters are one block of class -1."""
    sized = met.join(sets.select("member", "n"), F.col("name") == F.col("member")).select("pivot", "name", "n")
    totals = sized.groupBy(F.col("pivot").alias("p")).agg(F.count("*").alias("total"))
    # a little wider than the ratio of sizes, so that rounding never puts similar sets two classes apart
    by_size = F.floor(F.log("n") / float(np.log(100 / percent) * 1.0001)).cast("int")
    classed = materialize(sized.join(totals, F.col("pivot") == F.col("p")).select("pivot", F.when(F.col("total") < BLOCK, F.lit(-1)).otherwise(by_size).alias("class"), "name"), "classed")
    layout = materialize(classed.groupBy("pivot", "class").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "layout")
    block = F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int").alias("block")
    placed = classed.join(layout, ["pivot", "class"]).select("pivot", "class", block, "name")
    return placed.unionByName(layout.select("pivot", "class", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("pivot").alias("name"))), layout


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, n_shingles, component_id) of every row: key is the hash of its text, component_id the smallest id reachable by links."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    members, found = _survey(rows, shingle)
    levels = share(docs.sparkSession, found)
    met = _clusters(rows, levels, shingle, percent)
    sets = _stored(rows, met, levels, shingle)
    placed, layout = _placed(met, sets, percent)
    loaded = placed.join(sets, F.col("name") == F.col("member")).select("pivot", "class", "block", (F.col("name") != F.col("pivot")).alias("later"), "name", "shingles")
    result = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("pivot", pa.int64()), ("class", pa.int32()), ("block", pa.int32())])

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of each block as (a, b); of large clusters the sets not connected with the pivot, with their place."""
        for (pivot, kind, block), group in _groups(batches, 3):
            links, left = links_within([_unpack(g[2]) for g in group], percent)
            left = left if kind >= 0 else []
            a, b = [group[i][1] for i, _ in links] + [group[i][1] for i in left], [group[j][1] for _, j in links] + [None] * len(left)
            if a:
                none = [None] * len(links)
                yield ragged.batch(result, a, b, none + [pivot] * len(left), none + [kind] * len(left), none + [block] * len(left))

    walked = loaded.repartition("pivot", "class", "block").sortWithinPartitions("pivot", "class", "block", "later")
    walked = materialize(walked.mapInArrow(walk, "a long, b long, pivot long, class int, block int"), "walked")
    roots = materialize(components(walked.filter("b IS NOT NULL").select("a", "b")), "roots")
    more = _strays(walked.filter("b IS NULL").drop("b"), loaded, layout, roots, sets, percent)
    return _label(members, roots, more)


def _strays(strays: DataFrame, loaded: DataFrame, layout: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """(node, root) of components that links across blocks join, named by their roots so far; None without such links."""
    root_of = lambda df, column, name: df.join(roots.withColumnsRenamed({"node": "__n", "root": "__r"}), F.col(column) == F.col("__n"), "left").withColumn(name, F.coalesce("__r", column)).drop("__n", "__r")
    apart = root_of(root_of(strays, "a", "root"), "pivot", "pr").filter("root <> pr").select(F.col("a").alias("name"), "pivot", F.col("class").alias("c"), F.col("block").alias("own"), "root")
    apart = materialize(apart, "strays")
    if not apart.limit(1).count():
        return None
    many = apart.groupBy(F.col("pivot").alias("p"), F.col("c").alias("k")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    dealt = apart.join(many, (F.col("pivot") == F.col("p")) & (F.col("c") == F.col("k"))).withColumn("part", F.pmod(F.xxhash64("name", F.lit(1)), F.col("parts")).cast("int"))
    there = layout.withColumnRenamed("pivot", "p2")
    sent = dealt.drop("p", "k").join(there, (F.col("pivot") == F.col("p2")) & (F.abs(F.col("class") - F.col("c")) <= 1)).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sent = materialize(sent.filter("class <> c OR block <> own").select("pivot", "class", "block", "c", "part", "name", "root"), "sent")
    place = ["pivot", "class", "block"]
    queries = sent.join(sets, F.col("name") == F.col("member")).select(*place, "c", "part", F.lit(True).alias("stray"), "root", "shingles")
    against = root_of(loaded.join(sent.select(*place, "c", "part").distinct(), place), "name", "root").select(*place, "c", "part", F.lit(False).alias("stray"), "root", "shingles")

    def cross(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in _groups(batches, 5):
            there = [g for g in group if not g[0]]
            trie, joined = Trie([_unpack(g[2]) for g in there]), Joined()
            links = [(g[1], there[j][1]) for g in group if g[0] for j in trie.similar(_unpack(g[2]), percent) if joined.join(g[1], there[j][1])]
            if links:
                a, b = zip(*links, strict=True)
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    # few groups of much work each: dealt out by number, as small partitions would be put together by size
    groups = sent.select(*place, "c", "part").distinct().count()
    parts = max(int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions")), groups // 4)
    both = queries.unionByName(against).repartition(parts, *place, "c", "part").sortWithinPartitions(*place, "c", "part", "stray")
    links = materialize(both.mapInArrow(cross, "a long, b long"), "crossed")
    return materialize(components(links), "joined") if links.limit(1).count() else None


def _label(members: DataFrame, roots: DataFrame, more: DataFrame | None) -> DataFrame:
    named = members.join(roots, F.col("name") == F.col("node"), "left").select("doc_id", "key", "n", "twin", "name", F.col("root").alias("first"))
    if more is None:
        named = named.withColumn("root", F.col("first"))
    else:
        named = named.join(more, F.coalesce("first", "name") == F.col("node"), "left").withColumn("root", F.coalesce("root", "first"))
    named = named.select("doc_id", "key", "n", F.coalesce("root", "name").alias("r"), F.when(F.col("root").isNull(), F.col("twin")).alias("t"))
    least = named.filter("n > 0").groupBy(F.col("r").alias("r2"), F.col("t").alias("t2")).agg(F.min("doc_id").alias("least"))
    out = named.join(least, (F.col("n") > 0) & (F.col("r") == F.col("r2")) & F.col("t").eqNullSafe(F.col("t2")), "left")
    return out.select("doc_id", "key", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def brute(rows: list[tuple[int, str | None]], shingle: int = SHINGLE, percent: int = PERCENT) -> dict[int, tuple[int, int]]:
    """{doc_id: (set size, component)} of a few rows of distinct ids, pair by pair."""
    sets: dict[int, set[tuple[str, ...]]] = {}
    for doc, text in rows:
        w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c in "\t\n\v\f\r" else c for c in text or "").split(" ") if x]
        sets[doc] = {tuple(w[i : i + shingle]) for i in range(max(len(w) - shingle + 1, 1))} if w else set()
    group = {d: d for d in sets}

    def find(d: int) -> int:
        while group[d] != d:
            d = group[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                group[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


#: The registered query as DuckDB SQL over a view `documents` of distinct ids.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), i AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.d
)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT d, min(c) AS component_id FROM r GROUP BY d) ON d = w.doc_id
"""
