"""Toxicity: a support vector machine on a subsequence string kernel with Nyström landmarks.

Units are the words of a sentence, letters folded to a small alphabet, long ones cut into overlapping windows, and every stretch of three or
more pieces of at most SHORT letters, written together, so that an insult spelled out with gaps or marks is a unit too.  The kernel of two units is the gap-weighted
count of the three-letter subsequences that they share: three letters spanning s places weigh DECAY ** s, SPAN places at most; what is no letter
takes a place but never matches.  Insertions and gaps lower a count and do not void it.  The kernel is normalised, and raised to a
power, which keeps it a kernel; values under FLOOR count as 0.

Nyström: landmarks are units of the sample: the most typical of toxic documents, as many units of clean documents that are most like those, and some drawn from all; a unit becomes its
kernel values with them times the inverse root of their own kernel matrix.  On that a linear machine with squared hinge loss learns.  A
document's score is a logistic curve of the TOP highest ratings of its different units and of their number, fitted to documents and single sentences of the sample.

Labels mark whole documents, so sentences are labelled as in multiple-instance learning: those of clean documents are clean; of
a toxic document those count as toxic that hold a unit which the round before rates so (the first round: one that is more common in
toxic documents, near copies counted once, by a likelihood ratio of SURE or more).  Units are learned a second time spelled with gaps or an inserted character, toxic ones and clean ones, so that neither is a sign by itself.

Training reads about `sample` labelled documents a class (an expected number; rows are drawn by a fixed hash of their id), of each
at most SENTENCES sentences, drawn by hash too.  Scoring reads whole texts; a task rates each different unit once, as long as its
store of RATED ratings lasts.

Defined cases: a null text scores as an empty one, as if it had units like no landmark; rows of a null label or id are not learned from; a doc_id labelled more
than once counts once for each label; with labels of one class, or none, every score is the share of toxic labels (0 if there are none);
repeated rows each get their row; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ragged
from .sampling import unit

SAMPLE, SENTENCES = 1500, 24
LANDMARKS, SPAN, DECAY, POWER, FLOOR = 96, 7, 0.8, 3, 0.3
SURE, RATED = 20, 1 << 20
#: Units of which the subsequences are held at once.
AT_ONCE = 1 << 13
#: Weight of clean units against toxic ones, and of the ridge.
NEG, PEN = 2, 1e-3
#: Ratings of a document that its score depends on.
TOP = 3
#: Letters of a window of a long word, and from one window to the next.
WINDOW, STRIDE = 24, 12
#: Pieces of so few letters are written together.
SHORT = 2
#: Classes of characters: 0 no letter, 1 to 26 a to z, 27 to 31 bytes of other letters, EDGE before and after a unit.
CLASSES, EDGE = 33, 32
_FOLD = np.zeros(256, np.int64)
_FOLD[97:123] = _FOLD[65:91] = np.arange(1, 27)
_FOLD[128:] = 27 + np.arange(128) % 5
_LINE, _MARK, _SPACE = ragged.byte_class("\x0a\x0d"), ~ragged.byte_class("..!!??"), ~ragged.SPACED


@dataclass
class Units:
    """Different units of some texts: folded letters, laid end to end."""

    letters: np.ndarray
    offs: np.ndarray

    def take(self, at: np.ndarray) -> Units:
        return gathered(self.letters, self.offs[:-1][at], self.offs[1:][at])


def _joined(few: np.ndarray, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) piece of every stretch of three or more pieces of few letters within a sentence."""
    edge = np.concatenate([[True], sentence[1:] != sentence[:-1], [True]])
    flag = np.concatenate([[False], few, [False]])
    first = np.flatnonzero(flag[1:-1] & (~flag[:-2] | edge[:-1]))
    end = np.flatnonzero(flag[1:-1] & (~flag[2:] | edge[1:])) + 1
    long = end - first >= 3
    return first[long], end[long]


def units(data: np.ndarray, offs: np.ndarray) -> tuple[Units, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(different units, their hashes, number of the unit of each occurrence, its sentence, row of each sentence) of a slice of texts."""
    # a mark ends a sentence before white space or an end, so that marks put into a word do not
    ended = _MARK[data]
    last = np.zeros(len(data) + 1, bool)
    last[offs] = True
    ended[:-1] &= _SPACE[data[1:]] | last[1:-1]
    lines = np.where(ended, np.uint8(10), data)
    begins, _, first = ragged.spans(lines, offs, _LINE)
    rows = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    starts, ends, _ = ragged.spans(lines, offs, ragged.SPACED)
    sentence = np.searchsorted(begins, starts, "right") - 1
    folded = _FOLD[data]
    # pieces of few letters, whatever stands between them, are written together behind the texts
    low, high, _ = ragged.spans(lines, offs, _FOLD > 0)
    of = np.searchsorted(begins, low, "right") - 1
    a, z = _joined(high - low <= SHORT, of) if len(low) else (np.zeros(0, np.int64),) * 2
    word = np.repeat(a - np.concatenate([[0], np.cumsum(z - a)[:-1]]), z - a) + np.arange(int((z - a).sum())) if len(a) else np.zeros(0, np.int64)
    size = (high - low)[word]
    place = np.repeat(low[word] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    total = np.concatenate([[0], np.cumsum(size)])
    words = np.concatenate([[0], np.cumsum(z - a)])
    extra = len(data) + total[words]
    folded = np.concatenate([folded, folded[place]]) if len(place) else folded
    starts, ends, sentence = np.concatenate([starts, extra[:-1]]), np.concatenate([ends, extra[1:]]), np.concatenate([sentence, of[a]])
    # long units become windows that overlap by half
    pieces = np.maximum(-(-(ends - starts - WINDOW) // STRIDE), 0) + 1
    of = np.repeat(np.arange(len(starts)), pieces)
    back = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts, sentence = starts[of] + STRIDE * back, sentence[of]
    ends = np.minimum(starts + WINDOW, ends[of])
    h = ragged.span_hashes(folded.astype(np.uint8), starts, ends)
    names, at, number = np.unique(h, return_index=True, return_inverse=True)
    return edged(folded, starts[at], ends[at]), names, number, sentence, rows


def edged(letters: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Units:
    """Stretches of letters as units, with an edge before and after each."""
    plain = gathered(letters, starts, ends)
    at = np.arange(len(plain.offs) - 1)
    out = np.full(len(plain.letters) + 2 * len(at), EDGE, np.int64)
    out[np.arange(len(plain.letters)) + 2 * np.repeat(at, np.diff(plain.offs)) + 1] = plain.letters
    return Units(out, plain.offs + 2 * np.arange(len(plain.offs)))


def gathered(letters: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Units:
    """Stretches of letters, laid end to end."""
    size = ends - starts
    offs = np.concatenate([[0], np.cumsum(size)])
    return Units(letters[np.repeat(starts - offs[:-1], size) + np.arange(offs[-1])], offs)


def subsequences(u: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, code, weight) of every three-letter subsequence; a code may come more than once in a unit."""
    x, n = u.letters, len(u.letters)
    owner = np.repeat(np.arange(len(u.offs) - 1), np.diff(u.offs))
    room = u.offs[1:][owner] - np.arange(n) if n else np.zeros(0, np.int64)
    who, codes, weights = [], [], []
    for far in range(2, SPAN):
        i = np.flatnonzero((room > far) & (x > 0))
        i = i[x[i + far] > 0]
        for near in range(1, far):
            j = i[x[i + near] > 0]
            who.append(owner[j])
            codes.append((x[j] * CLASSES + x[j + near]) * CLASSES + x[j + far])
            weights.append(np.full(len(j), DECAY ** (far + 1)))
    return tuple(map(np.concatenate, (who, codes, weights)))


@dataclass
class Model:
    first: np.ndarray = field(default_factory=lambda: np.zeros(CLASSES**3 + 1, np.int64))  # first entry of each code, and the total
    landmark: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # of each entry
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))  # weight of the code in the landmark over its norm
    size: int = 0  # landmarks
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))  # of the powers of the normalised kernel with each landmark
    bias: float = 0.0
    curve: np.ndarray = field(default_factory=lambda: np.zeros(TOP + 2))  # weights of marks(), and a constant
    share: float = 0.0  # of toxic labels

    def kernel(self, u: Units) -> np.ndarray:
        """Powers of the normalised kernel of units with landmarks, 0 below FLOOR."""
        n = len(u.offs) - 1
        parts = [self._kernel(u.take(np.arange(a, min(a + AT_ONCE, n)))) for a in range(0, n, AT_ONCE)]
        return np.concatenate(parts) if parts else np.zeros((0, self.size), np.float32)

    def _kernel(self, u: Units) -> np.ndarray:
        n = len(u.offs) - 1
        who, codes, weights = subsequences(u)
        entries = self.first[codes + 1] - self.first[codes]
        held = np.flatnonzero(entries)
        times = entries[held]
        at = np.repeat(self.first[codes[held]] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
        out = np.bincount(np.repeat(who[held], times) * self.size + self.landmark[at], weights=np.repeat(weights[held], times) * self.value[at], minlength=n * self.size).reshape(n, self.size)
        # without the products of a code that comes twice a norm is too small and the kernel too large: only where that passes FLOOR does the norm matter
        near = np.flatnonzero(out.max(axis=1, initial=0) >= FLOOR * np.sqrt(np.bincount(who, weights=weights**2, minlength=n)))
        norm = np.full(n, np.inf)
        norm[near] = np.maximum(norms(*subsequences(u.take(near)), len(near)), 1e-12)
        out = np.minimum(out / norm[:, None], 1.0)
        return (np.where(out >= FLOOR, out, 0.0) ** POWER).astype(np.float32)

    def ratings(self, u: Units) -> np.ndarray:
        """Margins of units, cut to what the hinge tells apart."""
        return np.clip(self.kernel(u) @ self.weights + self.bias, -1, 1)

    def score(self, data: np.ndarray, offs: np.ndarray, known: Ratings | None = None) -> np.ndarray:
        """Score of each row of a slice of texts."""
        if not len(self.weights):
            return np.full(len(offs) - 1, self.share)
        found, names, number, sentence, rows = units(data, offs)
        known = known or Ratings()
        each, old = known.find(names)
        fresh = np.flatnonzero(~old)
        if len(fresh):
            each[fresh] = self.ratings(found.take(fresh))
            known.add(names[fresh], each[fresh])
        pair = np.sort(rows[sentence] * len(names) + number)
        pair = pair[np.diff(pair, prepend=-1) != 0]
        return logistic(marks(pair // max(len(names), 1), each[pair % max(len(names), 1)], len(offs) - 1, self.bias) @ self.curve)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def marks(row: np.ndarray, rating: np.ndarray, rows: int, bias: float) -> np.ndarray:
    """The TOP highest ratings of a row's different units, the bias where it has fewer, the logarithm of how many it has, and 1."""
    order = np.lexsort((-rating, row))
    row, rating = row[order], rating[order]
    n = np.bincount(row, minlength=rows)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    out = np.full((rows, TOP + 2), bias)
    out[row[at < TOP], at[at < TOP]] = rating[at < TOP]
    out[:, TOP], out[:, TOP + 1] = np.log1p(n), 1.0
    return out


class Ratings:
    """Ratings of units by hash, emptied when there are RATED."""

    def __init__(self) -> None:
        self.names, self.values = np.zeros(0, ragged.U64), np.zeros(0)

    def find(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rating, whether it is known) of each name."""
        if not len(self.names):
            return np.zeros(len(names)), np.zeros(len(names), bool)
        at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        old = self.names[at] == names
        return np.where(old, self.values[at], 0.0), old

    def add(self, names: np.ndarray, values: np.ndarray) -> None:
        if len(self.names) + len(names) > RATED:
            self.__init__()
        names, values = np.concatenate([self.names, names]), np.concatenate([self.values, values])
        order = np.argsort(names)
        self.names, self.values = names[order], values[order]


def norms(who: np.ndarray, codes: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """Square root of the kernel of every unit with itself."""
    if not len(who):
        return np.zeros(n)
    key = who * CLASSES**3 + codes
    order = np.argsort(key, kind="stable")
    begins = np.flatnonzero(np.diff(key[order], prepend=-1))
    sums = np.add.reduceat(weights[order], begins)
    return np.sqrt(np.bincount(who[order[begins]], weights=sums**2, minlength=n))


def of_words(words: list[bytes]) -> Units:
    """Units of single words, as they are."""
    raw = np.frombuffer(b"".join(words), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    return edged(_FOLD[raw], offs[:-1], offs[1:])


def landmarks_of(u: Units) -> Model:
    """A model that knows the landmarks and nothing else."""
    n = len(u.offs) - 1
    who, codes, weights = subsequences(u)
    norm = norms(who, codes, weights, n)
    key, place = np.unique(codes * n + who, return_inverse=True)
    value = np.bincount(place, weights=weights, minlength=len(key)) / np.maximum(norm[key % n], 1e-12)
    return Model(np.searchsorted(key // n, np.arange(CLASSES**3 + 1)), key % n, value, n)


def spelled(u: Units, draw: np.random.Generator) -> Units:
    """Units with a mark between all letters, or with a mark or a letter put in."""
    out = []
    for x in (u.letters[a:b] for a, b in zip(u.offs[:-1], u.offs[1:], strict=True)):
        at, put = int(draw.integers(2, max(len(x) - 1, 3))), int(draw.integers(0, 27))
        gaps = np.concatenate([x[:1], np.stack([x[1:-1], np.zeros_like(x[1:-1])], axis=1).ravel()[:-1], x[-1:]])
        out.append(gaps if draw.random() < 0.4 else np.insert(x, min(at, len(x) - 1), put if draw.random() < 0.5 else 0))
    return Units(np.concatenate(out) if out else np.zeros(0, np.int64), np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64))


def _machine(x: np.ndarray, up: np.ndarray, down: np.ndarray, penalty: float, steps: int = 30) -> np.ndarray:
    """Weights and bias (last) of least squared hinge loss, by Newton steps; every row counts `up` as toxic and `down` as clean."""
    z = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w, ridge = np.zeros(z.shape[1]), np.full(z.shape[1], penalty)
    ridge[-1] = 1e-8
    loss = lambda f, v: float(up @ np.maximum(0, 1 - f) ** 2 + down @ np.maximum(0, 1 + f) ** 2 + ridge @ v**2)
    now = loss(z @ w, w)
    for _ in range(steps):
        f = z @ w
        a, b = np.where(f < 1, up, 0.0), np.where(f > -1, down, 0.0)
        step = np.linalg.solve((z * (a + b)[:, None]).T @ z + np.diag(ridge), z.T @ (a * (1 - f) - b * (1 + f)) - ridge * w)
        size = 1.0
        while size > 1e-4 and loss(z @ (w + size * step), w + size * step) > now:
            size /= 2
        after = loss(z @ (w + size * step), w + size * step)
        if now - after < 1e-9 * max(now, 1e-9):
            break
        w, now = w + size * step, after
    return w


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic regression with a small ridge, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = logistic(x @ w)
        curve = weight * np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * curve[:, None]).T @ x + 1e-3 * np.eye(len(w)), x.T @ (weight * (y - p)) - 1e-3 * w)
        w = w + np.clip(step, -4, 4)
    return w


def train(docs: list[tuple[bytes, float]], landmarks: int = LANDMARKS, rounds: int = 5) -> Model:
    """Learn from (text, label) pairs; the result depends on their order, so callers sort them."""
    y = np.array([v for _, v in docs], float)
    share = float(y.mean()) if len(y) else 0.0
    if not len(y) or not 0 < y.sum() < len(y):
        return Model(share=share)
    draw = np.random.default_rng(13)
    data, offs = ragged.flat(pa.array([t for t, _ in docs], pa.binary()))
    found, names, number, sentence, rows = units(data, offs)
    n = len(found.offs) - 1
    pair = np.unique(rows[sentence] * n + number)
    doc, of = pair // n, pair % n
    # documents of the same least hash of a unit, as near copies mostly have, are evidence once
    group = np.full(len(docs), np.iinfo(np.uint64).max)
    np.minimum.at(group, doc, ragged.mix(names)[of])
    group = np.unique(group, return_inverse=True)[1] * 2 + (y > 0.5)
    toxic, clean = (np.bincount(np.unique(group[doc[m]] * n + of[m]) % n, minlength=n).astype(float) for m in (y[doc] > 0.5, y[doc] <= 0.5))
    part = float((np.unique(group) % 2).mean())
    # likelihood ratio of a unit being as common in both classes, by sign of the difference
    with_log = lambda k, of: np.where(k > 0, k * np.log(np.maximum(k, 1e-9) / np.maximum(of * (toxic + clean), 1e-9)), 0.0)
    sure = 2 * (with_log(toxic, part) + with_log(clean, 1 - part)) * np.sign(toxic - part * (toxic + clean))
    norm = np.concatenate([norms(*subsequences(found.take(p)), len(p)) for p in np.array_split(np.arange(n), n // AT_ONCE + 1)])
    usable = np.flatnonzero(norm > 0)
    ranked = usable[np.argsort(-sure[usable], kind="stable")]
    typical = ranked[: min(5 * landmarks // 12, max(int((sure[usable] >= SURE).sum()), 1))]
    near = landmarks_of(found.take(typical)).kernel(found).max(axis=1) * np.where(sure < 0, clean, 0.0)
    near = np.argsort(-near, kind="stable")[: min(5 * landmarks // 12, int((near > 0).sum()))]
    rest = np.setdiff1d(usable, np.concatenate([typical, near]))
    drawn = draw.choice(rest, min(landmarks - len(typical) - len(near), len(rest), landmarks // 6), replace=False)
    chosen = np.concatenate([typical, near, np.sort(drawn)])
    if not len(chosen):
        return Model(share=share)
    model = landmarks_of(found.take(chosen))
    values, vectors = np.linalg.eigh((lambda k: (k + k.T) / 2)(model.kernel(found.take(chosen))))
    good = values > 1e-6 * values.max()
    nystrom = vectors[:, good] / np.sqrt(values[good])
    base = model.kernel(found)
    positive = sure >= SURE
    w = np.zeros(nystrom.shape[1] + 1)
    for _ in range(rounds):
        # units of toxic documents that are not rated toxic say nothing sure
        again = np.concatenate([np.repeat(np.flatnonzero(positive), 6), draw.choice(np.flatnonzero(~positive), min(int((~positive).sum()), 4000), replace=False)])
        x = np.concatenate([base, model.kernel(spelled(found.take(again), draw))])
        up, down = np.where(positive, toxic, 0.0), np.where(positive, clean, clean + 0.5 * toxic)
        up, down = np.concatenate([up, up[again]]), np.concatenate([down, down[again]])
        # units like no landmark are all one point, which weighs little
        like = x.any(axis=1)
        alone = (up[~like].sum(), 0.01 * down[~like].sum())
        x, up, down = np.concatenate([x[like] @ nystrom, np.zeros((1, nystrom.shape[1]))]), np.append(up[like], alone[0]), np.append(down[like], alone[1])
        w = _machine(x, up / max(up.sum(), 1e-9), NEG * down / max(down.sum(), 1e-9), PEN)
        margin = base @ (nystrom @ w[:-1]) + w[-1]
        after = (sure > 0) & (margin > 0)
        if not after.any() or (after == positive).all():
            break
        positive = after
    model.weights, model.bias, model.share = nystrom @ w[:-1], float(w[-1]), share
    # the curve learns on documents and on single sentences, half and half
    each = np.clip(base @ model.weights + model.bias, -1, 1)
    whole = marks(doc, each[of], len(docs), model.bias)
    pair = np.unique(sentence * n + number)
    alone = marks(pair // n, each[pair % n], len(rows), model.bias)
    sure = (y[rows] <= 0.5) | (alone[:, 0] > 0)
    weight = np.concatenate([np.ones(len(docs)), np.full(int(sure.sum()), len(docs) / max(int(sure.sum()), 1))])
    model.curve = _curve(np.concatenate([whole, alone[sure]]), np.concatenate([y, y[rows][sure]]), weight)
    return model


def fit(docs: DataFrame, labels: DataFrame, learn: Column, target: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, landmarks: int = LANDMARKS) -> Model:
    """Learn from about `sample` labels of each class for which `learn`, over a column doc_id, holds; so few rows are broadcast."""
    marked = labels.select(F.col(id_col).alias("doc_id"), F.col(target).cast("double").alias("y")).filter(learn & F.col("y").isNotNull() & F.col("doc_id").isNotNull())
    found = {r["c"]: r["n"] for r in marked.groupBy((F.col("y") > 0.5).alias("c")).agg(F.count("*").alias("n")).collect()}
    chance = F.when(F.col("y") > 0.5, min(1.0, sample / max(found.get(True, 0), 1))).otherwise(min(1.0, sample / max(found.get(False, 0), 1)))
    drawn = marked.filter(unit(F.col("doc_id"), "toxicity") < chance)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(drawn), "doc_id")
    # whole sentences, of long documents a draw by hash
    said = F.filter(F.split("text", r"(?<=[.!?])\s+|[\n\r]+"), lambda s: F.trim(s) != "")
    few = F.slice(F.array_sort(F.transform(F.array_distinct(said), lambda s: F.struct(F.xxhash64(s).alias("h"), s.alias("s")))), 1, SENTENCES)
    got = rows.select("doc_id", "y", F.array_join(F.transform(few, lambda v: v["s"]), "\n").alias("text")).toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending"), ("text", "ascending")])
    return train([(t.encode(), float(v > 0.5)) for t, v in zip(got.column("text").to_pylist(), got.column("y").to_pylist(), strict=True)], landmarks)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Ratings()
        for b in batches:
            for a, z, data, offs in ragged.parts(b.column(1)):
                yield ragged.batch(schema, b.column(0)[a:z], model.score(data, offs, known))

    return rows.mapInArrow(apply, "doc_id long, score double").withColumnRenamed("doc_id", id_col)


def kernel_of(a: str, b: str) -> float:
    """The normalised kernel of two words by its definition, for tests."""
    from itertools import combinations

    def weights(word: str) -> dict[tuple, float]:
        x = [EDGE, *(int(_FOLD[c]) for c in word.encode()), EDGE]
        out: dict[tuple, float] = {}
        for i in combinations(range(len(x)), 3):
            if i[2] - i[0] < SPAN and all(x[j] for j in i):
                key = tuple(x[j] for j in i)
                out[key] = out.get(key, 0.0) + DECAY ** (i[2] - i[0] + 1)
        return out

    x, y = weights(a), weights(b)
    norm = (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5
    return sum(v * y.get(k, 0.0) for k, v in x.items()) / norm if norm else 0.0
