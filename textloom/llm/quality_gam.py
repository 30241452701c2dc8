"""Quality classifier: a generalised additive model with pairwise interactions.

Surface features of a text are cut into quantile bins.  Boosting goes round the
features in a fixed cycle; each turn fits a tree of a few leaves on one feature's
bins to the logistic gradient and adds a small share of it to that feature's
lookup table.  Then the pairs of features whose coarse grid explains most of
what is left get two-dimensional tables, boosted the same way.  A score is a bias
plus one table entry a feature and one a pair.

Training reads about `sample` labelled rows (an expected number; rows are drawn by a
fixed hash of their id).  Scoring reads whole texts.

Defined cases: a null text scores as an empty one; rows of a null label are not
learned from; a doc_id labelled more than once counts once for each label; with no
labelled rows every score is 0.5; repeated rows each get their row; an empty
table gives an empty result.
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

SAMPLE = 16_000
BINS, GRID, PAIRS = 32, 8, 8
FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "exclaim", "symbol", "bar", "stop_mark", "comma", "high", "space",
    "line_words", "short_words", "long_words", "distinct_words", "top_word", "distinct_pairs", "distinct_lines", "upper_words", "url_marks",
)


def _mask(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in chars]] = True
    return table


_CLASSES = {
    "upper": _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "digit": _mask("0123456789"), "exclaim": _mask("!?"), "symbol": _mask("*#$%&@^~<>{}[]\\=+_"), "bar": _mask("|"),
    "stop_mark": _mask(".;:"), "comma": _mask(","), "high": np.arange(256) >= 128, "space": _mask(" \t\r\n\v\f"), "url_marks": _mask("/@"),
}
_NEWLINE = ragged.byte_class("\n\n")


def _distinct(values: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, most frequent value's count) of each row."""
    if not len(values):
        return np.zeros(rows), np.zeros(rows)
    order = np.lexsort((values, row))
    v, r = values[order], row[order]
    begins = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (r[1:] != r[:-1])]))
    top = np.zeros(rows)
    np.maximum.at(top, r[begins], np.diff(np.append(begins, len(v))))
    return np.bincount(r[begins], minlength=rows).astype(float), top


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """rows x FEATURES."""
    rows, size = len(offs) - 1, np.diff(offs)
    per_byte = np.maximum(size, 1)
    starts, ends, first = ragged.spans(data, offs, ragged.SPACED)
    n = np.diff(first)
    per_word, length = np.maximum(n, 1), ends - starts
    row = np.repeat(np.arange(rows), n)
    hashes = ragged.span_hashes(data, starts, ends)
    distinct, top = _distinct(hashes, row, rows)
    pairs, pair_row = ragged.shingles(hashes, first, 2)
    line_starts, line_ends, line_first = ragged.spans(data, offs, _NEWLINE)
    lines = np.diff(line_first)
    distinct_lines, _ = _distinct(ragged.span_hashes(data, line_starts, line_ends), np.repeat(np.arange(rows), lines), rows)
    share = {k: ragged.row_sums(t[data].astype(np.int64), offs) / per_byte for k, t in _CLASSES.items()}
    upper = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_CLASSES["upper"][data], out=upper[1:])
    shouted = (upper[ends] - upper[starts]) * 2 > length
    by_word = lambda x: ragged.row_sums(x.astype(np.int64), first) / per_word
    return np.stack([
        np.log1p(size), np.log1p(n), by_word(length), share["upper"], share["digit"], share["exclaim"], share["symbol"], share["bar"], share["stop_mark"], share["comma"], share["high"], share["space"],
        n / np.maximum(lines, 1), by_word(length <= 3), by_word(length >= 14), distinct / per_word, top / per_word, _distinct(pairs, pair_row, rows)[0] / per_word, distinct_lines / np.maximum(lines, 1), by_word(shouted), share["url_marks"],
    ], axis=1)


@dataclass
class Model:
    bias: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)  # of each feature
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)  # GRID x GRID of each pair
    coarse: list[np.ndarray] = field(default_factory=list)  # bin -> grid cell, of each feature

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)], axis=1) if self.edges else np.zeros((len(x), 0), int)

    def logit(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.bias)
        for f, t in enumerate(self.tables):
            out += t[bins[:, f]]
        for (f, g), t in zip(self.pairs, self.grids, strict=True):
            out += t[self.coarse[f][bins[:, f]], self.coarse[g][bins[:, g]]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(self.bins(x)), -30, 30)))


def _leaves(g: np.ndarray, h: np.ndarray, leaves: int, l2: float = 2.0) -> np.ndarray:
    """Values of a tree of at most so many leaves over ordered bins with gradient sums g and curvature sums h."""
    cg, ch = np.concatenate([[0], g.cumsum()]), np.concatenate([[0], h.cumsum()])
    gain = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + l2)
    cuts = [0, len(g)]
    while len(cuts) <= leaves:
        best, where = 1e-9, None
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            m = np.arange(a + 1, b)
            if len(m):
                won = gain(a, m) + gain(m, b) - gain(a, b)
                if won.max() > best:
                    best, where = won.max(), m[won.argmax()]
        if where is None:
            break
        cuts = sorted([*cuts, where])
    out = np.zeros(len(g))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + l2)
    return out


def _grid_tree(g: np.ndarray, h: np.ndarray, l2: float = 2.0) -> np.ndarray:
    """Two levels over a grid: the best cut of one axis, then each half's best cut of the other."""
    best, out = -1.0, np.zeros_like(g)
    for flip in (False, True):
        gg, hh = (g.T, h.T) if flip else (g, h)
        for cut in range(1, len(gg)):
            value, won = np.zeros_like(gg), 0.0
            for part in (slice(0, cut), slice(cut, None)):
                sums, curve = gg[part].sum(axis=0), hh[part].sum(axis=0)
                leaf = _leaves(sums, curve, 2, l2)
                value[part] = leaf
                won += float((leaf * sums).sum())
            if won > best:
                best, out = won, value.T if flip else value
    return out


def train(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.15, pair_rounds: int = 30) -> Model:
    model = Model()
    if not len(y):
        return model
    rate0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model.bias = float(np.log(rate0 / (1 - rate0)))
    model.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = model.bins(x)
    logit = np.full(len(y), model.bias)
    for i in range(rounds):
        for f, table in enumerate(model.tables):
            p = 1 / (1 + np.exp(-logit))
            g, h = (np.bincount(bins[:, f], weights=v, minlength=len(table)) for v in (y - p, p * (1 - p)))
            step = rate * _leaves(g, h, 3)
            table += step
            logit += step[bins[:, f]]
    model.coarse = [np.arange(len(t)) * GRID // len(t) for t in model.tables]
    cells = np.stack([c[bins[:, f]] for f, c in enumerate(model.coarse)], axis=1)
    grid = lambda f, g, v: np.bincount(cells[:, f] * GRID + cells[:, g], weights=v, minlength=GRID * GRID).reshape(GRID, GRID)
    p = 1 / (1 + np.exp(-logit))
    left, curve = y - p, p * (1 - p)
    gains = {(f, g): float((grid(f, g, left) * (t := _grid_tree(grid(f, g, left), grid(f, g, curve)))).sum()) for f in range(x.shape[1]) for g in range(f)}
    model.pairs = sorted(gains, key=lambda k: (-gains[k], k))[:PAIRS]
    model.grids = [np.zeros((GRID, GRID)) for _ in model.pairs]
    for i in range(pair_rounds):
        for (f, g), table in zip(model.pairs, model.grids, strict=True):
            p = 1 / (1 + np.exp(-logit))
            step = rate * _grid_tree(grid(f, g, y - p), grid(f, g, p * (1 - p)))
            table += step
            logit += step[cells[:, f], cells[:, g]]
    return model


def fit(docs: DataFrame, labels: DataFrame, learn: Column, target: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Learn from about `sample` of the labels for which `learn`, over a column doc_id, holds; so few rows are broadcast."""
    marked = labels.select(F.col(id_col).alias("doc_id"), F.col(target).cast("double").alias("__y")).filter(learn & F.col("__y").isNotNull())
    n = marked.count()
    drawn = marked.filter(unit(F.col("doc_id"), "quality") < min(1.0, sample / max(n, 1)))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "__y")
    schema = pa.schema([("id", pa.int64()), ("y", pa.float64()), ("x", pa.binary())])

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, z, data, offs in ragged.parts(b.column(1)):
                yield ragged.batch(schema, b.column(0)[a:z], b.column(2)[a:z], [v.tobytes() for v in features(data, offs)])

    got = rows.mapInArrow(measure, "id long, y double, x binary").toArrow().sort_by([("id", "ascending"), ("y", "ascending"), ("x", "ascending")])
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), float).reshape(-1, len(FEATURES))
    return train(x, (np.array(got.column("y"), float) > 0.5).astype(float))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, z, data, offs in ragged.parts(b.column(1)):
                yield ragged.batch(schema, b.column(0)[a:z], model.score(features(data, offs)) if model.tables else np.full(z - a, 0.5))

    return rows.mapInArrow(apply, "doc_id long, score double").withColumnRenamed("doc_id", id_col)
