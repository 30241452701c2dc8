"""Language identification by error-correcting output codes.

Every language has a codeword; one binary classifier per bit, linear over hashed
byte trigrams of the case-folded text, predicts that bit for a text.  Loss-weighted
decoding sums the logistic loss of each codeword against the predicted margins
and takes the codeword of least loss; if the runner-up is nearly as good the text
is flagged ambiguous.

Training reads about `per_language` rows a language, and about `sample` rows of all languages together at most, so that its memory
(32 KB a row) does not grow with their number.  Both are expected numbers: each row is drawn by a fixed hash of its
id.  Rows are put in order before they are summed, so reruns agree.  Prediction reads whole texts.

Defined cases: a null text, or one without a letter, is `und` with score 0 and not
ambiguous; rows without a language are not learned from; ties of loss go to
the first language by code point; repeated rows each get their row; an empty
table gives an empty result; with no labelled rows every text is `und`.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ragged
from .sampling import unit

BUCKETS = 4096
PER_LANGUAGE, SAMPLE = 500, 4000
#: Loss gap under which two codewords count as equally near.
AMBIGUOUS_GAP = 0.35


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # language x bit, -1 or 1
    weights: np.ndarray  # bit x (BUCKETS + 1); the last bucket holds trigrams that say nothing
    bias: np.ndarray

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language index, score, ambiguous) of every row of margins."""
        loss = np.stack([np.logaddexp(0, -margins * row).sum(axis=1) for row in self.code], axis=1)
        best = loss.argmin(axis=1)
        share = np.exp(loss.min(axis=1, keepdims=True) - loss)
        score = 1 / share.sum(axis=1)
        ordered = np.sort(loss, axis=1)
        gap = ordered[:, 1] - ordered[:, 0] if loss.shape[1] > 1 else np.full(len(loss), np.inf)
        return best, score, gap < AMBIGUOUS_GAP


def codewords(n: int) -> np.ndarray:
    """n rows of -1 and 1: every split of the languages for up to five of them, else random balanced columns, far apart."""
    if n <= 5:
        bits = [[(c >> i) & 1 for i in range(n)] for c in range(1, 1 << max(n - 1, 1))]
        return np.array(bits, float).T * 2 - 1
    width, best, far = 4 * int(np.ceil(np.log2(n))) + 7, None, -1.0
    rng = np.random.default_rng(7)
    for _ in range(200):
        code = np.array([rng.permutation(np.resize([-1.0, 1.0], n)) for _ in range(width)]).T
        apart = ((width - code @ code.T) / 2)[~np.eye(n, dtype=bool)].min()
        if apart > far:
            best, far = code, apart
    return best


def folded(data: np.ndarray) -> np.ndarray:
    """Bytes with Latin letters in lower case and everything that is no letter byte as a space."""
    x = ragged.LOWER[data]
    if len(x) > 1:  # the upper-case half of U+00C0..U+00DE follows the byte C3
        upper = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        x[1:][upper] += 0x20
    return np.where((x >= 0x80) | ((x >= 97) & (x <= 122)), x, np.uint8(32))


def trigrams(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Bucket of the trigram at every byte; BUCKETS where it leaves its row or has no letter."""
    x = folded(data)
    out = np.full(len(x), BUCKETS, np.int32)
    if len(x) >= 3:
        a, b, c = (x[i : len(x) - 2 + i].astype(np.uint32) for i in range(3))
        h = (a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77)) ^ (c * np.uint32(0xC2B2AE3D))
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        out[:-2] = np.where((a != 32) | (b != 32) | (c != 32), h >> np.uint32(20), BUCKETS)
        for back in (1, 2):
            ends = offs[1:] - back
            out[ends[ends >= offs[:-1]]] = BUCKETS
    return out


def _letters(texts: pa.Array) -> np.ndarray:
    import regex

    letter = regex.compile(r"\p{L}").search
    return np.array([x is not None and letter(x) is not None for x in texts.to_pylist()], bool)


def fit(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = PER_LANGUAGE, sample: int = SAMPLE, steps: int = 150) -> Model:
    """Learn from the rows for which `learn` holds; the languages found are few, so their counts come to the driver."""
    rows = docs.filter(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    found = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(found, key=lambda x: [ord(c) for c in x])
    if not languages:
        return Model([], np.zeros((0, 0)), np.zeros((0, BUCKETS + 1)), np.zeros(0))
    per_language = min(per_language, sample / len(languages))
    chance = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, per_language / found[k]))])
    drawn = rows.filter(unit(F.col("doc_id"), "langid") < chance[F.col("lang")])
    schema = pa.schema([("lang", pa.string()), ("counts", pa.binary())])

    def counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, z, data, offs in ragged.parts(b.column(1)):
                grams = trigrams(data, offs)
                each = [np.bincount(grams[s:e], minlength=BUCKETS + 1)[:BUCKETS].astype(np.float32) for s, e in zip(offs[:-1], offs[1:], strict=True)]
                yield ragged.batch(schema, b.column(2)[a:z], [(x / max(x.sum(), 1)).astype(np.float16).tobytes() if x.sum() < 60000 else (x / x.sum()).astype(np.float16).tobytes() for x in each])

    got = drawn.mapInArrow(counts, "lang string, counts binary").toArrow().sort_by([("lang", "ascending"), ("counts", "ascending")])
    place = {v: i for i, v in enumerate(languages)}
    y = np.array([place[v] for v in got.column("lang").to_pylist()], int)
    x = np.empty((len(y), BUCKETS), np.float32)
    for i, v in enumerate(got.column("counts").to_pylist()):
        x[i] = np.frombuffer(v, np.float16)
    del got
    keep = x.any(axis=1)
    if not keep.all():
        x, y = x[keep], y[keep]
    code = codewords(len(languages))
    scale = 1 / np.sqrt(x.mean(axis=0) + 1e-6) if len(x) else np.ones(BUCKETS)
    x *= scale.astype(np.float32)
    target = code[y].astype(np.float32)
    weight = (1 / np.maximum(np.bincount(y, minlength=len(languages)), 1))[y].astype(np.float32)[:, None]
    weight = weight / max(float(weight.sum()), 1e-9)
    w, b = np.zeros((BUCKETS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    w_prev = w.copy()
    rate = 4 / max(float(np.einsum("ij,ij->i", x, x).max(initial=1e-6)), 1e-6) * 4
    for i in range(steps):
        look = w + (i / (i + 3)) * (w - w_prev)
        pull = -target / (1 + np.exp(np.clip(target * (x @ look + b), -30, 30))) * weight
        w_prev, w = w, look - rate * (x.T @ pull + 1e-5 * look)
        b = b - 0.5 * pull.sum(axis=0)
    table = np.zeros((code.shape[1], BUCKETS + 1))
    table[:, :BUCKETS] = (w * scale[:, None]).T
    return Model(languages, code, table, b.astype(float))


def predict(docs: DataFrame, model: Model, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `carry` columns with lang_pred, score, ambiguous and n_grams (letter trigrams read) of every row."""
    rows = docs.select(*carry, F.col(text_col).alias("__text"))
    kept = rows.schema[: len(carry)]
    schema_sql = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["lang_pred string, score double, ambiguous boolean, n_grams long"])

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(len(carry))
            n = len(texts)
            lang, prob, unsure, grams = np.full(n, "und", object), np.zeros(n), np.zeros(n, bool), np.zeros(n, np.int64)
            for a, z, data, offs in ragged.parts(texts) if model.languages else ():
                at = trigrams(data, offs)
                said = ragged.row_sums((at != BUCKETS).astype(np.int64), offs)
                full = np.flatnonzero(np.diff(offs) > 0)
                margins = np.zeros((z - a, len(model.bias)))
                for bit, table in enumerate(model.weights if len(full) else ()):
                    margins[full, bit] = np.add.reduceat(table[at], offs[:-1][full])
                margins = margins / np.maximum(said, 1)[:, None] + model.bias
                best, share, near = model.decode(margins)
                has = _letters(texts[a:z])
                lang[a:z] = np.where(has, np.array(model.languages, object)[best], "und")
                prob[a:z], unsure[a:z], grams[a:z] = np.where(has, share, 0.0), near & has, said
            names = [*b.schema.names[: len(carry)], "lang_pred", "score", "ambiguous", "n_grams"]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(carry)], pa.array(lang, pa.string()), pa.array(prob), pa.array(unsure), pa.array(grams)], names=names)

    return rows.mapInArrow(score, schema_sql)
