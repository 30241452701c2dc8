"""Token counts by rank-synchronous array merging.

Texts are split into pre-tokens; the distinct pre-tokens of a slice that no
earlier slice of the task has met are held together as one ragged symbol array.
Every round finds each sequence's lowest-rank adjacent pair and merges all its
occurrences in all sequences at once, until no sequence has a pair left; the
surviving symbols of a sequence are its tokens.

Defined cases: a null or empty text has 0 bytes and 0 tokens; a special string
of the vocabulary file inside a text counts as one token, as the library
has it by default; repeated rows each get their row; an empty table gives an
empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ragged

#: Distinct pre-tokens whose counts a task keeps between slices.
KEPT = 300_000
NONE = np.int32(2**31 - 1)


class Merges:
    """Merge table of a byte-level BPE file: pair of symbols -> (rank, merged symbol)."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        pre = spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space"):
            raise ValueError(f"{path}: only byte-level BPE without a prefix space is supported")
        from public_tokenizers import PATTERN

        self.split = regex.compile(PATTERN).findall
        special = [t["content"] for t in spec.get("added_tokens", []) if t.get("special")]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.symbols = np.array([vocab[c] for c in byte_letters()], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.base = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def count(self, words: list[bytes]) -> np.ndarray:
        """Surviving symbols of each non-empty byte string."""
        lengths = np.array([len(w) for w in words], np.int64)
        out = np.ones(len(words), np.int64)
        symbols = self.symbols[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        rank = self._ranks(symbols, owner)
        while len(symbols):
            begins = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            lowest = np.minimum.reduceat(rank, begins)
            sizes = np.diff(np.append(begins, len(owner)))
            done = lowest == NONE
            if done.any():
                out[owner[begins[done]]] = sizes[done]
                keep = np.repeat(~done, sizes)
                symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
                sizes, lowest = sizes[~done], lowest[~done]
                if not len(symbols):
                    break
            hit = rank == np.repeat(lowest, sizes)
            at = np.flatnonzero(hit)
            # in a run such as a a a the pairs overlap: take every other one, from the left
            new_run = np.concatenate([[True], np.diff(at) != 1])
            run = np.cumsum(new_run) - 1
            at = at[(at - at[new_run][run]) % 2 == 0]
            symbols[at] = self.merged[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            moved = at - np.arange(len(at))  # places of the merged symbols once the others are gone
            symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
            for i in (moved, moved[moved > 0] - 1):
                inside = i + 1 < len(symbols)
                j = i[inside]
                same = owner[j] == owner[j + 1]
                rank[i] = NONE
                rank[j[same]] = self.rank(symbols[j[same]], symbols[j[same] + 1])
        return out

    def _ranks(self, symbols: np.ndarray, owner: np.ndarray) -> np.ndarray:
        rank = np.full(len(symbols), NONE, np.int32)
        if len(symbols) > 1:
            same = owner[1:] == owner[:-1]
            rank[:-1][same] = self.rank(symbols[:-1][same], symbols[1:][same])
        return rank


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable in Latin-1, else the next code point from 256."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(hidden)) for b in range(256)]


@lru_cache(maxsize=4)
def merges(path: str) -> Merges:
    return Merges(path)


class Counter:
    """Counts texts, remembering the counts of at most KEPT pre-tokens between slices."""

    def __init__(self, table: Merges):
        self.table = table
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[str, int] = defaultdict()
        self.ids.default_factory = self.ids.__len__
        self.counts = np.zeros(0, np.int64)

    def __call__(self, texts: list[str]) -> np.ndarray:
        if len(self.ids) > KEPT:
            self._reset()
        known, rows, found, extra = len(self.ids), [0], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if self.table.special and self.table.special.search(text):
                pieces = self.table.special.split(text)
                extra[i] = len(pieces) - 1
                for piece in pieces:
                    found.extend(map(self.ids.__getitem__, self.table.split(piece)))
            else:
                found.extend(map(self.ids.__getitem__, self.table.split(text)))
            rows.append(len(found))
        if len(self.ids) > known:
            fresh = [w.encode() for w in list(self.ids)[known:]]
            self.counts = np.concatenate([self.counts, self.table.count(fresh)])
        return ragged.row_sums(self.counts[np.array(found, np.int64)], np.array(rows)) + extra


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_tokens) of every row; `tokenizer`: path of a byte-level BPE .json, present on every executor."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(merges(tokenizer))
        for b in batches:
            _, offs = ragged.flat(b.column(1))
            texts = b.column(1)
            n = [counter([x or "" for x in texts[a:z].to_pylist()]) for a, z in ragged.slices(offs, 1 << 21)]
            yield ragged.batch(schema, b.column(0), np.diff(offs), np.concatenate([*n, np.zeros(0, np.int64)]))

    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumnRenamed("doc_id", id_col)
