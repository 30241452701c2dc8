"""Scoring of extracted text against reference blocks by word pairs."""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import let, words
from ..storage import materialize, share

THIN = 2500
#: Pairs and words of references that every worker may hold; with more, blocks and references are joined.
HELD = 1_000_000
_MARKS = regex.compile(r"\p{M}+")
_TOKEN, _ASCII_TOKEN = regex.compile(r"[\p{L}\p{N}]+(?:'\p{L}+)?"), re.compile("[a-zA-Z0-9]+(?:'[a-zA-Z]+)?")
_QUOTES = str.maketrans("’‘`", "'''")


def fold(text: str) -> str:
    """Compatibility decomposition without combining marks, so that composed and decomposed letters are alike."""
    return text if text.isascii() else _MARKS.sub("", unicodedata.normalize("NFKD", text))


@F.pandas_udf(T.StringType())
def folded(text: pd.Series) -> pd.Series:
    return text.map(fold, na_action="ignore")


def token_list(lower: str) -> list[str]:
    """The same as tokens, of one text in lower case in Python."""
    plain = fold(lower).translate(_QUOTES)
    return (_ASCII_TOKEN if plain.isascii() else _TOKEN).findall(plain)


def tokens(text: Column) -> Column:
    """Lower-case words with inner apostrophes, accents aside."""
    plain = F.regexp_replace(folded(F.lower(text)), "[’‘`]", "'")
    return F.regexp_extract_all(plain, F.lit(r"[\p{L}\p{N}]+(?:'\p{L}+)?"), F.lit(0))


def tokenised(rows: DataFrame, *columns: str) -> DataFrame:
    """Columns of rows with n, the characters, and t, the words of their text; worked out once and written."""
    return materialize(rows.select(*columns, F.length("text").alias("n"), tokens(F.col("text")).alias("t")), "tokens")


def pairs(toks: Column) -> Column:
    def joined(t: Column) -> Column:
        n = F.greatest(F.size(t) - 1, F.lit(0))
        return F.zip_with(F.slice(t, F.lit(1), n), F.slice(t, F.lit(2), n), lambda x, y: F.concat_ws(" ", x, y))

    return let(toks, joined)


def found(blocks: DataFrame, others: DataFrame, page: str, block: str) -> DataFrame:
    """(page, block, f) of tokenised blocks: share of a block's word pairs that the page's other blocks have, repeated ones counted.

    Blocks of fewer than three words count as found if the words stand together in one of them; without words, always.
    """
    t = F.col("t")
    # a pair never equals a word, so one table of words and pairs serves both
    there = others.select(page, F.explode(F.array_union(t, pairs(t))).alias("g")).distinct().withColumn("hit", F.lit(1))
    return _share_found(blocks, there, page, block)


def _share_found(blocks: DataFrame, there: DataFrame, page: str, block: str) -> DataFrame:
    """(page, block, f) of blocks, by the pairs and words (page, g, hit) that are there."""
    t = F.col("t")
    wanted = F.when(F.size(t) >= 3, pairs(t)).when(F.size(t) >= 1, F.array(F.concat_ws(" ", t))).otherwise(F.expr("cast(array() as array<string>)"))
    grams = blocks.select(page, block, F.explode_outer(wanted).alias("g"))
    share = F.avg(F.when(F.col("g").isNull(), 1).otherwise(F.coalesce("hit", F.lit(0))))
    return grams.join(there, [page, "g"], "left").groupBy(page, block).agg(share.alias("f"))


def score(reference: DataFrame, extracted: DataFrame, page: str, block: str) -> DataFrame:
    """(page, recall, h_recall, htot, junk, out_chars, gt_chars, gt_blocks) of tokenised blocks (page, block, kind, n, t) against extracted ones (page, block, n, t)."""
    back = extracted.select(page, block, "n").join(found(extracted, reference, page, block), [page, block])
    theirs = back.groupBy(page).agg(F.sum(F.when(F.col("f") < 0.5, F.col("n")).otherwise(0)).cast("long").alias("junk"), F.sum("n").cast("long").alias("out_chars"))
    return _figures(reference, found(reference, extracted, page, block), theirs, page, block)


def _figures(reference: DataFrame, shares: DataFrame, theirs: DataFrame, page: str, block: str) -> DataFrame:
    """What score returns, by the shares of the reference's blocks and the sums of the extracted ones."""
    own = reference.select(page, block, "kind", "n").join(shares.withColumnRenamed("f", "share"), [page, block])
    heading = F.col("kind") == "heading"
    ours = own.groupBy(page).agg(
        (F.sum(F.col("n") * F.col("share")) / F.sum("n")).alias("recall"), (F.sum(F.when(heading & (F.col("share") >= 0.9), 1).otherwise(0)) / F.sum(F.when(heading, 1))).alias("h_recall"),
        F.sum(heading.cast("long")).alias("htot"), F.sum("n").cast("long").alias("gt_chars"), F.count("*").alias("gt_blocks"),
    )
    return ours.join(theirs, page, "left").withColumns({"junk": F.coalesce("junk", F.lit(0)), "out_chars": F.coalesce("out_chars", F.lit(0))})


class _Held:
    """What a page's reference holds: its word pairs, its words, and the words that blocks of one word look for."""

    def __init__(self) -> None:
        self.pairs: set[tuple[str, ...]] = set()
        self.words: set[str] = set()
        self.singles: set[str] = set()


def _held(grams: DataFrame, page: str) -> dict[object, _Held]:
    """By page; pages with the same reference share one."""
    alike = grams.groupBy("g", "single").agg(F.sort_array(F.collect_set(page)).alias("pages")).groupBy("pages").agg(F.collect_list(F.struct("g", "single")).alias("grams")).collect()
    parts = defaultdict(list)
    for i, (pages, _) in enumerate(alike):
        for p in pages:
            parts[p].append(i)
    made: dict[tuple[int, ...], _Held] = {}
    for own in parts.values():
        if tuple(own) in made:
            continue
        held = made[tuple(own)] = _Held()
        for i in own:
            for g, single in alike[i][1]:
                if " " in g:
                    held.pairs.add(tuple(g.split(" ")))
                else:
                    held.words.add(g)
                    held.singles.update([g] if single else [])
    return {p: made[tuple(own)] for p, own in parts.items()}


def score_texts(reference: DataFrame, texts: DataFrame, page: str, block: str) -> DataFrame:
    """The figures of score for extracted texts (page, block, text) not tokenised yet.

    A reference of up to HELD pairs and words is held by every worker: a text is tokenised and counted where it lies, and what leaves is
    sums of each page and the reference's pairs that were met.  Larger references are joined, as in score.
    """
    t = F.col("t")
    grams = reference.dropna(subset=[page]).select(page, F.explode(F.array_union(t, pairs(t))).alias("g"), (F.size(t) == 1).alias("single")).groupBy(page, "g").agg(F.bool_or("single").alias("single"))
    rows, pages, distinct = grams.agg(F.count("*"), F.countDistinct(page), F.countDistinct("g")).first()
    # pages that all have the same reference share it
    if (pages + distinct if rows == pages * distinct else rows) > HELD:
        return score(reference, tokenised(texts, page, block), page, block)
    shared = share(texts.sparkSession, _held(grams, page))
    lowered = texts.select(page, F.length("text").alias("n"), F.lower("text").alias("lower")).dropna(subset=[page])
    names = [page, "junk", "out_chars", "met"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, told = shared.value, defaultdict(set)
        for b in batches:
            junk, chars, met = defaultdict(int), defaultdict(int), defaultdict(set)
            for p, n, lower in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ref = held.get(p)
                if ref is None or lower is None:
                    continue
                toks = token_list(lower)
                hits = [x for x in zip(toks, toks[1:]) if x in ref.pairs]
                there = len(hits) if len(toks) != 1 else int(toks[0] in ref.words)
                junk[p] += n if 2 * there < (len(toks) - 1 or len(toks)) else 0
                chars[p] += n
                met[p].update(" ".join(x) for x in hits)
                met[p].update(ref.singles.intersection(toks) if ref.singles else ())
            out = []
            for p in chars:
                out.append((p, junk[p], chars[p], list(met[p] - told[p])))
                told[p] |= met[p]
            columns = list(zip(*out, strict=True)) or [()] * 4
            types = (b.schema.field(0).type, pa.int64(), pa.int64(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, types, strict=True)], names=names)

    counted = materialize(lowered.mapInArrow(run, f"`{page}` {lowered.schema[page].dataType.simpleString()}, junk long, out_chars long, met array<string>"), "counted")
    there = counted.select(page, F.explode("met").alias("g")).distinct().withColumn("hit", F.lit(1))
    theirs = counted.groupBy(page).agg(F.sum("junk").alias("junk"), F.sum("out_chars").alias("out_chars"))
    return _figures(reference, _share_found(reference, there, page, block), theirs, page, block)


def aggregate(scores: DataFrame, extractor: str) -> DataFrame:
    """Per extractor, over pages of enough reference text: counts, mean and pooled recall, mean heading recall, junk, and pages under nine tenths."""
    used = scores.filter((F.col("gt_chars") >= THIN) & F.col("recall").isNotNull())
    return used.groupBy(extractor).agg(
        F.count("*").alias("pages"), F.avg("recall").alias("mean_recall"), (F.sum(F.col("recall") * F.col("gt_chars")) / F.sum("gt_chars")).alias("pooled_recall"),
        F.avg(F.when(F.col("htot") > 0, F.col("h_recall"))).alias("mean_h_recall"), F.sum("junk").alias("junk"), F.sum((F.col("recall") < 0.9).cast("long")).alias("below_90"),
    )


def percent(c: Column) -> Column:
    return F.when(c.isNull(), " n/a").otherwise(F.concat(F.floor(c * 100 + F.lit(0.5).cast("double")).cast("string"), F.lit("%")))


def uncovered(classic: DataFrame, live: DataFrame, key: str, k: int = 4, enough: float = 0.9, least: int = 80) -> DataFrame:
    """Paragraphs (key, text) of at least `least` characters of whose k-word shingles fewer than `enough` occur in `live`."""
    def shingles(text: Column) -> Column:
        several = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - k + 1, F.lit(1))), lambda i: F.concat_ws(" ", F.slice(w, i, k)))
        return let(words(text), lambda w: F.when(F.size(w) < k, F.array(F.concat_ws(" ", w))).otherwise(several(w)))

    mine = classic.filter(F.length("text") >= least).select(key, F.length("text").alias("n"), F.explode(shingles(F.col("text"))).alias("g"))
    theirs = live.select(F.explode(shingles(F.col("text"))).alias("g")).distinct().withColumn("hit", F.lit(1))
    share = mine.join(theirs, "g", "left").groupBy(key, "n").agg(F.sum(F.coalesce("hit", F.lit(0))).alias("hits"), F.count("*").alias("total"))
    return share.filter(F.col("hits") < F.col("total") * F.lit(enough)).select(key, F.col("n").cast("long").alias("chars"))


def report_line(page: Column, blocks: Column, chars: Column, recall: Column, h_recall: Column, junk: Column) -> Column:
    """A row of the report's table; pages of too little reference text are marked."""
    weak = F.when(chars < THIN, " (GT weak, excluded from aggregate)").otherwise("")
    cell = F.concat_ws(" / ", percent(recall), percent(h_recall), junk.cast("string"))
    return F.concat(F.lit("| "), page, weak, F.lit(" | "), blocks.cast("string"), F.lit(" / "), chars.cast("string"), F.lit(" | "), cell, F.lit(" |"))


def accepted(live_chars: Column, classic_chars: Column, missing_chars: Column) -> Column:
    """Whether a walk of the live page stands against another extractor's text: long enough, and little of the other's missing."""
    return (live_chars >= classic_chars * F.lit(0.7).cast("double")) & (missing_chars <= classic_chars * F.lit(0.1).cast("double"))
