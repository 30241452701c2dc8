"""Many needles in many texts: exact substring search through an index of n-grams, with no text searched by every needle.

A text is cut into blocks of BLOCK characters; its n-grams at every STRIDE-th place are the index.  A needle that occurs at place p has an
n-gram at such a place whatever p is, so for each of the STRIDE remainders one n-gram of the needle, the one that is rarest in the index, is
enough to find all its occurrences.  What joins is verified block by block against the text itself.  Shorter needles use an index of
shorter n-grams at every place.  N-grams are compared by 64-bit hashes, which the verification makes exact.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize

BLOCK = 256
#: (least length of a needle, length of an n-gram, stride) of the indexes, longest first; a needle uses the first that it is long enough for.
INDEXES = ((19, 12, 8), (4, 4, 1), (3, 3, 1), (2, 2, 1), (1, 1, 1))
#: An n-gram that makes up more than one in SHARE of the index is hot: there are fewer than SHARE of those, and their rows are dealt over SALTS keys.
SHARE, SALTS = 1000, 32
#: Of a needle's n-grams those at its first places are looked up; any of the right remainder finds all its occurrences.
SEEDS = 4096


def _blocks(texts: DataFrame, ids: list[str], text: str) -> DataFrame:
    """(ids, key, block, chars): a row a block, cut in one pass over the text; chars reach on as far as an n-gram of the block may."""
    reach = max(q for _, q, _ in INDEXES) - 1
    cut = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{BLOCK + reach}}})).{{1,{BLOCK}}}"), F.lit(1))
    return texts.filter(F.length(text) > 0).select(*ids, F.xxhash64(text).alias("__key"), F.posexplode(cut).alias("__block", "__chars"))


def _grams(chars: Column, last: Column, q: int, stride: int) -> Column:
    """Places and hashes of n-grams of a block: at every stride-th place of its own, 0 to `last`."""
    places = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(stride))).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(places, lambda i: F.struct(i.alias("at"), F.xxhash64(F.substring(chars, i + 1, F.lit(q))).alias("gram")))


def _gram_at(needle: str, at: Column, q: int) -> Column:
    return F.xxhash64(F.substring(F.col(needle), at + 1, F.lit(q)))


def _seeds(needles: DataFrame, needle: str, q: int, stride: int) -> DataFrame:
    """The n-grams at the first SEEDS places of each needle, with the remainder of the place; every remainder is among them."""
    places = F.sequence(F.lit(0), F.least(F.length(needle) - q, F.lit(SEEDS - 1)))
    seeds = needles.select("*", F.explode(places).alias("__at"))
    return seeds.withColumns({"__rest": F.col("__at") % stride, "__gram": _gram_at(needle, F.col("__at"), q)})


def _candidates(blocks: DataFrame, needles: DataFrame, ids: list[str], scope: list[str], needle_id: str, needle: str, q: int, stride: int) -> DataFrame:
    """(scope, needle_id, needle, ids, key, start) of every place where the rarest n-gram of a remainder puts a needle."""
    last = F.least(F.lit(BLOCK - 1), F.length("__chars") - q)
    index = blocks.select(*ids, "__key", "__block", F.explode(_grams(F.col("__chars"), last, q, stride)).alias("__g"))
    index = index.select(*ids, "__key", (F.col("__block") * BLOCK + F.col("__g.at")).alias("__pos"), F.col("__g.gram").alias("__gram"))
    seeds = _seeds(needles, needle, q, stride)
    # how often the needles' n-grams occur: counted before the shuffle, only those of needles
    known = seeds.select(*scope, "__gram").distinct()
    counts = materialize(index.join(known, [*scope, "__gram"], "left_semi").groupBy(*scope, "__gram").agg(F.count("*").alias("__n")), "grams")
    total = counts.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("__all")).scalar()
    hot = counts.filter(F.col("__n") * SHARE > total).select(*scope, "__gram", F.lit(True).alias("__hot"))
    rated = seeds.join(counts, [*scope, "__gram"], "left")
    # an n-gram of a remainder that never occurs rules that remainder out
    # count and place in one number, so that the least is found by hash aggregation
    best = rated.groupBy(*scope, needle_id, needle, "__rest").agg(F.min(F.coalesce("__n", F.lit(0)) * SEEDS + F.col("__at")).alias("__b"))
    best = best.filter(F.col("__b") >= SEEDS).withColumn("__at", (F.col("__b") % SEEDS).cast("int"))
    best = best.select(*scope, needle_id, needle, "__at", _gram_at(needle, F.col("__at"), q).alias("__gram"))
    # hot n-grams, fewer than SHARE in all, are broadcast; their rows of the index are dealt over salts, those of needles repeated
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(*ids, "__pos"), F.lit(SALTS))).otherwise(0).cast("int")
    dealt = index.join(F.broadcast(hot), [*scope, "__gram"], "left").withColumn("__salt", salt).drop("__hot")
    salts = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    wanted = best.join(F.broadcast(hot), [*scope, "__gram"], "left").withColumn("__salt", F.explode(salts)).drop("__hot")
    met = dealt.join(wanted, [*scope, "__gram", "__salt"]).withColumn("__start", F.col("__pos") - F.col("__at"))
    return met.filter("__start >= 0").select(*dict.fromkeys([*scope, *ids]), "__key", needle_id, needle, "__start")


def occurrences(texts: DataFrame, needles: DataFrame, ids: list[str], text: str = "text", needle_id: str = "needle_id", needle: str = "needle", scope: tuple[str, ...] = ()) -> DataFrame:
    """(ids, needle_id, at): every place, by code points from 0, of every needle in every text; overlapping ones count.

    With `scope`, columns that both tables have and that are among `ids`, a needle is sought in the texts of its own scope only.  Null and empty
    needles and texts meet nothing, nor do rows with a null in `ids` or `needle_id`; repeated rows count once.  Other columns are ignored.
    """
    names = ["__scope", *ids] if not scope else list(ids)
    where = ["__scope"] if not scope else list(scope)
    texts = texts.select(*ids, text).withColumn("__scope", F.lit(0)).select(*names, F.col(text).alias("__text")).dropna(subset=list(ids))
    needles = needles.select(*scope, F.col(needle_id).alias("__id"), F.col(needle).alias("__needle")).withColumn("__scope", F.lit(0))
    needles = needles.select(*where, "__id", "__needle").filter("length(__needle) > 0").dropna().distinct()
    blocks = _blocks(texts, names, "__text")
    parts = []
    present = {r[0] for r in needles.select(_class(F.length("__needle"))).distinct().collect()}
    for i, (_, q, stride) in enumerate(INDEXES):
        if i in present:
            some = needles.filter(_class(F.length("__needle")) == i)
            parts.append(_candidates(blocks, some, names, where, "__id", "__needle", q, stride))
    if not parts:
        return texts.select(*ids, F.lit(None).cast(needles.schema["__id"].dataType).alias(needle_id), F.lit(None).cast("int").alias("at")).limit(0)
    found = reduce(DataFrame.unionByName, parts).distinct()
    # the piece of a needle that lies in each block must be what the block holds there
    first, end = F.floor(F.col("__start") / BLOCK).cast("int"), F.col("__start") + F.length("__needle")
    spans = F.transform(F.sequence(first, F.floor((end - 1) / BLOCK).cast("int")), lambda b: F.struct(b.alias("block"), F.greatest(F.col("__start"), b * BLOCK).alias("lo"), F.least(end, (b + 1) * BLOCK).alias("hi")))
    pieces = found.withColumn("__pieces", F.size(spans)).withColumn("__p", F.explode(spans))
    keys = [*names, "__key", "__id", "__start", "__pieces"]
    pieces = pieces.select(*keys, F.col("__p.block").alias("__block"), (F.col("__p.lo") % BLOCK).alias("__lo"), F.substring("__needle", F.col("__p.lo") - F.col("__start") + 1, F.col("__p.hi") - F.col("__p.lo")).alias("__piece"))
    same = pieces.join(blocks, [*names, "__key", "__block"]).filter(F.substring("__chars", F.col("__lo") + 1, F.length("__piece")) == F.col("__piece"))
    # needle texts of one id differ in pieces; the pieces of an occurrence are told apart by their blocks
    whole = same.groupBy(*keys).agg(F.countDistinct("__block").alias("__ok")).filter("__ok = __pieces")
    return whole.select(*ids, F.col("__id").alias(needle_id), F.col("__start").alias("at")).distinct()


def _class(length: Column) -> Column:
    """Which of INDEXES a needle of that length uses."""
    return reduce(lambda otherwise, i: F.when(length >= INDEXES[i][0], i).otherwise(otherwise), reversed(range(len(INDEXES))), F.lit(-1))


def first_from(found: DataFrame, keys: list[str], hint: Column) -> DataFrame:
    """(keys, at): of the occurrences of each needle in each text the first at or after a hint, else the first of all."""
    return found.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("at") >= hint, F.col("at"))), F.min("at")).alias("at"))


SHARES = (0.5, 0.2, 0.8)


def pieces(text: str, length: int = 50, least: int = 40) -> list[str]:
    """The snippets of one text, the first choice first."""
    starts = (text.find(" ", max(int((len(text) - length) * s // 1), 0)) + 1 for s in SHARES)
    return [piece for piece in (text[at : at + length] for at in starts) if len(piece) >= least]


def snippets(text: Column, length: int = 50, least: int = 40) -> Column:
    """Three pieces of a text, from its middle, a fifth and four fifths on, each from the start of a word; those shorter than `least` are left out."""

    def piece(share: float) -> Column:
        start = F.floor((F.length(text) - length) * F.lit(share)).cast("int")
        space = F.call_function("locate", F.lit(" "), text, F.greatest(start, F.lit(0)) + 1)
        return F.substring(text, space + 1, F.lit(length))

    tried = F.array(*[F.struct(F.lit(i).alias("rank"), piece(s).alias("snippet")) for i, s in enumerate(SHARES)])
    return F.filter(tried, lambda s: F.length(s["snippet"]) >= least)
