"""Reading plans: running positions, seeks, neighbours, folds of measured rates, lookahead and stalls."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chunk import chunk
from ..functions.text import speech_text
from .paragraphs import paragraph_list

#: Seconds a character takes before anything is measured.
SECONDS_PER_CHAR = 1 / 15
#: What a voice can say something of.
SAID = regex.compile(r"[\p{L}\p{N}]")
_SEGMENT = {"seg_idx long": pa.int64(), "para long": pa.int64(), "start int": pa.int32(), "`end` int": pa.int32(), "text string": pa.string(), "speech string": pa.string(), "pause_ms int": pa.int32(), "chars long": pa.int64(), "cum_chars long": pa.int64()}


def running_chars(rows: DataFrame, key: str, order: str, text_col: str = "text") -> DataFrame:
    """Adds chars, and cum_chars: the characters of the key's earlier rows."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("chars", F.length(text_col).cast("long")).withColumn("cum_chars", F.coalesce(F.sum("chars").over(before), F.lit(0)).cast("long"))


def running_in_row(rows: DataFrame, key: str, texts: str, index: str) -> DataFrame:
    """(key, index, chars, cum_chars) of the texts in each row's array; what is in one row is in order already, so nothing is shuffled."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            counts = np.array(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
            chars = np.array(pc.fill_null(pc.utf8_length(pc.list_flatten(lists)), 0), np.int64)
            first = np.cumsum(counts) - counts
            upto = np.concatenate([[0], np.cumsum(chars)])
            place = np.arange(len(chars)) - np.repeat(first, counts)
            owner = pa.array(np.repeat(np.arange(b.num_rows), counts))
            yield pa.RecordBatch.from_arrays([b.column(0).take(owner), pa.array(place), pa.array(chars), pa.array(upto[:-1] - np.repeat(upto[first], counts))], names=[key, index, "chars", "cum_chars"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, texts).mapInArrow(run, f"`{key}` {kind}, `{index}` long, chars long, cum_chars long")


def segments(rows: DataFrame, key: str, paragraphs: str = "paragraphs", start_paragraph: int | None = None, carry: tuple[str, ...] = (), outer: bool = False) -> DataFrame:
    """(key, carry, seg_idx, para, start, end, text, speech, pause_ms, chars, cum_chars) of rows that hold an array of structs (kind, text), or a plain text, whose paragraphs are cut here.

    The paragraph reading starts with gets a short first segment; segments that say nothing are left out.  With `outer` a row
    without a segment gives one of nulls.  Order and running sums come from the row itself: no shuffle.
    """
    kept = [rows.schema[c] for c in (key, *carry)]
    names = [f.name for f in kept] + [x.split()[0].strip("`") for x in _SEGMENT]
    plain = rows.schema[paragraphs].dataType.simpleString() == "string"

    def held(value: object) -> list[tuple[str, str]]:
        return [("text", t) for t in paragraph_list(value)] if plain else [(p["kind"], p["text"]) for p in value or ()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                owner, out = [], []
                for i, value in enumerate(part.column(len(kept)).to_pylist()):
                    n = before = 0
                    for para, (kind, text) in enumerate(held(value)):
                        for start, end, pause in chunk(text, kind, para == start_paragraph) if text else ():
                            shown = text[start:end]
                            said = speech_text(shown)
                            if SAID.search(said):
                                out.append((n, para, start, end, shown, said, pause, end - start, before))
                                owner.append(i)
                                n, before = n + 1, before + end - start
                    if outer and not n:
                        out.append((None,) * len(_SEGMENT))
                        owner.append(i)
                columns = list(zip(*out, strict=True)) or [()] * len(_SEGMENT)
                own = [c.take(pa.array(owner, pa.int64())) for c in part.columns[: len(kept)]]
                yield pa.RecordBatch.from_arrays(own + [pa.array(c, t) for c, t in zip(columns, _SEGMENT.values(), strict=True)], names=names)

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + list(_SEGMENT))
    return rows.select(key, *carry, paragraphs).mapInArrow(run, schema)


def seek(rows: DataFrame, key: str, fractions: list[float], index: str) -> DataFrame:
    """(key, p, index) of the last row whose cum_chars is at most p of the key's characters; an as-of lookup by aggregation, not a join."""
    total = F.sum("chars").over(Window.partitionBy(key))
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in fractions]))
    targets = rows.withColumn("total", total).select(key, index, "cum_chars", "total", wanted.alias("p"))
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("p")))
    return targets.filter(F.col("cum_chars") <= clamped * F.col("total")).groupBy(key, "p").agg(F.max_by(index, F.struct("cum_chars", index)).alias(index))


def seek_by_seconds(rows: DataFrame, key: str, index: str, elapsed: Column, deltas: list[float]) -> DataFrame:
    """(key, delta, index): where reading stands so many seconds from `elapsed`, a column over seconds, the whole time of the key; keys without time give no row."""
    totals = rows.groupBy(F.col(key).alias("__k")).agg(F.sum("chars").alias("total")).filter("total > 0").withColumn("seconds", F.col("total") * F.lit(SECONDS_PER_CHAR))
    wanted = totals.withColumn("delta", F.explode(F.array(*[F.lit(float(d)) for d in deltas]))).withColumn("p", (elapsed + F.col("delta")) / F.col("seconds"))
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("p")))
    met = rows.join(wanted, F.col(key) == F.col("__k")).filter(F.col("cum_chars") <= clamped * F.col("total"))
    return met.groupBy(key, "delta").agg(F.max_by(index, F.struct("cum_chars", index)).alias(index))


def back_target(para: Column, previous: Column, is_first: Column, seconds_in: Column) -> Column:
    """Where a step back leads: to the start of the paragraph, or, from its first 2.5 seconds, to the one before, if there is one."""
    return F.when(is_first & (seconds_in < 2.5), F.coalesce(previous, para)).otherwise(para)


def buffer_offset(now: Column, started: Column, duration: Column) -> Column:
    """Seconds into the sound that plays, never before its start or past its end."""
    return F.greatest(F.lit(0.0), F.least(now - started, duration))


def chars_done(cum_chars: Column, chars: Column, offset: Column, duration: Column) -> Column:
    """Characters spoken so far, a part of the segment that plays by the share of its sound."""
    share = F.when(duration > 0, F.least(F.lit(1.0), F.try_divide(offset, duration))).otherwise(0.0)
    return cum_chars + share * chars


def snapshot(done: Column, total: Column, rate: Column, status: Column, offset: Column, speech: Column) -> Column:
    """STRUCT<progress, elapsed, remaining, seg_progress>: remaining is unknown until the voice is there, and a segment's progress leaves its pause out."""
    progress = F.when(total > 0, F.least(F.lit(1.0), F.try_divide(done, total))).otherwise(0.0)
    remaining = F.when(~status.isin("loading", "starting"), F.greatest(F.lit(0.0), (total - done) * rate))
    seg = F.when(speech > 0, F.least(F.lit(1.0), F.try_divide(offset, speech))).otherwise(0.0)
    return F.struct(progress.alias("progress"), (done * rate).alias("elapsed"), remaining.alias("remaining"), seg.alias("seg_progress"))


def with_edges(samples: Column, pause_ms: Column, rate: int = 24_000, fade: int = 72) -> Column:
    """Sound with both edges faded linearly over `fade` samples, or half of it, and silence of a pause behind."""
    n = F.least(F.lit(fade), F.floor(F.size(samples) / 2).cast("int"))
    gain = lambda i: F.when(i < n, i.cast("double") / n).otherwise(F.lit(1.0))
    faded = F.transform(samples, lambda x, i: x.cast("double") * gain(i) * gain(F.size(samples) - 1 - i))
    silence = F.floor(pause_ms / 1000 * rate + F.lit(0.5).cast("double")).cast("int")
    return F.concat(faded, F.array_repeat(F.lit(0.0), silence))


def first_at_or_after(rows: DataFrame, key: str, para: str, index: str) -> DataFrame:
    """For each paragraph number of a key, the first row of it or a later one."""
    after = Window.partitionBy(key).orderBy(para).rangeBetween(0, Window.unboundedFollowing)
    return rows.withColumn("first_index", F.min(index).over(after))


def neighbours(rows: DataFrame, key: str, para: str) -> DataFrame:
    """Adds the next and the previous paragraph number."""
    w = Window.partitionBy(key).orderBy(para)
    return rows.withColumn("next_para", F.lead(para).over(w)).withColumn("prev_para", F.lag(para).over(w))


def carry_forward(rows: DataFrame, key: str, order: str, value: str) -> Column:
    """Last known value up to each row, 0 before any."""
    return F.coalesce(F.last(value, ignorenulls=True).over(Window.partitionBy(key).orderBy(order)), F.lit(0.0))


def moving_average(rows: DataFrame, key: str, order: str, value: str, keep: float, name: str) -> DataFrame:
    """(key, name): exponential average in order; the first value stands as it is, later ones weigh 1 - keep."""
    ordered = F.array_sort(F.collect_list(F.struct(order, value)))
    fold = F.aggregate(ordered, F.lit(None).cast("double"), lambda acc, x: F.when(acc.isNull(), x[value]).otherwise(acc * F.lit(keep) + x[value] * F.lit(1 - keep)))
    return rows.groupBy(key).agg(fold.alias(name))


def rate_after_speed(changes: DataFrame, key: str, order: str, speed: str, start: float = 1.0) -> DataFrame:
    """(key, rate): seconds a character after speed changes in order; speeds of 0 or less, or no change, are ignored."""
    ordered = F.array_sort(F.collect_list(F.struct(order, speed)))
    zero = F.struct(F.lit(start).alias("speed"), F.lit(SECONDS_PER_CHAR).alias("rate"))

    def step(acc: Column, x: Column) -> Column:
        used = (x[speed] > 0) & (x[speed] != acc["speed"])
        return F.when(used, F.struct(x[speed].alias("speed"), (acc["rate"] * acc["speed"] / x[speed]).alias("rate"))).otherwise(acc)

    return changes.groupBy(key).agg(F.aggregate(ordered, zero, step)["rate"].alias("rate"))


def lead_target(rtf: Column) -> Column:
    r = F.coalesce(rtf, F.lit(0.5))
    return F.when(r < 0.35, 12).when(r < 0.8, 24).otherwise(40)


def ready_lead(rows: DataFrame, key: str, order: str, ready: str, seconds: str) -> DataFrame:
    """(key, lead_sec): seconds of the rows before the first that is not ready."""
    upto = Window.partitionBy(key).orderBy(order)
    missing = F.sum(F.when(F.col(ready), 0).otherwise(1)).over(upto)
    return rows.withColumn("__m", missing).groupBy(key).agg(F.coalesce(F.sum(F.when(F.col("__m") == 0, F.col(seconds))), F.lit(0.0)).alias("lead_sec"))


def next_missing(rows: DataFrame, key: str, order: str, ready: str, seconds: str, target: Column, within: int = 8, at_least: int = 2) -> DataFrame:
    """(key, next): first row not ready among the next `within`, if fewer than `at_least` rows or less than the target seconds are ready ahead."""
    upto = Window.partitionBy(key).orderBy(order)
    place = F.row_number().over(upto) - 1
    marked = rows.withColumn("__p", place).withColumn("__m", F.sum(F.when(F.col(ready), 0).otherwise(1)).over(upto))
    agg = marked.groupBy(key).agg(F.min(F.when(~F.col(ready) & (F.col("__p") < within), F.col(order))).alias("next"), F.coalesce(F.sum(F.when(F.col("__m") == 0, F.col(seconds))), F.lit(0.0)).alias("lead"), F.sum(F.when(F.col("__m") == 0, 1).otherwise(0)).alias("ahead"))
    return agg.select(key, F.when((F.col("ahead") < at_least) | (F.col("lead") < target), F.col("next")).alias("next"))


def stalls(rows: DataFrame, key: str, order: str, status: str, at: str) -> DataFrame:
    """(key, underruns, buffering_sec, start_sec) from status changes: times it went to buffering, seconds spent there, and seconds to the first playing."""
    w = Window.partitionBy(key).orderBy(order)
    seen = rows.withColumn("__until", F.lead(at).over(w)).withColumn("__was", F.lag(status).over(w))
    seconds = lambda c: c.cast("double")
    buffering = F.col(status) == "buffering"
    went = F.sum(F.when(buffering & (F.col("__was") == "playing"), 1).otherwise(0))
    spent = F.sum(F.when(buffering & F.col("__until").isNotNull(), seconds(F.col("__until")) - seconds(F.col(at))).otherwise(0.0))
    first = F.min(F.when(F.col(status) == "playing", seconds(F.col(at)))) - F.min(seconds(F.col(at)))
    return seen.groupBy(key).agg(went.alias("underruns"), spent.alias("buffering_sec"), first.alias("start_sec"))


def clamp(c: Column, low: Column, high: Column) -> Column:
    """Null is the low end."""
    return F.least(F.greatest(c, low), high)


def ramp_split(rows: DataFrame, key: str, order: str, pieces: Column, text_col: str = "text") -> DataFrame:
    """Rows replaced by the pieces of an array column where it is not null; places and running positions follow."""
    whole = F.array(F.col(text_col))
    cut = rows.select(key, order, F.posexplode(F.coalesce(pieces, whole)).alias("__piece", text_col))
    placed = cut.withColumn("seg_idx", (F.row_number().over(Window.partitionBy(key).orderBy(order, "__piece")) - 1).cast("long"))
    return running_chars(placed, key, "seg_idx", text_col).select(key, "seg_idx", text_col, "chars", "cum_chars")
