"""Finding repeated windows of units (words or bytes) without looking at every pair, or shuffling every window.

Each window of ``window`` units is represented by its anchor, the gram of ``gram`` units with the smallest
hash in it. Equal windows have equal anchors at equal places, so only anchors that occur again matter,
and of those, anchors whose whole context (all windows that they stand for) occurs again need no
further look. What is left goes, window by window, to the caller.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcesift.llm import textwords as tw
from sourcesift.llm.storage import stored

_CONTEXT = tw.Powers(0xC2B2AE3D27D4EB4F)
#: Powers of the inverse base: they take a context's place in its chunk out of its hash.
_BACK = tw.Powers(pow(int(_CONTEXT.base), -1, 1 << 64))


@dataclass(frozen=True)
class Units:
    """How a text is read: as words or as bytes, in windows and grams of so many."""

    words: bool
    window: int
    gram: int

    @property
    def chunk(self) -> int:
        """Bytes read together; every byte is a unit of 8 bytes in several arrays."""
        return tw.CHUNK_BYTES if self.words else tw.CHUNK_BYTES >> 2

    def read(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of a chunk's units, and n+1 offsets of its rows in units."""
        if not self.words:
            return tw.BYTE_CODE[data], at
        s, e, words = tw.word_bounds(data, at, tw.table(tw.SPACES))
        return tw.word_hashes(data, s, e), words


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the key that texts go by: id (doc_id, 0 if null) and th, a hash of the text.

    Rows of equal text read alike, so they may share a key.
    """
    return docs.select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("th"), "text")


def find_anchors(units: np.ndarray, at: np.ndarray, kind: Units) -> tuple[np.ndarray, ...]:
    """Per anchor of a chunk: row, place, first and last window start (all within the row), key, context."""
    width, n = kind.window, len(units) - kind.window + 1
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    if n <= 0:
        return none
    grams = tw.gram_hashes(units, kind.gram)
    low = np.uint64((1 << len(grams).bit_length()) - 1)
    least, span, want = (grams & ~low) | np.arange(len(grams), dtype=np.uint64), 1, width - kind.gram + 1
    while span < want:  # sliding minimum by doubling; equal hashes fall to the leftmost
        step = min(span, want - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    rows = tw.row_of(at)
    start = np.flatnonzero(rows[:n] == rows[width - 1 :])
    if not len(start):
        return none
    place = (least[start] & low).astype(np.int64)
    new = np.append(True, (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    lo, hi, a = start[first], start[last], place[first]
    row = rows[lo]
    base = at[row]
    return row, a - base, lo - base, hi - base, grams[a], context_hashes(units, a, lo, hi, width)


def context_hashes(units: np.ndarray, a: np.ndarray, lo: np.ndarray, hi: np.ndarray, width: int) -> np.ndarray:
    """Hashes of contexts: their units and where in them the anchor is, wherever in whichever chunk they are."""
    with np.errstate(over="ignore"):
        sums = np.append(np.uint64(0), np.cumsum(units * _CONTEXT.upto(len(units)), dtype=np.uint64))
        context = (sums[hi + width] - sums[lo]) * _BACK.upto(len(units) + 1)[lo]
        return tw.splitmix(context + ((hi - lo).astype(np.uint64) << np.uint64(32)) + (a - lo).astype(np.uint64))


def candidate_windows(docs: DataFrame, kind: Units) -> tuple[DataFrame, DataFrame]:
    """(known, open): anchors whose windows are all repeated, and those whose windows must be compared.

    Both have id, th, lo, hi (window starts within the text); known also has ref_doc, a text with an
    equal context. open also has key, a (the anchor's place), weight (2 stands for any larger number of
    equal contexts, of which one is here) and others, the number of different contexts of its anchor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, at in tw.chunks(batch.column("text"), kind.chunk):
                row, a, lo, hi, key, context = find_anchors(*kind.read(data, at), kind)
                take = pa.array(row + first)
                longs = [pa.array(x.view(np.int64)) for x in (key, context)]
                ints = [pa.array(x.astype(np.int32)) for x in (a, lo, hi)]
                yield pa.record_batch([batch.column("id").take(take), batch.column("th").take(take), *longs, *ints], names=["id", "th", "key", "context", "a", "lo", "hi"])

    every = stored(docs.select("id", "th", "text").mapInArrow(run, "id long, th long, key long, context long, a int, lo int, hi int"))
    again = every.groupBy("key").agg(F.count("*").alias("times")).filter("times > 1").select("key")
    every = stored(every.join(again, "key").withColumn("weight", F.lit(1)), every)
    return judged(every, every)


def judged(every: DataFrame, *done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(known, open) of contexts (id, th, key, context, a, lo, hi, weight, and any others, which open keeps).

    A context of weight 2 is known already and stands for its equals. The stored tables ``done`` are removed.
    """
    more = [c for c in every.columns if c not in ("id", "th", "key", "context", "a", "lo", "hi", "weight")]
    contexts = every.groupBy("key", "context").agg(F.sum("weight").alias("n"), F.min(F.struct("id", "th", "lo")).alias("one"))
    contexts = stored(contexts)
    kinds = contexts.groupBy("key").agg(F.count("*").alias("others"))
    marked = every.join(contexts.join(kinds, "key"), ["key", "context"])
    mine = F.struct("id", "th", "lo").eqNullSafe(F.col("one"))
    marked = marked.select("id", "th", "key", "a", "lo", "hi", "weight", *more, "n", "others", mine.alias("mine"), F.col("one.id").alias("ref_doc"))
    marked = stored(marked, *done, contexts)
    known = marked.filter("n > 1 AND weight = 1").select("id", "th", "lo", "hi", "ref_doc")
    left = marked.filter("others > 1 AND (n = 1 OR mine)")
    return known, left.select("id", "th", "key", "a", "lo", "hi", F.least("n", F.lit(2)).cast("int").alias("weight"), "others", *more)


def with_texts(places: DataFrame, docs: DataFrame, fields: list[str]) -> DataFrame:
    """One row per text that has places: id, th, text and the places' fields as an array of structs ``at``."""
    grouped = places.groupBy("id", "th").agg(F.collect_list(F.struct(*fields)).alias("at"))
    return docs.select("id", "th", "text").join(grouped, ["id", "th"])


def window_rows(places: DataFrame, docs: DataFrame, kind: Units) -> DataFrame:
    """A row per window of the open places: two hashes of its units (w1, w2), id, th, p and weight."""
    rich = with_texts(places, docs, ["lo", "hi", "weight"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("at")
            flat, cuts = lists.flatten(), np.diff(lists.offsets.to_numpy())
            lo, hi, weight = (flat.field(f).to_numpy() for f in ("lo", "hi", "weight"))
            owner = np.repeat(np.arange(batch.num_rows), cuts)
            for first, end, data, at in tw.chunks(batch.column("text"), kind.chunk):
                units, offsets = kind.read(data, at)
                if len(units) < kind.window:
                    continue
                pick = np.flatnonzero((owner >= first) & (owner < end))
                sizes = hi[pick] - lo[pick] + 1
                place = np.repeat(lo[pick] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                row = np.repeat(owner[pick], sizes)
                w1 = tw.gram_hashes(units, kind.window)
                w2 = tw.gram_hashes(tw.splitmix(units), kind.window, base=0xA24BAED4963EE407)
                where = offsets[row - first] + place
                take = pa.array(row)
                yield pa.record_batch(
                    [pa.array(w1[where].view(np.int64)), pa.array(w2[where].view(np.int64)), batch.column("id").take(take), batch.column("th").take(take), pa.array(place.astype(np.int32)), pa.array(np.repeat(weight[pick], sizes))],
                    names=["w1", "w2", "id", "th", "p", "weight"],
                )

    return rich.mapInArrow(run, "w1 long, w2 long, id long, th long, p int, weight int")


def repeated_windows(windows: DataFrame) -> DataFrame:
    """(id, th, lo, hi, ref_doc) of the windows with equals; lo = hi is the window's start, ref_doc a text that has it."""
    index = windows.groupBy("w1", "w2").agg(F.sum("weight").alias("times"), F.min("id").alias("low"), F.max("id").alias("high")).filter("times > 1")
    found = windows.filter("weight = 1").join(index, ["w1", "w2"])
    ref = F.when(F.col("id") == F.col("low"), F.col("high")).otherwise(F.col("low"))
    return found.select("id", "th", F.col("p").alias("lo"), F.col("p").alias("hi"), ref.alias("ref_doc"))
