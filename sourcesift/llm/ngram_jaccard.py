"""N-gram Jaccard join by blocked sparse products of the document by n-gram incidence matrix.

Two sets of n and m grams reach a Jaccard similarity of t only with an overlap of t (n + m) / (1 + t).
In a global order of the grams, such sets share a gram among the first n - ceil(t n) + 1 of each, so the
product runs over those columns only. It is computed in blocks of grams: a task holds the incidence
rows of its grams and adds up overlaps of the pairs in them. Pairs below the bounds that follow from the
sizes fall away; the rest is verified on whole sets.

The order puts rare grams first: the most frequent ones, counted over all documents, come last. It
decides how much work is done, never which pairs are found. Equal sets are one row of the matrix.

Each row also has an odd sketch: ``BITS`` bits, each the parity of how many grams of the set fall on it. Two
sketches differ in no more bits than the sets differ in grams, so a pair whose sketches differ in more than the
similarity allows is left out before it becomes a row, and none that reaches it is lost. In large groups of near
copies, rounds in which every set tries its nearest neighbour of another component make the group one component;
the full product then only takes pairs from different components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcesift.llm import textwords as tw
from sourcesift.llm.storage import connected_components, row_key, stored

#: How many of the most frequent grams are put last; they are broadcast (16 bytes each).
LAST = 1 << 16
#: A batch reports the grams that it has in at least so many documents.
LOCAL = 4
#: Products over neighbours before the full one, and how many rows a row is compared with in each column.
ROUNDS, BESIDE = 2, 16
#: Bits of a sketch. It decides how many pairs are verified, never which are found.
BITS = 512
#: Columns of at most so many rows are multiplied all at once, longer ones row by row.
SHORT = 32
HOT = np.uint64(1 << 62)


def gram_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per chunk of rows: first row, end row, hashes of distinct grams sorted within rows, and row offsets.

    A text of fewer than ``k`` words, but some, has one gram, the whole sequence.
    """
    mask = tw.table(tw.SPACES)
    for row, end, data, at in tw.chunks(texts):
        s, e, words = tw.word_bounds(data, at, mask)
        units, owner = tw.word_hashes(data, s, e, tw.LOWER), tw.row_of(words)
        grams, rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(units) >= k:
            whole = owner[: len(units) - k + 1] == owner[k - 1 :]
            grams, rows = tw.gram_hashes(units, k)[whole], owner[: len(units) - k + 1][whole]
        short = np.flatnonzero((np.diff(words) > 0) & (np.diff(words) < k))
        if len(short):
            ones = [tw.gram_hashes(units[words[r] : words[r + 1]], int(words[r + 1] - words[r]), base=0xA0761D6478BD642F)[0] for r in short]
            grams, rows = np.append(grams, np.array(ones, np.uint64)), np.append(rows, short)
        order = np.lexsort((grams, rows))
        grams, rows = grams[order], rows[order]
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (rows[1:] != rows[:-1])
        grams, rows = grams[new], rows[new]
        yield row, end, grams, np.searchsorted(rows, np.arange(end - row + 1))


def _frequent(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent grams, sorted by hash, and their ranks, from counts over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [g for _, _, g, _ in gram_sets(batch.column(0), k)]
            grams, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
            often = n >= LOCAL
            yield pa.record_batch([pa.array(grams[often].view(np.int64)), pa.array(n[often])], names=["gram", "n"])

    counts = docs.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "gram").limit(LAST).toPandas()  # at most LAST rows
    grams = top["gram"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(grams)
    return grams[order], (len(grams) - np.arange(len(grams), dtype=np.uint64))[order]


def _order_keys(grams: np.ndarray, last: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    key = grams >> np.uint64(2)
    if len(last):
        at = np.minimum(np.searchsorted(last, grams), len(last) - 1)
        hot = last[at] == grams
        key[hot] = HOT + ranks[at[hot]]
    return key


def odd_sketches(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The odd sketch of each row's grams as a row of bytes."""
    out, bits = np.zeros((len(at) - 1, BITS // 8), np.uint8), (tw.splitmix(grams ^ np.uint64(3)) & np.uint64(BITS - 1)).astype(np.int64)
    for i in range(0, len(out), 1 << 11):
        ends = at[i : i + (1 << 11) + 1]
        place = bits[ends[0] : ends[-1]] + tw.row_of(ends - ends[0]) * BITS
        odd = np.bincount(place, minlength=(len(ends) - 1) * BITS) & 1
        out[i : i + (1 << 11)] = np.packbits(odd.astype(bool).reshape(-1, BITS), axis=1)
    return out


def _incidence(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, n, k1, k2, last_key, sketch, first array) per row: set size, set key, odd sketch and the grams of the prefix in order."""
    shared = docs.sparkSession.sparkContext.broadcast(_frequent(docs, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ranks = shared.value
        for batch in batches:
            parts = []
            for _, _, grams, at in gram_sets(batch.column("text"), k):
                n = np.diff(at)
                rows = tw.row_of(at)
                with np.errstate(over="ignore"):
                    sums = [np.concatenate([[np.uint64(0)], np.cumsum(tw.splitmix(grams ^ np.uint64(x)), dtype=np.uint64)]) for x in (1, 2)]
                    k1, k2 = (s[at[1:]] - s[at[:-1]] for s in sums)
                key = _order_keys(grams, last, ranks)
                order = np.lexsort((key, rows))
                size = np.where(n > 0, n - (n * percent + 99) // 100 + 1, 0)
                pick = order[(np.arange(len(grams)) - np.repeat(at[:-1], n)) < np.repeat(size, n)]
                ends = np.cumsum(size)
                end_key = np.where(n > 0, key[pick][np.maximum(ends - 1, 0)] if len(pick) else 0, 0)
                parts.append((n, k1, k2, end_key, size, grams[pick], odd_sketches(grams, at).ravel()))
            n, k1, k2, end_key, size, first, bits = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.uint64) for i in range(7))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size.astype(np.int64))]), pa.int32()), pa.array(first.astype(np.uint64).view(np.int64)))
            longs = [pa.array(x.astype(np.uint64).view(np.int64)) for x in (k1, k2, end_key)]
            sketch = pa.Array.from_buffers(pa.binary(BITS // 8), len(n), [None, pa.py_buffer(bits.astype(np.uint8))]).cast(pa.binary())
            yield pa.record_batch([batch.column("doc_id"), batch.column("th"), pa.array(n.astype(np.int64)), *longs, sketch, lists], names=["doc_id", "th", "n", "k1", "k2", "last_key", "sketch", "first"])

    return docs.mapInArrow(run, "doc_id long, th long, n long, k1 long, k2 long, last_key long, sketch binary, first array<long>")


def _columns(batches: Iterator[pa.RecordBatch], names: list[str]) -> list[np.ndarray]:
    """A block of the incidence matrix as arrays, sorted by gram, size and row."""
    whole = [b for b in batches if b.num_rows]
    if not whole:
        return [np.zeros(0, np.int64) for _ in names]
    table = pa.Table.from_batches(whole)
    out = [table.column(n).to_numpy() for n in names]
    order = np.lexsort((out[1], out[2], out[0]))
    return [x[order] for x in out]


def _with_sketches(batches: Iterator[pa.RecordBatch], names: list[str], shuffle: int | None = None) -> list[np.ndarray]:
    """As ``_columns``, with the sketches as rows of 64-bit numbers at the end; ``shuffle`` orders columns at random instead of by size."""
    whole = [b for b in batches if b.num_rows]
    if not whole:
        return [np.zeros(0, np.int64) for _ in names] + [np.zeros((0, BITS // 64), np.uint64)]
    table = pa.Table.from_batches(whole)
    out = [table.column(n).to_numpy() for n in names]
    bits = np.concatenate([np.frombuffer(c.buffers()[2], np.uint64, len(c) * BITS // 64, np.frombuffer(c.buffers()[1], np.int32)[c.offset].item()) for c in table.column("sketch").cast(pa.binary()).chunks])
    with np.errstate(over="ignore"):
        by = out[2] if shuffle is None else tw.splitmix(out[1].view(np.uint64) ^ (out[0].view(np.uint64) * np.uint64(2 * shuffle + 3)))
    order = np.lexsort((out[1], by, out[0]))
    return [x[order] for x in out] + [bits.reshape(-1, BITS // 64)[order]]


def _room(n: np.ndarray, m: np.ndarray, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """At least 0 where the sketches allow the similarity: what the sizes allow less what the sketches differ in."""
    return (n + m) * (100 - percent) - np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) * (100 + percent)


def _close(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return np.minimum(n, m) * 100 >= np.maximum(n, m) * percent


def _pair_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((hi, lo))
    lo, hi = lo[order], hi[order]
    new = np.ones(len(lo), bool)
    new[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    at = np.flatnonzero(new)
    return pa.record_batch([pa.array(lo[at]), pa.array(hi[at]), pa.array(np.diff(np.append(at, len(lo))))], names=["a", "b", "c"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the similarity."""
    left = pairs.select("a", "b").join(sets.select(F.col("rep").alias("a"), F.col("grams").alias("x")), "a")
    both = left.join(sets.select(F.col("rep").alias("b"), F.col("grams").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                same = int((y[at] == x).sum())
                keep[i] = same * 100 >= percent * (len(x) + len(y) - same)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return both.mapInArrow(run, "a long, b long")


def near_duplicate_groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row: documents whose ``k``-word shingle sets have a Jaccard
    similarity of at least ``percent`` / 100 are linked; component_id is the smallest doc_id reachable.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. Null texts and texts without words have no
    shingles and stand alone. Rows with a null doc_id take part; component_id is null where no other id is
    reachable. Repeated rows give repeated results. Only doc_id and text are read.
    """
    return _grouped(docs, k, percent).select("doc_id", "n_shingles", "component_id")


def _grouped(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The columns of ``near_duplicate_groups``, th, the hash of the text, and component, a key of the group (null without shingles)."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    rows = stored(_incidence(docs, k, percent))
    classes = rows.filter("n > 0").groupBy("k1", "k2", "n").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "th", "last_key", "sketch", "first")).alias("r"))
    matrix = classes.select(F.explode("r.first").alias("gram"), F.col("k1").alias("rep"), "n", F.col("r.last_key").alias("last_key"), F.size("r.first").cast("long").alias("p"))

    def shared_columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, rep, n, last_key, p = _columns(batches, ["gram", "rep", "n", "last_key", "p"])
        same = gram[1:] == gram[:-1]
        keep = np.append(same, False) | np.append(False, same) if len(gram) else np.zeros(0, bool)
        yield pa.record_batch([pa.array(x[keep]) for x in (gram, rep, n, last_key, p)], names=["gram", "rep", "n", "last_key", "p"])

    shape = "gram long, rep long, n long, last_key long, p long"
    matrix = stored(matrix.repartition("gram").mapInArrow(shared_columns, shape))

    def nearest(seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Of the rows beside it in a column, the one that each row is most likely to be similar to."""
            gram, rep, n, component, bits = _with_sketches(batches, ["gram", "rep", "n", "component"], seed)
            best, other = np.full(len(gram), -1.0), np.zeros(len(gram), np.int64)
            for step in range(1, min(BESIDE, len(gram) - 1) + 1):
                i = np.flatnonzero((gram[step:] == gram[:-step]) & (component[step:] != component[:-step]))
                if not len(i):
                    continue
                j = i + step
                i, j = (x[_close(n[i], n[j], percent)] for x in (i, j))
                room = _room(n[i], n[j], bits[i], bits[j], percent) / (n[i] + n[j])
                for x, y in ((i, j), (j, i)):
                    better = room > best[x]
                    best[x[better]], other[x[better]] = room[better], rep[y[better]]
            ok = best >= 0
            yield pa.record_batch([pa.array(rep[ok]), pa.array(other[ok]), pa.array(best[ok])], names=["a", "b", "room"])

        return run

    facts = stored(matrix.groupBy("rep").agg(F.first("n").alias("n"), F.first("p").alias("p"), F.first("last_key").alias("last_key")))
    sketches = classes.groupBy(F.col("k1").alias("rep")).agg(F.first("r.sketch").alias("sketch"))
    matrix = stored(matrix.select("gram", "rep", "n").join(sketches, "rep"), matrix)

    def whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows of equal doc_id and text, which fall to one task, are one set
        seen: set[int] = set()
        for batch in batches:
            new = np.zeros(batch.num_rows, bool)
            for i, rep in enumerate(batch.column("k1").to_pylist()):
                new[i] = rep not in seen
                seen.add(rep)
            batch, out = batch.filter(pa.array(new)), []
            for _, _, grams, at in gram_sets(batch.column("text"), k):
                raw = grams.tobytes()
                out += [raw[8 * i : 8 * j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.record_batch([batch.column("k1"), pa.array(out, pa.binary())], names=["rep", "grams"])

    keys = stored(classes.select("k1", F.col("r.null").alias("_null"), F.coalesce("r.doc_id", F.lit(0)).alias("_id"), F.col("r.th").alias("_text")))

    def verified(pairs: DataFrame) -> DataFrame:
        """Those of the pairs whose whole sets, made anew from the texts, are similar enough."""
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("k1")).distinct().join(keys, "k1")
        texts = docs.withColumns(row_key()).join(wanted, ["_null", "_id", "_text"]).select("k1", "text")
        sets = stored(texts.mapInArrow(whole_sets, "rep long, grams binary"))
        return stored(_verified(pairs, sets, percent), sets)

    def coloured(links: DataFrame) -> DataFrame:
        groups = connected_components(links)
        return matrix.join(groups, matrix["rep"] == groups["node"], "left").select(*matrix.columns, F.coalesce("component", "rep").alias("component"))

    # pairs that no round tries are left to the full product below
    current, links, tried = matrix.withColumn("component", F.col("rep")), None, None
    for seed in range(ROUNDS):
        first = current.repartition("gram").mapInArrow(nearest(seed), "a long, b long, room double").groupBy("a", "b").agg(F.max("room").alias("room"))
        first = first if tried is None else first.withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")}).join(tried.select(F.col("a").alias("lo"), F.col("b").alias("hi")), ["lo", "hi"], "left_anti")
        best = first.groupBy("a").agg(F.max(F.struct("room", "b")).alias("m"))
        best = stored(best.select(F.least("a", "m.b").alias("a"), F.greatest("a", "m.b").alias("b")).distinct())
        new = verified(best)
        links, tried = (new, best) if links is None else (links.unionByName(new), tried.unionByName(best))
        current = coloured(links)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, rep, n, component, bits = _with_sketches(batches, ["gram", "rep", "n", "component"])
        cuts = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])) if len(gram) else np.zeros(0, np.int64)
        ends = np.append(cuts[1:], len(gram))
        held, size = [], 0

        def hold(x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            x, y = (z[component[x] != component[y]] for z in (x, y))
            x, y = (z[_room(n[x], n[y], bits[x], bits[y], percent) >= 0] for z in (x, y))
            held.append((rep[x], rep[y]))
            size += len(x)
            if size > 1 << 18:
                yield rest()

        def rest() -> pa.RecordBatch:
            nonlocal held, size
            out, held, size = _pair_batch(*(np.concatenate(z) for z in zip(*held, strict=True))), [], 0
            return out

        long = ends - cuts > SHORT
        end_of = np.repeat(np.where(long, 0, ends), ends - cuts)
        for step in range(1, min(SHORT, len(gram))):
            x = np.flatnonzero(end_of > np.arange(len(gram)) + step)
            if not len(x):
                break
            x = x[_close(n[x], n[x + step], percent)]
            for i in range(0, len(x), 1 << 18):
                yield from hold(x[i : i + (1 << 18)], x[i : i + (1 << 18)] + step)
        for i, j in zip(cuts[long].tolist(), ends[long].tolist(), strict=True):
            m, c = n[i:j], component[i:j]
            names, count = np.unique(c, return_counts=True)
            few = c != names[count.argmax()]  # rows outside the column's largest component meet all, those inside only them
            # sizes ascend within a column: row x meets rows of at least n t and at most n / t grams
            low, high = np.searchsorted(m * 100, m * percent), np.searchsorted(m * percent, m * 100, "right")
            for x in np.flatnonzero(few).tolist():
                y = np.arange(low[x], high[x])
                y = y[~few[y] | (y > x)] + i
                for at in range(0, len(y), 1 << 18):
                    part = y[at : at + (1 << 18)]
                    yield from hold(np.full(len(part), x + i), part)
        if held:
            yield rest()

    overlaps = current.repartition("gram").mapInArrow(products, "a long, b long, c long").groupBy("a", "b").agg(F.sum("c").alias("c"))
    for side in "ab":
        overlaps = overlaps.join(facts.select(F.col("rep").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("n", "p", "last_key")]), side)
    # up to the earlier end of the two prefixes every common gram has been counted
    room_a, room_b = F.col("n_a") - F.col("p_a"), F.col("n_b") - F.col("p_b")
    room = F.when(F.col("last_key_a") < F.col("last_key_b"), room_a).when(F.col("last_key_a") > F.col("last_key_b"), room_b).otherwise(F.greatest(room_a, room_b))
    enough = (F.col("c") + room) * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent
    more = stored(overlaps.filter(enough).select("a", "b").join(tried, ["a", "b"], "left_anti"))
    links = links.unionByName(verified(more))
    members = connected_components(links).select(F.col("node").alias("k1"), "component")
    reps = stored(classes.select("k1", "k2", "n", F.col("r.doc_id").alias("rep")).join(members, "k1", "left").withColumn("component", F.coalesce("component", "k1")))
    least = reps.groupBy("component").agg(F.min("rep").alias("component_id"))
    reps = reps.join(least, "component").select("k1", "k2", "n", "component", "component_id")
    out = rows.select("doc_id", "th", "n", "k1", "k2").join(reps, ["k1", "k2", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "th", "component")


def keep_one_per_group(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each near-duplicate group, that of the smallest doc_id and then text hash, null ids last.

    Rows are told apart by doc_id and text. Of several rows that agree in both, the one with the smallest other
    columns stays (maps do not count). Texts without words stand alone, so all of them stay. Columns unchanged.
    """
    key, lanes = list(row_key()), 16
    rows = _grouped(docs, k, percent).filter("component IS NOT NULL")
    rows = rows.select(F.col("doc_id").isNull().alias("_null"), F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("th").alias("_text"), "component")
    rows = stored(rows.groupBy(*key, "component").agg(F.count("*").alias("_rows")))
    first = rows.groupBy("component").agg(F.min(F.struct(*key)).alias("_first"))
    rows = stored(rows.join(first, "component").select(*key, "_rows", (F.struct(*key) == F.col("_first")).alias("_wins")))
    keyed = docs.withColumns(row_key())
    others = keyed.join(rows.filter("NOT _wins OR _rows > 1").select(*key), key, "left_anti").select(*docs.columns)
    # a winner's repeated rows go to lanes, then the lanes' choices meet
    again = rows.filter("_wins AND _rows > 1").select(*key, F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("_lane"))
    again = keyed.withColumn("_lane", F.pmod(F.monotonically_increasing_id(), F.lit(lanes)).cast("int")).join(again, [*key, "_lane"])
    again = again.select(*key, "_lane", F.struct(*docs.columns).alias("_row"), F.struct(*[c for c, t in docs.dtypes if "map<" not in t]).alias("_by"))
    again = again.groupBy(*key, "_lane").agg(F.min_by("_row", "_by").alias("_row"), F.min("_by").alias("_by"))
    again = again.groupBy(*key).agg(F.min_by("_row", "_by").alias("_row"))
    return others.unionByName(again.select("_row.*"))
