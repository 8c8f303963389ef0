"""Embedding near-duplicates by collision counting over one-dimensional projections.

Unit vectors are projected on many random directions. Two vectors collide in a projection if each lies in
the window centred on the other; near vectors collide often, and the count that a pair at the threshold
reaches with high probability follows from the normal law, so it is calibrated for recall. Pairs that pass
it are verified by cosine in double precision.

Counting for all pairs would be quadratic, so cells of further projections, cut at the middle of their
sorted order, route vectors to tables of cells; the number of tables follows from the recall asked for at
the threshold. Within a cell vectors are sorted on one projection and only meet those in its window. A pair
that shares cells of several tables counts in the first alone. Cells with many vectors are split into
pairs of blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcesift.llm.storage import connected_components, stored

COUNTED = 48  # projections on which collisions are counted
CELL = 64  # vectors aimed at per cell
BLOCK = 2048  # vectors per block of a crowded cell
PAIRS = 1 << 17  # pairs looked at together


class Projections:
    """Seeded directions, window and calibrated count for vectors of one dimension."""

    def __init__(self, dim: int, bits: int, tables: int, threshold: float, seed: int) -> None:
        rng = np.random.default_rng([seed, dim])
        self.counting = rng.standard_normal((dim, COUNTED))
        self.routing = rng.standard_normal((tables, dim, bits))
        distance = math.sqrt(2 - 2 * threshold)
        self.window = 1.3 * distance
        self.sorted_window = 3.3 * distance
        hit = math.erf(self.window / distance / math.sqrt(2))
        law = [math.comb(COUNTED, i) * hit**i * (1 - hit) ** (COUNTED - i) for i in range(COUNTED + 1)]
        self.least = int(np.searchsorted(np.cumsum(law), 0.002))  # 99.8 % of pairs at the threshold collide as often

    def codes(self, unit: np.ndarray) -> np.ndarray:
        weights = 1 << np.arange(self.routing.shape[2], dtype=np.int64)
        return np.stack([(unit @ r > 0) @ weights for r in self.routing], axis=1)


def routing_plan(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """Bits per cell and number of tables for ``n`` vectors."""
    bits = max(1, math.ceil(math.log2(max(2, n / CELL))))
    meets = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - meets)))


def _unit(vectors: pa.ListArray) -> np.ndarray:
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
    x = values.reshape(len(vectors), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _links(x: np.ndarray, codes: np.ndarray, table: int, split: int | None, at: Projections, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs of positions within one cell; with ``split`` only pairs across that position."""
    proj = x @ at.counting
    order = np.argsort(proj[:, 0], kind="stable")
    line = proj[order, 0]
    upto = np.searchsorted(line, line + at.sorted_window, "right")
    sizes = upto - np.arange(len(line)) - 1
    i = 0
    ends = np.cumsum(sizes)
    while i < len(line):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS, "right")))
        n = sizes[i:j]
        first = np.repeat(np.arange(i, j), n)
        second = first + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        a, b = order[first], order[second]
        keep = ~(codes[a, :table] == codes[b, :table]).any(axis=1)
        if split is not None:
            keep &= (a < split) != (b < split)
        a, b = a[keep], b[keep]
        count = np.zeros(len(a), np.int16)
        for c in range(COUNTED):
            count += np.abs(proj[a, c] - proj[b, c]) <= at.window
        a, b = a[count >= at.least], b[count >= at.least]
        near = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
        yield a[near], b[near]
        i = j


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            return label


def near_vectors(vectors: DataFrame, threshold: float = 0.9, recall: float = 0.98, seed: int = 7) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of (vec_id, embedding).

    Null and zero vectors and those with null or non-finite components link with nothing; vectors of different
    length are never compared. Equal vectors are one vector with a weight, linked with each other. n_links
    counts the linked rows found; component_id is the smallest vec_id reachable. Rows without a vec_id are
    left out. An empty table gives an empty result; other columns are not read.
    """
    rows = vectors.filter("vec_id IS NOT NULL").select("vec_id", "embedding")
    sound = (
        "embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity')) "
        "AND exists(embedding, x -> x != 0)"
    )
    good = rows.withColumn("sound", F.coalesce(F.expr(sound), F.lit(False)))
    classes = stored(good.filter("sound").groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")))
    bits, tables = routing_plan(classes.count(), threshold, recall)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Projections] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                at = made.setdefault(int(dim), Projections(int(dim), bits, tables, threshold, seed))
                part = batch.filter(pa.array(dims == dim))
                codes = at.codes(_unit(part.column("embedding")))
                take = pa.array(np.repeat(np.arange(part.num_rows), tables))
                yield pa.record_batch([part.column("id").take(take), part.column("dim").take(take), pa.array(np.tile(np.arange(tables, dtype=np.int32), part.num_rows)), pa.array(codes.ravel())], names=["id", "dim", "tab", "cell"])

    cells = classes.select("id", F.size("embedding").alias("dim"), "embedding").mapInArrow(route, "id long, dim int, tab int, cell long")
    cells = stored(cells)
    crowded = cells.groupBy("dim", "tab", "cell").agg(F.count("*").alias("m")).filter("m > 1")
    crowded = crowded.withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    dealt = cells.join(crowded, ["dim", "tab", "cell"]).withColumn("mine", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("id", "dim", "tab", "cell", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    # a task takes many small cells or one pair of blocks
    cellful = dealt.join(classes.select("id", "n", "embedding"), "id")
    cellful = cellful.repartition("dim", "tab", "cell", "i", "j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = [b for b in batches if b.num_rows]
        if not whole:
            return
        table = pa.Table.from_batches(whole).sort_by([(c, "ascending") for c in ("dim", "tab", "cell", "i", "j", "mine", "id")])
        keys = [table.column(c).to_numpy() for c in ("dim", "tab", "cell", "i", "j")]
        new = np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0))
        begins = np.flatnonzero(new)
        made: dict[int, Projections] = {}
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for s, e in zip(begins.tolist(), np.append(begins[1:], table.num_rows).tolist(), strict=True):
            dim, tab, i, j = (int(k[s]) for k in (keys[0], keys[1], keys[3], keys[4]))
            part = table.slice(s, e - s)
            ids, n, mine = (part.column(c).to_numpy() for c in ("id", "n", "mine"))
            at = made.setdefault(dim, Projections(dim, bits, tables, threshold, seed))
            x = _unit(part.column("embedding").combine_chunks())
            split = int((mine == i).sum()) if i != j else None
            found = [p for p in _links(x, at.codes(x)[:, : tab + 1], tab, split, at, threshold) if len(p[0])]
            if not found:
                continue
            a, b = (np.concatenate(p) for p in zip(*found, strict=True))
            gain = np.bincount(a, n[b], minlength=len(ids)) + np.bincount(b, n[a], minlength=len(ids))
            hit = np.flatnonzero(gain)
            out.append((ids[hit], ids[_forest(len(ids), a, b)][hit], gain[hit].astype(np.int64)))
        if out:
            yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["a", "b", "gain"])

    found = stored(cellful.mapInArrow(compare, "a long, b long, gain long"))
    gains = found.groupBy("a").agg(F.sum("gain").alias("gain"))
    members = connected_components(found.select("a", "b"))
    info = classes.join(gains, classes["id"] == gains["a"], "left").join(members, classes["id"] == members["node"], "left")
    info = info.select("embedding", "id", "n", F.coalesce("gain", F.lit(0)).alias("gain"), F.coalesce("component", "id").alias("component"))
    joined = good.join(info.withColumn("sound", F.lit(True)), ["embedding", "sound"], "left")
    return joined.select(
        "vec_id", F.coalesce(F.col("n") - 1 + F.col("gain"), F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"), (F.col("vec_id") == F.coalesce("component", "vec_id")).alias("kept"),
    )
