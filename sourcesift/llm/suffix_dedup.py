"""Suffix-array de-duplication on bytes with a hash-compared suffix sort.

Suffixes are sorted by a mergesort whose comparisons find the common extension of two suffixes by binary
search over prefix polynomial hashes. The common prefixes of neighbours are then verified byte by byte. Only
suffixes at anchors (see ``anchors``) that occur again in another context are sorted, forwards and, for what
stands before the anchor, backwards; the two orders together tell which windows around it are equal. An anchor
with too many contexts for one task is first told apart by longer grams around it (see ``halved``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcesift.llm import textwords as tw
from sourcesift.llm.anchors import Units, candidate_windows, context_hashes, judged, keyed, with_texts
from sourcesift.llm.storage import stored

#: Anchors with more different contexts are not sorted in one task, but given longer grams, which splits them over all tasks.
SORTED = 1024
_POWER = tw.Powers(0x9FB21C651E98DF25)


class Suffixes:
    """Strings data[start : start + size] with constant-time equality of their prefixes."""

    def __init__(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        self.data, self.start, self.size = data, start, size
        self.power = _POWER.upto(len(data) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.append(np.uint64(0), np.cumsum(tw.BYTE_CODE[data] * self.power[: len(data)], dtype=np.uint64))

    def _same(self, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
        a, b = self.start[x], self.start[y]
        with np.errstate(over="ignore"):
            left, right = self.sums[a + n] - self.sums[a], self.sums[b + n] - self.sums[b]
            return left * self.power[np.maximum(b - a, 0)] == right * self.power[np.maximum(a - b, 0)]

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common prefixes, by binary search over hashes."""
        low, high = np.zeros(len(x), np.int64), np.minimum(self.size[x], self.size[y])
        while (open_ := low < high).any():
            mid = (low + high + 1) // 2
            same = self._same(x, y, mid)
            low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)
        return low

    def less(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        n = self.extension(x, y)
        end_x, end_y = n >= self.size[x], n >= self.size[y]
        top = len(self.data) - 1
        bytes_less = self.data[np.minimum(self.start[x] + n, top)] < self.data[np.minimum(self.start[y] + n, top)]
        return np.where(end_x | end_y, end_x & ~end_y, bytes_less)

    def sorted_within(self, group: np.ndarray) -> np.ndarray:
        """Order of the suffixes within ascending ``group`` numbers: a mergesort, all groups at once."""
        order = np.arange(len(group))
        first = np.searchsorted(group, group)
        count = np.searchsorted(group, group, "right") - first
        run = 1
        while len(order) and (live := np.flatnonzero(count > run)).size:
            j = live - first[live]
            pair = j // (2 * run) * (2 * run)
            left = j - pair < run
            begin = first[live] + pair + np.where(left, run, 0)  # the run beside its own
            stop = np.minimum(first[live] + pair + np.where(left, 2 * run, run), first[live] + count[live])
            low, high = np.minimum(begin, stop), stop.copy()
            base, mine = low.copy(), order[live]
            while (todo := np.flatnonzero(low < high)).size:
                mid = (low[todo] + high[todo]) // 2
                other = order[mid]
                # equal suffixes of the left run come first
                before = np.where(left[todo], self.less(other, mine[todo]), ~self.less(mine[todo], other))
                low[todo] = np.where(before, mid + 1, low[todo])
                high[todo] = np.where(before, high[todo], mid)
            own = np.where(left, j - pair, j - pair - run)
            merged = order.copy()
            merged[first[live] + pair + own + (low - base)] = mine
            order, run = merged, 2 * run
        return order

    def neighbours(self, order: np.ndarray) -> np.ndarray:
        """Common prefix of each suffix in ``order`` and the one before it, verified on the bytes themselves."""
        out = np.zeros(len(order), np.int64)
        for i in range(1, len(order), 1 << 11):
            y = order[i : i + (1 << 11)]
            x = order[i - 1 : i - 1 + len(y)]
            said = self.extension(x, y)
            widest = int(said.max(initial=0))
            if not widest:
                continue
            step = np.arange(widest)
            a, b = np.minimum(self.start[x, None] + step, len(self.data) - 1), np.minimum(self.start[y, None] + step, len(self.data) - 1)
            differs = (self.data[a] != self.data[b]) & (step < said[:, None])
            out[i : i + len(y)] = np.where(differs.any(axis=1), differs.argmax(axis=1), said)
        return out


def repeated_starts(key: np.ndarray, data: np.ndarray, at: np.ndarray, left: np.ndarray, span: np.ndarray, weight: np.ndarray, window: int) -> np.ndarray:
    """For contexts sorted by key: which of their windows have an equal one; (contexts, starts) booleans.

    Context i is data[at[i] : at[i + 1]], its anchor ``left[i]`` bytes in, its windows start at 0..span[i].
    """
    group = np.cumsum(np.append(True, key[1:] != key[:-1])) - 1
    anchor = at[:-1] + left
    ahead = Suffixes(data, anchor, np.minimum(at[1:] - anchor, window))
    behind = Suffixes(data[::-1].copy(), len(data) - anchor, left)
    ranks = []
    for side in (ahead, behind):
        order = side.sorted_within(group)
        common = side.neighbours(order)
        common[np.append(True, group[order][1:] != group[order][:-1])] = -1
        ranks.append((order, common))
    out = np.zeros((len(key), int(span.max(initial=0)) + 1), bool)
    for back in range(int(left.max(initial=0)) + 1):  # windows that start ``back`` bytes before the anchor
        here = np.flatnonzero((left >= back) & (left - back <= span))
        if not len(here):
            continue
        classes = []
        for (order, common), depth in zip(ranks, (window - back, back), strict=True):
            number = np.empty(len(key), np.int64)
            number[order] = np.cumsum(common < depth)
            classes.append(number[here])
        code = classes[0] * (len(key) + 1) + classes[1]
        _, inverse = np.unique(code, return_inverse=True)
        again = np.bincount(inverse, weight[here])[inverse] > 1
        out[here[again], (left - back)[here[again]]] = True
    return out


def cut_pieces(rich: DataFrame, window: int) -> DataFrame:
    """A row per place in texts with their places: the bytes of its context beside it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = tw.text_buffer(batch.column("text"))
            lists = batch.column("at")
            flat = lists.flatten()
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            lo, hi = (flat.field(f).to_numpy() for f in ("lo", "hi"))
            raw = data.tobytes()
            begin, stop = (at[row] + lo).tolist(), (at[row] + hi + window).tolist()
            pieces = pa.array([raw[i:j] for i, j in zip(begin, stop, strict=True)], pa.binary())
            take = pa.array(row)
            yield pa.record_batch([batch.column("id").take(take), batch.column("th").take(take), *[flat.field(f) for f in ("key", "a", "lo", "hi", "weight")], pieces], names=["id", "th", "key", "a", "lo", "hi", "weight", "piece"])

    return rich.mapInArrow(cut, "id long, th long, key long, a int, lo int, hi int, weight int, piece binary")


def halved(pieces: DataFrame, window: int, gram: int) -> DataFrame:
    """The contexts of anchors of ``gram`` bytes as contexts of anchors of ``gram + step``, step being half of what a window has besides.

    A window holds either the ``step`` bytes before its anchor or those behind it, and equal windows the same ones. So
    each context is cut in two at most, whose keys are the longer grams. Most that is not repeated is then alone with
    its key, and what is repeated has whole contexts that are equal.
    """
    step = (window - gram + 1) // 2

    def halve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = tw.text_buffer(batch.column("piece"))
            a, lo, hi = (batch.column(c).to_numpy() for c in ("a", "lo", "hi"))
            before, behind = np.flatnonzero(lo <= a - step), np.flatnonzero(hi > a - step)
            row = np.append(before, behind)
            first, last = np.append(lo[before], np.maximum(lo, a - step + 1)[behind]), np.append(np.minimum(hi, a - step)[before], hi[behind])
            anchor = np.append(a[before] - step, a[behind])
            units, base = tw.BYTE_CODE[data], at[row] - lo[row]
            key = tw.gram_hashes(units, gram + step)[base + anchor]
            context = context_hashes(units, base + anchor, base + first, base + last, window)
            raw, take = data.tobytes(), pa.array(row)
            some = pa.array([raw[i:j] for i, j in zip((base + first).tolist(), (base + last + window).tolist(), strict=True)], pa.binary())
            yield pa.record_batch(
                [*[batch.column(c).take(take) for c in ("id", "th")], pa.array(key.view(np.int64)), pa.array(context.view(np.int64)), *[pa.array(x.astype(np.int32)) for x in (anchor, first, last)], batch.column("weight").take(take), some],
                names=["id", "th", "key", "context", "a", "lo", "hi", "weight", "piece"],
            )

    return pieces.mapInArrow(halve, "id long, th long, key long, context long, a int, lo int, hi int, weight int, piece binary")


def repeated_spans(docs: DataFrame, window: int = 200, gram: int = 32) -> DataFrame:
    """(id, th, lo, hi): runs of starts of ``window``-byte strings that start anywhere else as well."""
    known, left = candidate_windows(docs, Units(False, window, gram))
    fields = ["key", "a", "lo", "hi", "weight"]
    spans = known.select("id", "th", "lo", "hi")
    pieces = cut_pieces(with_texts(left.filter(f"others <= {SORTED}"), docs, fields), window)
    # rows of equal key and text bring the same places
    many = stored(cut_pieces(with_texts(left.filter(f"others > {SORTED}"), docs, fields), window).dropDuplicates(["id", "th", "lo"]))
    while gram < window and not many.isEmpty():
        halves = stored(halved(many, window, gram), many)
        gram += (window - gram + 1) // 2
        known, left = judged(halves, halves)
        spans = spans.unionByName(known.select("id", "th", "lo", "hi"))
        pieces = pieces.unionByName(left.filter(f"others <= {SORTED}").select(pieces.columns))
        many = stored(left.filter(f"others > {SORTED}").select(pieces.columns))

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = [b for b in batches if b.num_rows]
        if not whole:
            return
        table = pa.Table.from_batches(whole)
        table = table.take(pa.array(np.argsort(table.column("key").to_numpy(), kind="stable")))
        keys, begin = table.column("key").to_numpy(), 0
        while begin < len(keys):  # whole anchors, a bounded number of contexts at a time
            end = int(np.searchsorted(keys, keys[min(begin + 4 * SORTED, len(keys)) - 1], "right"))
            yield sort_part(table.slice(begin, end - begin).combine_chunks())
            begin = end

    def sort_part(table: pa.Table) -> pa.RecordBatch:
        key, a, lo, hi, weight = (table.column(c).to_numpy() for c in ("key", "a", "lo", "hi", "weight"))
        data, at = tw.text_buffer(table.column("piece"))
        starts = repeated_starts(key, data, at, (a - lo).astype(np.int64), (hi - lo).astype(np.int64), weight.astype(float), window)
        starts[weight > 1] = False  # already known
        edges = np.diff(np.pad(starts, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, first = np.nonzero(edges == 1)
        _, last = np.nonzero(edges == -1)
        take = pa.array(row)
        return pa.record_batch(
            [table.column("id").combine_chunks().take(take), table.column("th").combine_chunks().take(take), pa.array((lo[row] + first).astype(np.int32)), pa.array((lo[row] + last - 1).astype(np.int32))],
            names=["id", "th", "lo", "hi"],
        )

    found = pieces.repartition("key").mapInArrow(sort, "id long, th long, lo int, hi int")
    return spans.unionByName(found)


def dedup_bytes(docs: DataFrame, window: int = 200) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) per row: bytes under repeated strings are removed.

    Texts are read as UTF-8, null as empty. Every copy of a repeated ``window``-byte string goes, the first as
    well, also within one document and where copies overlap; strings are judged on the input and never cross
    rows. Repeated rows are copies of each other. Only doc_id and text are read.
    """
    rows = keyed(docs)
    spans = stored(repeated_spans(rows, window)).groupBy("id", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    rich = rows.join(spans, ["id", "th"], "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = tw.text_buffer(batch.column("text"))
            lists = batch.column("spans")
            flat, cuts = lists.flatten(), np.cumsum(np.append(0, np.nan_to_num(lists.value_lengths().fill_null(0).to_numpy())))
            lo, hi = (flat.field(f).to_numpy().astype(np.int64) for f in ("lo", "hi"))
            removed, n_spans, kept = [], [], []
            for r in range(batch.num_rows):
                part = data[at[r] : at[r + 1]]
                steps = np.zeros(len(part) + 1, np.int32)
                np.add.at(steps, lo[cuts[r] : cuts[r + 1]], 1)
                np.add.at(steps, hi[cuts[r] : cuts[r + 1]] + window, -1)
                gone = np.cumsum(steps)[: len(part)] > 0
                removed.append(int(gone.sum()))
                n_spans.append(int((gone & ~np.append(False, gone[:-1])).sum()) if len(part) else 0)
                kept.append(part[~gone].tobytes())
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(np.diff(at)), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return rich.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
