"""Periodic runs of words: stretches that repeat one short sequence over and over.

A run is a maximal stretch of consecutive words with smallest period q whose length is at least
``max(least, copies * q)``. Recursive frequency splitting leaves little to look at: a run holds each of its
words at least ``copies`` times, so a word that occurs less often within the current segment can be in no run
there and splits the segment; this is repeated until nothing changes. The segments that are left are scanned
lag by lag: short lags word by word over all segments of a batch at once, longer lags where three
blocks of that length in a row begin alike and have equal hashes, which every such run must show. All lags
together cost m log m for a segment of m words. What is found is then checked on the words themselves, so
hashes decide nothing.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcesift.llm.textwords import SPACES, Powers, chunks, splitmix, table, word_bounds

#: Lags up to this one are compared word by word over all segments at once.
SHORT = 32
_BASE = Powers(0xA24BAED4963EE407)
_IS_WORD = table(SPACES)

Run = tuple[int, int, int]  # first word, end, period


def surviving(words: np.ndarray, doc: np.ndarray, copies: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions that no rare word splits off, in order, and the segment of each.

    ``words`` are word numbers, ``doc`` the ascending document of each place.
    """
    at, before = np.arange(len(words)), -1
    segment = doc
    while len(at) != before and len(at):
        before = len(at)
        width = int(words.max()) + 1
        _, code, counts = np.unique(segment * width + words[at], return_inverse=True, return_counts=True)
        at = at[counts[code] >= copies]
        if not len(at):
            break
        breaks = (np.diff(at) > 1) | (np.diff(doc[at]) > 0)
        first = np.concatenate([[0], np.flatnonzero(breaks) + 1])
        size = np.diff(np.append(first, len(at)))
        at, size = at[np.repeat(size >= least, size)], size[size >= least]
        segment = np.repeat(np.arange(len(size)), size)
    return at, segment[: len(at)]


def stretches(equal: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values of at least ``least``."""
    edge = np.diff(np.concatenate([[0], equal.view(np.int8), [0]]))
    a, z = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = z - a >= least
    return a[long], z[long]


def _short_lags(words: np.ndarray, segment: np.ndarray, copies: int, least: int, lags: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for q in range(1, min(lags, len(words) // copies) + 1):
        equal = (words[:-q] == words[q:]) & (segment[:-q] == segment[q:])
        a, z = stretches(equal, max(least, copies * q) - q)
        if len(a):
            yield q, a, z + q


def _long_lags(words: np.ndarray, copies: int, least: int, lags: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Stretches of one segment with a lag above ``lags``, ascending by lag.

    A run of copies * q words, copies >= 4, holds three whole blocks [kq, kq + q) in a row.
    """
    m, most = len(words), len(words) // copies
    if most <= lags:
        return
    power = _BASE.upto(m + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(splitmix(words) * power[:m])])
    found_q, found_at = [], []
    for k in range(m // (lags + 1) - 2):
        q = np.arange(lags + 1, min(most, m // (k + 3)) + 1)
        begin = words[k * q]
        q = q[(begin == words[(k + 1) * q]) & (begin == words[(k + 2) * q])]
        if len(q):
            one, two, three, end = (total[(k + i) * q] for i in range(4))
            with np.errstate(over="ignore"):
                alike = ((two - one) * power[q] == three - two) & ((three - two) * power[q] == end - three)
            q = q[alike]
            found_q.append(q)
            found_at.append(k * q)
    if not found_q:
        return
    q, at = np.concatenate(found_q), np.concatenate(found_at)
    order = np.lexsort((at, q))
    q, at = q[order], at[order]
    joined = np.concatenate([[True], (np.diff(q) > 0) | (np.diff(at) > q[1:])]) if len(q) else np.zeros(0, bool)
    head = np.flatnonzero(joined)
    tail = np.append(head[1:], len(q)) - 1
    for i in np.split(np.arange(len(head)), np.flatnonzero(np.diff(q[head])) + 1):
        if len(i):
            yield int(q[head[i[0]]]), at[head[i]], at[tail[i]] + 3 * q[head[i]]


class _Runs:
    """Runs found so far, by period; a stretch inside one whose period divides its lag has that smaller period."""

    def __init__(self) -> None:
        self.by_period: dict[int, tuple[list[int], list[int]]] = {}

    def holds(self, q: int, a: int, z: int) -> bool:
        for period, (starts, ends) in self.by_period.items():
            if q % period == 0 and (i := bisect_right(starts, a) - 1) >= 0 and ends[i] >= z:
                return True
        return False

    def add(self, q: int, runs: list[tuple[int, int]]) -> None:
        if runs:
            self.by_period[q] = ([a for a, _ in runs], [z for _, z in runs])


def find_in(words: np.ndarray, doc: np.ndarray, copies: int = 4, least: int = 6, short: int = SHORT) -> list[Run]:
    """All runs of a batch of documents given as word numbers, by period, then start. ``copies`` is at least 4."""
    at, segment = surviving(words, doc, copies, least)
    if not len(at):
        return []
    held, out = words[at], []
    known = _Runs()
    for q, starts, ends in _short_lags(held, segment, copies, least, short):
        new = [(a, z) for a, z in zip(starts.tolist(), ends.tolist(), strict=True) if not known.holds(q, a, z)]
        known.add(q, new)
        out += [(int(at[a]), int(at[z - 1]) + 1, q) for a, z in new]
    first = np.concatenate([[0], np.flatnonzero(np.diff(segment)) + 1, [len(at)]])
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if (hi - lo) // copies <= short:
            continue
        own = held[lo:hi]
        inside = _Runs()
        for q, (starts, ends) in known.by_period.items():
            i, j = bisect_right(starts, lo - 1), bisect_right(starts, hi - 1)
            inside.add(q, [(a - lo, z - lo) for a, z in zip(starts[i:j], ends[i:j], strict=True)])
        for q, starts, ends in _long_lags(own, copies, least, short):
            new = set()
            for a, z in zip(starts.tolist(), ends.tolist(), strict=True):
                if inside.holds(q, a, z):
                    continue
                low, high = max(0, a - q), min(len(own), z + q)  # on the words: where it really begins and ends
                xs, xe = stretches(own[low : high - q] == own[low + q : high], 1)
                for b, e in zip((xs + low).tolist(), (xe + low + q).tolist(), strict=True):
                    if e - b >= max(least, copies * q):
                        new.add((b, e))
            new = sorted(new)
            inside.add(q, new)
            out += [(int(at[lo]) + a, int(at[lo]) + z, q) for a, z in new]
    return out


Rewrite = Callable[[object, int], "np.ndarray | None"]


def periodic_runs(docs: DataFrame, copies: int = 4, least: int = 6, rewrite: Rewrite | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, n_words, ``runs`` (start, length, period; by start, then period) and ``collapsed_text``.

    The collapsed text is the words joined by one space, without those that a run holds after its first period.
    Words lie between ASCII white space and are compared byte by byte. Null and texts without words have no
    runs and an empty collapsed text. ``rewrite(key, n)`` may give, for the n words of a row, the places whose
    words stand in for them. Rows are worked on apart, wherever they lie: repeated rows give repeated results,
    an empty table an empty one, other columns are left out. Texts are never cut; a worker holds one Arrow batch,
    and works on a megabyte or one text of it at a time.
    """
    if copies < 4:
        raise ValueError("the search for long lags needs four copies")
    struct = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def worked(keys: list, data: np.ndarray, at: np.ndarray) -> tuple[list, list, list]:
        s, e, words_at = word_bounds(data, at, _IS_WORD)
        bounds = np.concatenate([[0], np.cumsum(e - s)])
        letters = pa.py_buffer(data[_IS_WORD[data]].tobytes())
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(bounds), letters])
        number = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        place = np.arange(len(s))
        for i, k in enumerate(keys):
            lo, hi = int(words_at[i]), int(words_at[i + 1])
            if rewrite and (new := rewrite(k, hi - lo)) is not None:
                place[lo:hi] = lo + new
        doc = np.repeat(np.arange(len(keys)), np.diff(words_at))
        runs: list[list] = [[] for _ in keys]
        gone = np.zeros(len(s) + 1, np.int64)
        for a, z, q in sorted(find_in(number[place], doc, copies, least)):
            i = int(doc[a])
            runs[i].append({"start": a - int(words_at[i]), "length": z - a, "period": q})
            gone[a + q] += 1
            gone[z] -= 1
        kept = place[np.cumsum(gone[:-1]) == 0] if len(s) else place
        kept_doc = doc[np.cumsum(gone[:-1]) == 0] if len(s) else doc
        # words with one space behind each, the last of a text without
        size = (e - s)[kept] + 1
        last = np.append(np.diff(kept_doc) > 0, True) if len(kept) else np.zeros(0, bool)
        size -= last
        ends = np.cumsum(size)
        out = np.full(int(ends[-1]) if len(ends) else 0, 0x20, np.uint8)
        body = (e - s)[kept]
        start = ends - size
        within = np.arange(int(body.sum())) - np.repeat(np.cumsum(body) - body, body)
        out[within + np.repeat(start, body)] = data[within + np.repeat(s[kept], body)]
        doc_ends = np.concatenate([[0], ends])[np.searchsorted(kept_doc, np.arange(len(keys) + 1))]
        raw = out.tobytes()
        texts = [raw[a:z].decode() for a, z in zip(doc_ends[:-1].tolist(), doc_ends[1:].tolist(), strict=True)]
        return np.diff(words_at).tolist(), runs, texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, at in chunks(batch.column(1)):
                keys = batch.column(0).slice(row, end - row)
                n, runs, texts = worked(keys.to_pylist(), data, at)
                yield pa.record_batch([keys, pa.array(n, pa.int64()), pa.array(runs, pa.list_(struct)), pa.array(texts, pa.string())], names=[key, "n_words", "runs", "collapsed_text"])

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed_text string"
    return docs.select(key, text).mapInArrow(run, schema)


def greatest_exponent(runs: Column) -> Column:
    """The run with the greatest exact length / period, the first of several; null without runs."""
    over = lambda a, b: F.when(a["length"] * b["period"] > b["length"] * a["period"], a).otherwise(b)
    return F.when(F.size(runs) > 0, F.aggregate(runs, runs[0], lambda best, r: over(r, best)))


def repeated_tail(key: object, n: int) -> np.ndarray | None:
    """A rewriting for trials: the tails of a tenth of all texts become repetitions, by the CRC of their keys; a null key is left alone."""
    if key is None or not n:
        return None
    h = zlib.crc32(str(key).encode())
    g = h // 10
    if h % 10:
        return None
    a, place = g % n, np.arange(n)
    place[a:] = a + (place[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return place
