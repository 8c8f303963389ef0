"""Substring de-duplication by counting windows of words.

Windows that occur more than once are found by their anchors (see ``anchors``) and by counts of their hashes; no
document is parsed against a reference. Neighbouring repeated windows are then joined to factors. The words
under factors are duplicate spans. A factor's ref_doc has each of its windows somewhere when the windows' texts
agree, but not necessarily all of them in one place, so a factor longer than a window need not be one whole copy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcesift.llm import textwords as tw
from sourcesift.llm.anchors import Units, candidate_windows, keyed, repeated_windows, window_rows
from sourcesift.llm.storage import stored

#: Windows are counted in so many parts of their hashes, one after the other, so that not all are shuffled to disk at once.
PARTS = 6
FACTORS = "array<struct<start:int,length:int,ref_doc:long>>"


def greedy_factors(lo: np.ndarray, hi: np.ndarray, ref_doc: np.ndarray, window: int) -> list[tuple[int, int, int]]:
    """Factors (start, length, ref_doc) from runs of windows lo..hi and a text that has each.

    A run that goes on at the next window and names the same text makes the last factor longer, wherever in that
    text the window stands; any other begins a new factor.
    """
    out: list[list[int]] = []
    for i in np.lexsort((hi, lo)):
        a, z, doc = int(lo[i]), int(hi[i]), int(ref_doc[i])
        if out:
            last = out[-1]
            upto = last[0] + last[1] - window  # the last factor's last window
            if z <= upto:
                continue
            if doc == last[2] and a <= upto + 1:
                last[1] = z + window - last[0]
                continue
        out.append([a, z - a + window, doc])
    return [tuple(f) for f in out]


def factor_documents(docs: DataFrame, window: int = 35) -> DataFrame:
    """(id, th, factors) of each text with factors of at least ``window`` words; th hashes the text."""
    docs, kind = keyed(docs), Units(True, window, min(6, window))
    known, left = candidate_windows(docs, kind)
    windows = stored(window_rows(left, docs, kind))
    runs = known
    for part in range(PARTS):  # equal windows are in one part; a part's shuffle files go before the next begins
        some = windows.filter(F.pmod("w1", F.lit(PARTS)) == part)
        runs = runs.unionByName(stored(repeated_windows(some), *[windows] * (part == PARTS - 1)))
    runs = runs.groupBy("id", "th").agg(F.collect_list(F.struct("lo", "hi", "ref_doc")).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("at")
            flat, cuts = lists.flatten(), np.cumsum(np.append(0, np.diff(lists.offsets.to_numpy())))
            fields = [flat.field(f).fill_null(-1).to_numpy() for f in ("lo", "hi", "ref_doc")]
            factors = [greedy_factors(*(f[i:j] for f in fields), window) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            rows = [[dict(zip(("start", "length", "ref_doc"), f, strict=True)) for f in one] for one in factors]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("ref_doc", pa.int64())]))
            yield pa.record_batch([batch.column("id"), batch.column("th"), pa.array(rows, kind)], names=["id", "th", "factors"])

    return runs.mapInArrow(run, f"id long, th long, factors {FACTORS}")


def dedup_words(docs: DataFrame, window: int = 35) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text) per row: words under factors are removed.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged; kept words are joined by one space. Every copy of a repeated
    window goes, the first as well, also within one document; windows are judged on the input. Null and empty
    texts have no words. Repeated rows are copies of each other. Only doc_id and text are read.
    """
    factors = stored(factor_documents(docs, window))
    ranges = factors.select("id", "th", F.transform("factors", lambda f: F.struct(f["start"].alias("a"), (f["start"] + f["length"]).alias("z"))).alias("spans"))
    rows = keyed(docs)
    rich = rows.join(ranges, ["id", "th"], "left").select("doc_id", "text", "spans")
    mask = tw.table(tw.SPACES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("spans").to_pylist()
            n_words, n_removed, kept_texts = [], [], []
            for first, _, data, at in tw.chunks(batch.column("text")):
                s, e, words = tw.word_bounds(data, at, mask)
                raw = data.tobytes()
                for r in range(len(at) - 1):
                    i, j = int(words[r]), int(words[r + 1])
                    gone = np.zeros(j - i, bool)
                    for span in spans[first + r] or ():
                        gone[span["a"] : span["z"]] = True
                    kept = np.flatnonzero(~gone) + i
                    n_words.append(j - i)
                    n_removed.append(int(gone.sum()))
                    kept_texts.append(b" ".join([raw[x:y] for x, y in zip(s[kept].tolist(), e[kept].tolist(), strict=True)]))
            hashes = [hashlib.sha256(t).hexdigest() for t in kept_texts]
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(hashes, pa.string()), pa.array([t.decode() for t in kept_texts], pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )

    return rich.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
