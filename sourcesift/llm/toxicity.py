"""Classifier chain for toxicity categories: linear models over hashed words, one after the other.

Each later model also sees the earlier categories' probabilities. In training those are out-of-fold
predictions, so that the later models learn from probabilities like those they meet when scoring.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcesift.llm import textwords as tw

#: Everything ASCII but letters and digits separates words.
SEPARATORS = bytes(b for b in range(128) if not chr(b).isalnum())
BITS = 17
#: Besides whole words, their first bytes are features: stems meet words not seen in training.
STEM = 4
#: (category, SQL over the label table), in the order of the chain.
CATEGORIES = (("low_quality", "1 - quality"), ("toxic", "toxic"))


def word_features(texts: pa.Array, bits: int = BITS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per chunk of rows: first row, end row, and the distinct (row in chunk, bucket) pairs of words and stems."""
    mask = tw.table(SEPARATORS)
    for row, end, data, at in tw.chunks(texts):
        s, e, words = tw.word_bounds(data, at, mask)
        whole = tw.word_hashes(data, s, e, tw.LOWER)
        stem = tw.splitmix(tw.word_hashes(data, s, np.minimum(e, s + STEM), tw.LOWER))
        rows = tw.row_of(words) << bits
        pairs = np.unique(np.concatenate([rows | (h >> np.uint64(64 - bits)).astype(np.int64) for h in (whole, stem)]))
        yield row, end, pairs >> bits, pairs & ((1 << bits) - 1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_linear(rows: np.ndarray, cols: np.ndarray, extra: np.ndarray, y: np.ndarray, width: int, steps: int = 100, l2: float = 1e-3, least: int = 3) -> np.ndarray:
    """Logistic regression on binary sparse features plus dense ``extra`` columns; bias first.

    Words are scaled by their smoothed log ratio between the classes, those in fewer than ``least`` rows
    by 0, so that rare words are not learnt by heart. Full-batch Adam, deterministic. Returns
    [bias, extras…, word weights…].
    """
    k, n = extra.shape[1], max(1, len(y))
    yes, no = (np.bincount(cols, side[rows], minlength=width) for side in (y, 1 - y))
    ratio = np.log((yes + 1) / (y.sum() + 2)) - np.log((no + 1) / ((1 - y).sum() + 2))
    ratio *= yes + no >= least
    # words that count, renumbered, in row order and in word order, so that sums run over slices
    words, cols = np.unique(cols[use := ratio[cols] != 0], return_inverse=True)
    rows, scale = rows[use], ratio[words]
    by_row, by_word = np.argsort(rows, kind="stable"), np.argsort(cols, kind="stable")
    row_cols, word_rows = cols[by_row], rows[by_word]
    some, row_at = np.unique(rows[by_row], return_index=True)
    word_at = np.searchsorted(cols[by_word], np.arange(len(words)))
    w = np.zeros(1 + k + len(words))
    first, second = np.zeros_like(w), np.zeros_like(w)
    base = float(np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3))
    w[0] = np.log(base / (1 - base))
    for t in range(1, steps + 1):
        z = w[0] + extra @ w[1 : 1 + k]
        if len(words):
            z[some] += np.add.reduceat((w[1 + k :] * scale)[row_cols], row_at)
        error = (_sigmoid(z) - y) / n
        slope = np.add.reduceat(error[word_rows], word_at) * scale if len(words) else np.zeros(0)
        grad = np.concatenate([[error.sum()], extra.T @ error, slope])
        grad[1:] += l2 * w[1:]
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        w -= 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    out = np.zeros(1 + k + width)
    out[: 1 + k] = w[: 1 + k]
    out[1 + k + words] = w[1 + k :] * scale
    return out


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut with the highest F1; of equal ones the middle of the widest gap of log odds."""
    if not y.any():
        return 1.1  # nothing can be found
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    odds = np.log(np.clip(p[order], 1e-9, 1 - 1e-9) / (1 - np.clip(p[order], 1e-9, 1 - 1e-9)))
    gap = np.append(odds[:-1] - odds[1:], odds[-1] + 30)
    best = max(np.flatnonzero((f1 >= f1.max() - 1e-12) & (gap > 0)), key=lambda i: gap[i], default=len(y) - 1)
    return float(_sigmoid(np.array([odds[best] - gap[best] / 2]))[0])


@dataclass
class Chain:
    """Weights and threshold per category, in order."""

    names: list[str]
    weights: list[np.ndarray]
    thresholds: list[float]
    bits: int = BITS

    def probabilities(self, rows: np.ndarray, cols: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, len(self.names)))
        for c, w in enumerate(self.weights):
            z = w[0] + out[:, :c] @ w[1 : 1 + c] + np.bincount(rows, w[1 + c :][cols], minlength=n)
            out[:, c] = _sigmoid(z)
        return out


def train_chain(rows: np.ndarray, cols: np.ndarray, labels: np.ndarray, folds: np.ndarray, names: list[str], bits: int = BITS) -> Chain:
    """Fit the chain on sparse features; ``labels`` is (n, categories) with NaN for unknown."""
    n, width = len(labels), 1 << bits
    known = np.zeros((n, len(names)))  # out-of-fold probabilities
    weights, thresholds = [], []
    for c in range(len(names)):
        y, extra, has = labels[:, c], known[:, :c], ~np.isnan(labels[:, c])

        def fit(pick: np.ndarray, y: np.ndarray = y, extra: np.ndarray = extra) -> np.ndarray:
            place = np.cumsum(pick) - 1
            use = pick[rows]
            return fit_linear(place[rows[use]], cols[use], extra[pick], y[pick], width)

        for fold in np.unique(folds):
            w, out = fit(has & (folds != fold)), folds == fold
            z = w[0] + extra @ w[1 : 1 + c] + np.bincount(rows, w[1 + c :][cols], minlength=n)
            known[out, c] = _sigmoid(z[out])
        weights.append(fit(has))
        thresholds.append(best_threshold(known[has, c], y[has]))
    return Chain(list(names), weights, thresholds, bits)


def fit_chain(docs: DataFrame, labels: DataFrame, categories: tuple = CATEGORIES, most_rows: int = 8192, folds: int = 5, bits: int = BITS) -> Chain:
    """Train on at most ``most_rows`` labelled documents, the first by a hash of doc_id.

    The sample is bounded, so its labels are broadcast to the documents and its features meet in one
    task. Without labelled documents the chain finds nothing.
    """
    names = [c for c, _ in categories]
    chosen = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(*[F.max(F.expr(f"cast({e} AS double)")).alias(f"y{i}") for i, (_, e) in enumerate(categories)])
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    ys = [f"y{i}" for i in range(len(names))]
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.zeros(0, np.int32)] * batch.num_rows
            for row, end, r, c in word_features(batch.column("text"), bits):
                for i, part in enumerate(np.split(c.astype(np.int32), np.searchsorted(r, np.arange(1, end - row)))):
                    lists[row + i] = part
            yield pa.record_batch([batch.column("doc_id"), *[batch.column(y) for y in ys], pa.array(lists, pa.list_(pa.int32()))], names=["doc_id", *ys, "words"])

    shaped = sample.mapInArrow(features, "doc_id long, " + "".join(f"{y} double, " for y in ys) + "words array<int>")

    def train(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id").combine_chunks()
        y = np.column_stack([table.column(name).to_numpy(zero_copy_only=False).astype(float) for name in ys])
        words = table.column("words").combine_chunks()
        rows = np.repeat(np.arange(len(words)), np.diff(words.offsets.to_numpy()))
        ids = table.column("doc_id").to_numpy().astype(np.uint64)
        chain = train_chain(rows, words.values.to_numpy(), y, (tw.splitmix(ids) % np.uint64(folds)).astype(int), names, bits)
        return pa.table({"i": pa.array(range(len(names)), pa.int32()), "threshold": chain.thresholds, "weights": [w.astype(np.float32).tobytes() for w in chain.weights]})

    fitted = shaped.groupBy(F.lit(0).alias("all")).applyInArrow(train, "i int, threshold double, weights binary").collect()
    fitted.sort(key=lambda r: r.i)  # one row per category; a distributed sort would sample them first, and so train twice
    if not fitted:
        return Chain(names, [np.zeros(1 + i + (1 << bits)) for i in range(len(names))], [1.1] * len(names), bits)
    return Chain(names, [np.frombuffer(r.weights, np.float32).astype(float) for r in fitted], [r.threshold for r in fitted], bits)


def score_documents(docs: DataFrame, chain: Chain, key: str = "doc_id") -> DataFrame:
    """(key, p_<category>…, <category>…) per row: probability and decision of each category.

    A null or empty text has no words and is scored by the biases alone. Repeated rows get equal scores.
    The weights, of fixed size, are broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            p = np.zeros((batch.num_rows, len(model.names)))
            for row, end, r, c in word_features(batch.column(1), model.bits):
                p[row:end] = model.probabilities(r, c, end - row)
            columns = [pa.array(p[:, i]) for i in range(len(model.names))] + [pa.array(p[:, i] >= t) for i, t in enumerate(model.thresholds)]
            yield pa.record_batch([batch.column(0), *columns], names=[key, *[f"p_{n}" for n in model.names], *model.names])

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}" + "".join(f", p_{n} double" for n in chain.names) + "".join(f", {n} boolean" for n in chain.names)
    return docs.select(key, "text").mapInArrow(run, schema)


def drop_flagged(docs: DataFrame, chain: Chain, category: str = "toxic") -> DataFrame:
    """The rows of ``docs`` that the chain doesn't put into ``category``, columns unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    which = chain.names.index(category)

    @F.arrow_udf("boolean")
    def flagged(texts: pa.Array) -> pa.Array:
        model = shared.value
        out = np.zeros(len(texts), bool)
        for row, end, r, c in word_features(texts, model.bits):
            out[row:end] = model.probabilities(r, c, end - row)[:, which] >= model.thresholds[which]
        return pa.array(out)

    return docs.filter(~flagged("text"))
