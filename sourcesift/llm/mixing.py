"""Mixing sources to target weights by Sainte-Laguë apportionment of equal blocks of words.

Targets come from filling sources by weight up to a bound. Seats are given out twice by highest
quotients votes / (2·seats + 1): first words over the sources, then, for each source, blocks of its words
over its shards. The size of a source's blocks follows from its own target alone.
Within a shard of a source the documents stand in a seeded order, the words are cut into equal blocks
and a seeded systematic draw picks as many blocks as the quota says, each at most ``most`` times.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sourcesift.llm.storage import row_key, stored

WORD = r"[^\x20\x09-\x0D]+"


def sainte_lague(votes: np.ndarray, seats: int, caps: np.ndarray | None = None) -> np.ndarray:
    """Integer seats by highest quotients, ties to the earlier one, none above its cap.

    The first seats come from a divisor large enough never to hand out too many; the rest, fewer than
    twice the parties, go one by one to the highest quotient.
    """
    votes = np.asarray(votes, float)
    caps = np.full(len(votes), np.inf) if caps is None else np.asarray(caps, float)
    total, out = votes.sum(), np.zeros(len(votes), np.int64)
    if total <= 0 or seats <= 0:
        return out
    if seats > 2 * len(votes):
        out = np.minimum(np.floor(votes * (seats - len(votes)) / total), caps).astype(np.int64)
    heap = [(-v / (2 * q + 1), i) for i, (v, q, c) in enumerate(zip(votes, out, caps, strict=True)) if v > 0 and q < c]
    heapq.heapify(heap)
    for _ in range(seats - int(out.sum())):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        out[i] += 1
        if out[i] < caps[i]:
            heapq.heappush(heap, (-votes[i] / (2 * out[i] + 1), i))
    return out


def fill_targets(sizes: np.ndarray, weights: np.ndarray, total: float, most: float) -> np.ndarray:
    """Shares of ``total`` by weight, none above ``most`` times its size; the excess goes to the others."""
    caps = most * np.asarray(sizes, float)
    order = np.argsort(caps / weights, kind="stable")
    out, left, weight = np.zeros(len(caps)), float(total), float(np.sum(weights))
    for i in order:
        out[i] = min(caps[i], left * weights[i] / weight)
        left, weight = left - out[i], weight - weights[i]
    return out


def mix_sources(
    docs: DataFrame, weights: tuple = (3, 1, 2), share: float = 1.5, most: int = 2,
    block_words: int = 256, shard_words: int = 1 << 17, seed: int = 20240501,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) per row of ``docs``.

    Sources in code point order, null last, take the weights in turn. Blocks hold at most
    ``block_words`` words, fewer for small sources, so that a source's target has about 32,768 blocks at least,
    or blocks of one word, whatever the other sources' sizes. A null or
    empty text has size 0 and nothing is taken of it; repeated rows are rows of their own; rows with equal
    doc_id and size are interchangeable. Only doc_id, source and text are read, so other columns may have
    any name. One row per source goes to one task to be ranked and apportioned, never documents.
    """
    return _mixed(docs, weights, share, most, block_words, shard_words, seed).drop("th")


def _mixed(
    docs: DataFrame, weights: tuple = (3, 1, 2), share: float = 1.5, most: int = 2,
    block_words: int = 256, shard_words: int = 1 << 17, seed: int = 20240501,
) -> DataFrame:
    """The columns of ``mix_sources`` and th, the hash of the text; it stands in for a null doc_id."""
    # the word count of a text; a null text has none
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    name = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    sized = stored(docs.select("doc_id", "source", F.xxhash64("text").alias("th"), name.alias("name"), size.alias("size")))
    total, rows = sized.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    shards = int(max(1, -(-(total + rows) // shard_words)))
    known = F.coalesce("doc_id", "th")
    sized = sized.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), known), F.lit(shards)).cast("int"))
    cells = sized.groupBy("name", "shard").agg(F.sum("size").alias("words"))
    sources = cells.groupBy("name").agg(F.sum("words").alias("words"))

    def over_sources(rows: pd.DataFrame) -> pd.DataFrame:
        # "s" sorts after "n", so names are ranked by hand: the null source last
        rows = rows.iloc[sorted(range(len(rows)), key=lambda i: (rows["name"].iloc[i] == "n", rows["name"].iloc[i]))]
        words = rows["words"].to_numpy()
        share_of = np.resize(np.asarray(weights, float), len(rows))
        target = fill_targets(words, share_of, share * words.sum(), most)
        seats = sainte_lague(target, int(round(target.sum())))
        block = np.clip(target // 32768, 1, block_words).astype(np.int64)
        return pd.DataFrame({"name": rows["name"], "source_size": words, "target": target, "seats": seats, "block": block})

    def over_shards(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("shard")
        blocks = -(-rows["words"].to_numpy() // rows["block"].to_numpy())
        picks = round(int(rows["seats"].iloc[0]) * int(blocks.sum()) / max(int(rows["source_size"].iloc[0]), 1))
        quota = sainte_lague(blocks, picks, most * blocks)
        return rows[["name", "shard", "words", "source_size", "target"]].assign(blocks=blocks, quota=quota)

    targets = sources.groupBy(F.lit(0).alias("all")).applyInPandas(
        lambda _, r: over_sources(r[["name", "words"]]), "name string, source_size long, target double, seats long, block long"
    )
    quotas = cells.join(targets, "name").groupBy("name").applyInPandas(
        over_shards, "name string, shard int, words long, source_size long, target double, blocks long, quota long"
    )
    order = W.partitionBy("name", "shard").orderBy(F.xxhash64(F.lit(seed + 1), known, "size"), "doc_id", "size", "th")
    placed = sized.withColumn("stop", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)))
    placed = placed.join(quotas, ["name", "shard"])
    begin, extra = "(j * words) div blocks", "quota % blocks"
    offset = f"pmod(xxhash64({seed}L, name, shard), blocks)"
    times = f"(quota div blocks + ((j + 1 + {offset}) * ({extra})) div blocks - ((j + {offset}) * ({extra})) div blocks)"
    overlap = "(least(stop, ((j + 1) * words) div blocks) - greatest(stop - size, " + begin + "))"
    at = "((({x}) + 1) * blocks - 1) div words"
    spans = f"sequence({at.format(x='stop - size')}, {at.format(x='stop - 1')})"
    taken = f"CASE WHEN size = 0 THEN 0L ELSE aggregate({spans}, 0L, (sum, j) -> sum + {times} * {overlap}) END"
    return placed.selectExpr("doc_id", "source", "size", "source_size", "target", f"{taken} AS taken", "th")


def mixed_documents(docs: DataFrame, seed: int = 20240502, **options) -> DataFrame:
    """The mix as whole documents: each row as often as its taken words ask for.

    The fraction left over after whole copies is rounded by a seeded draw over doc_id and text, so sources
    keep their shares. Rows of equal doc_id, source and text are rounded together and share their copies as
    evenly as whole copies can be. A null doc_id or source is a key like any other. Columns are those of
    ``docs``, none of them a map.
    """
    source = {"_source": F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))}
    keys, lanes = row_key(), 16
    key = [*keys, *source]
    draw = F.pmod(F.xxhash64(F.lit(seed), "_null", "_id", "_text"), F.lit(1 << 20)) / float(1 << 20)
    taken = _mixed(docs, **options).withColumns({**keys, **source, "_text": F.col("th")})
    wanted = taken.groupBy(*key).agg(F.sum("taken").alias("taken"), F.first("size").alias("size"), F.count("*").alias("_rows"))
    copies = F.floor(F.col("taken") / F.greatest("size", F.lit(1)) + draw).cast("int")
    wanted = stored(wanted.select(*key, "_rows", copies.alias("_copies")).filter("_copies > 0"))
    rows = docs.withColumns({**keys, **source})
    alone = rows.join(wanted.filter("_rows = 1"), key).select(*docs.columns, "_copies")
    # equal rows go to lanes and are counted, so no key gathers its rows in one task
    again = wanted.filter("_rows > 1").withColumn("_lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    again = rows.withColumn("_lane", F.pmod(F.monotonically_increasing_id(), F.lit(lanes)).cast("int")).join(again, [*key, "_lane"])
    again = again.groupBy(*key, "_rows", "_copies", *docs.columns).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(W.partitionBy(*key).orderBy(*docs.columns).rowsBetween(W.unboundedPreceding, 0))
    again = again.withColumn("_upto", upto).selectExpr(*[f"`{c}`" for c in docs.columns], "CAST(_copies * _upto div _rows - _copies * (_upto - _n) div _rows AS int) AS _copies")
    out = alone.unionByName(again.filter("_copies > 0"))
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).select(*docs.columns)
