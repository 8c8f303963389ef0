"""Shards of near-equal bytes: a minimax contiguous partition of ordered atomic groups.

Rows of equal text are one group and never part. Groups are ordered by the hash of their text and
gathered, in that order, into at most ``units`` atomic units; that many sizes go into one array, whatever the
input's size. The smallest feasible capacity is found by binary search with a greedy check, and the
cuts are made within it as evenly as it allows. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sourcesift.llm.storage import stored


def cut_units(sizes: DataFrame, shards: int) -> DataFrame:
    """(unit, bytes) -> (unit, shard), contiguous in unit order, with the least possible largest shard."""
    one = sizes.agg(F.array_sort(F.collect_list(F.struct("unit", "bytes"))).alias("u")).selectExpr("u", "transform(u, x -> x.bytes) AS s")
    one = one.selectExpr("u", "s", "aggregate(s, 0L, (a, x) -> a + x) AS total", "coalesce(array_max(s), 0L) AS largest")
    used = "named_struct('n', 1L, 'used', 0L)"
    mid = "((b.lo + b.hi) div 2)"
    need = f"aggregate(s, {used}, (a, x) -> IF(a.used + x > {mid}, named_struct('n', a.n + 1L, 'used', x), named_struct('n', a.n, 'used', a.used + x))).n"
    search = (
        f"aggregate(sequence(1, 63), named_struct('lo', greatest(largest, (total + {shards - 1}L) div {shards}L), 'hi', greatest(total, 1L)), "
        f"(b, i) -> CASE WHEN b.lo >= b.hi THEN b WHEN {need} <= {shards} "
        f"THEN named_struct('lo', b.lo, 'hi', {mid}) ELSE named_struct('lo', {mid} + 1L, 'hi', b.hi) END).lo"
    )
    one = one.selectExpr("u", "s", "total", f"{search} AS cap")
    # how many shards the units from each one to the last need
    tail = (
        "aggregate(reverse(s), named_struct('n', 1L, 'used', 0L, 'out', cast(array() AS array<bigint>)), (a, x) -> "
        "IF(a.used + x > cap, named_struct('n', a.n + 1L, 'used', x, 'out', array_append(a.out, a.n + 1L)), "
        "named_struct('n', a.n, 'used', a.used + x, 'out', array_append(a.out, a.n))), a -> reverse(a.out))"
    )
    one = one.selectExpr("u", "total", "cap", f"zip_with(s, {tail}, (bytes, need) -> named_struct('x', bytes, 'need', need)) AS s")
    new = (
        f"a.used > 0 AND (a.used + x.x > cap OR (a.shard < {shards - 1} AND x.need <= {shards - 1} - a.shard "
        f"AND a.used + x.x / 2 >= a.left / ({shards} - a.shard)))"
    )
    cuts = (
        "aggregate(s, named_struct('shard', 0, 'used', 0L, 'left', total, 'out', cast(array() AS array<int>)), (a, x) -> "
        f"IF({new}, named_struct('shard', a.shard + 1, 'used', x.x, 'left', a.left - a.used, 'out', array_append(a.out, a.shard + 1)), "
        "named_struct('shard', a.shard, 'used', a.used + x.x, 'left', a.left, 'out', array_append(a.out, a.shard))), a -> a.out)"
    )
    return one.selectExpr(f"inline(zip_with(u, {cuts}, (u, shard) -> named_struct('unit', u.unit, 'shard', shard)))")


def shard_documents(docs: DataFrame, shards: int = 40, units: int = 8192, lanes: int = 32) -> DataFrame:
    """``docs`` plus nothing of its own: (doc_id, size, text_crc32, law, shard, slot, grown_shard).

    Size is the text's UTF-8 bytes plus 16; null counts as empty and goes with the empty texts. Slots number
    a shard's rows from 0 without a gap; rows of equal doc_id and text may swap slots. An empty table gives an
    empty result. Numbering runs in ``lanes`` lanes per unit, so a large group of copies spreads over
    tasks. The table of cuts has at most ``units`` rows and is broadcast.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(text), F.lit(units)).cast("int").alias("unit"), F.pmod(F.xxhash64("doc_id"), F.lit(lanes)).cast("int").alias("lane"),
    )
    rows = stored(rows)
    cells = rows.groupBy("unit", "lane").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    cuts = stored(cut_units(cells.groupBy("unit").agg(F.sum("bytes").alias("bytes")), shards))
    before = W.partitionBy("shard").orderBy("unit", "lane").rowsBetween(W.unboundedPreceding, -1)
    offsets = cells.join(F.broadcast(cuts), "unit").select("unit", "lane", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = W.partitionBy("unit", "lane").orderBy("doc_id", "text_crc32", "size")
    out = rows.withColumn("place", F.row_number().over(within)).join(offsets, ["unit", "lane"])
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("offset") + F.col("place") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
