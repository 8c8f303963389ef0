"""A Merkle manifest of a dataset and proofs by descent through its content-addressed records.

Leaves are digests of rows. Per group (a source) the leaves, ordered by key, are folded ``FANOUT`` at a time
until one node remains; the groups' nodes, ordered by group, likewise give the root. What is stored is digest ->
children, in pages: a page holds all records beneath one digest down to ``LEVELS`` levels lower and is found by
that digest. A request for a leaf starts with the root's digest and the digits of its rank: each digit selects
a child, the unselected children are collected, and the collected segments, reversed, are the proof from the leaf
up. Requests below one page go through it together, so the descent is one equi join by digest for each
``LEVELS`` levels and its rows are pages, not leaves; no key of a join is shared by more rows than a page has
children, unless rows themselves are repeated.

Ranks come from a sort by ranges and running sums over its parts, so a group that holds most of the rows is
spread like any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourcesift.llm.storage import stored

FANOUT = 3
#: Levels of one page: at most 3⁶ = 729 children below it.
LEVELS = 6
SPAN = FANOUT**LEVELS


def digest(parts: list[str]) -> str:
    """Lowercase hex sha256 of the digests' hex text, joined."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(columns: list[Column]) -> Column:
    """sha256 over ``<UTF-8 bytes>:<value>`` of each column's text, ``-`` for null."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def fold(nodes: list[str], levels: int) -> tuple[str, list[tuple[str, list[str]]]]:
    """The top digest ``levels`` levels above ``nodes``, and the records digest -> children on the way."""
    records = []
    for _ in range(levels):
        runs = [nodes[i : i + FANOUT] for i in range(0, len(nodes), FANOUT)]
        nodes = [digest(run) for run in runs]
        records += zip(nodes, runs, strict=True)
    if len(nodes) != 1:
        raise ValueError("more nodes than a page has room for")
    return nodes[0], records


def descend(top: str, records: dict[str, list[str]], rank: int, levels: int) -> tuple[str, list[dict]]:
    """From ``top`` by the digits of ``rank``: the node reached, and of each level the place taken and the unselected children."""
    path = []
    for level in range(levels - 1, -1, -1):
        children, place = records[top], rank // FANOUT**level % FANOUT
        path.append({"place": place, "siblings": children[:place] + children[place + 1 :]})
        top = children[place]
    return top, path


def height(n: int) -> int:
    """Levels until one of ``n`` nodes remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def ranked(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``rank`` (from 0, in its group, nulls first, by ``order``) and ``n`` (rows of the group).

    A range sort, a count per part and group, and running sums over these counts; rows that are equal in all
    of ``order`` are ranked by their place in the input.
    """
    keys = [F.col(c).asc_nulls_first() for c in (*group, *order)]
    placed = rows.withColumn("_row", F.monotonically_increasing_id())
    placed = placed.repartitionByRange(*keys, "_row").sortWithinPartitions(*keys, "_row").drop("_row")
    placed = stored(placed.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))
    parts = placed.groupBy(*group, "_part").agg(F.min("_at").alias("_least"), F.count("*").alias("_n"))
    one = Window.partitionBy(*group)
    before = one.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("n", F.sum("_n").over(one))
    parts = parts.select(*(F.col(g).alias(f"_{g}") for g in group), F.col("_part").alias("_p"), "_least", "_before", "n")
    same = F.col("_part") == F.col("_p")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"_{g}"))
    out = placed.join(parts, same).withColumn("rank", F.col("_before") + F.col("_at") - F.col("_least"))
    return out.select(*rows.columns, "rank", "n")


PAGES = "grp string, page long, n long, height int, top string, records array<struct<node: string, children: array<string>>>"
RECORDS = pa.list_(pa.struct([("node", pa.string()), ("children", pa.list_(pa.string()))]))


def _pages(nodes: DataFrame) -> DataFrame:
    """Pages over (grp, rank, n, node): one for each ``SPAN`` consecutive nodes of a group."""
    own = nodes.groupBy("grp", F.expr(f"rank div {SPAN}").alias("page"), "n").agg(F.sort_array(F.collect_list(F.struct("rank", "node"))).alias("nodes"))
    own = own.select("grp", "page", "n", F.col("nodes.node").alias("nodes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                levels = min(LEVELS, height(row["n"]))
                top, records = fold(row["nodes"], levels)
                yield pa.record_batch(
                    [pa.array([row["grp"]], pa.string()), pa.array([row["page"]], pa.int64()), pa.array([row["n"]], pa.int64()), pa.array([levels], pa.int32()), pa.array([top], pa.string()), pa.array([[{"node": d, "children": c} for d, c in records]], RECORDS)],
                    names=["grp", "page", "n", "height", "top", "records"],
                )

    return own.mapInArrow(run, PAGES)


def _tree(nodes: DataFrame) -> list[DataFrame]:
    """Stored tables of pages over (grp, rank, n, node), from the lowest up; the last one has one page for each group."""
    tables = []
    while True:
        tables.append(stored(_pages(nodes)))
        if not tables[-1].filter(f"n > {SPAN}").limit(1).count():
            return tables
        # groups that are done go along as single nodes, which are their own top
        nodes = tables[-1].select("grp", F.col("page").alias("rank"), F.expr(f"(n + {SPAN - 1}) div {SPAN}").alias("n"), F.col("top").alias("node"))


@dataclass
class Manifest:
    """``leaves``: grp, rank, n, leaf, row. ``groups``: grp, place, subroot. Pages of the groups' trees (``lower``) and of the
    tree over them (``upper``), from the lowest up. ``root`` is None for an empty table."""

    leaves: DataFrame
    groups: DataFrame
    lower: list[DataFrame]
    upper: list[DataFrame]
    root: str | None


def build_manifest(docs: DataFrame, columns: list[str], group: str, key: str, carry: dict[str, Column]) -> Manifest:
    """Manifest of all rows of ``docs``; a leaf is the digest of ``columns``, the columns of ``carry`` come along with it.

    Groups are ordered by the text of ``group`` (null first, then by UTF-8 bytes), leaves of a group by ``key`` (null
    first), then by digest; repeated rows are leaves of their own. Columns not named play no part.
    """
    row = F.struct(*(c.alias(name) for name, c in carry.items()))
    rows = docs.select(F.col(group).cast("string").alias("grp"), F.col(key).alias("key"), leaf_digest([F.col(c) for c in columns]).alias("leaf"), row.alias("row"))
    leaves = stored(ranked(rows, ["grp"], ["key", "leaf"]).drop("key"))
    lower = _tree(leaves.select("grp", "rank", "n", F.col("leaf").alias("node")))
    groups = stored(ranked(lower[-1].select("grp", F.col("top").alias("subroot")), [], ["grp"]).withColumnRenamed("rank", "place"))
    upper = _tree(groups.select(F.lit(None).cast("string").alias("grp"), F.col("place").alias("rank"), "n", F.col("subroot").alias("node")))
    top = upper[-1].select("top").first()
    return Manifest(leaves, groups.drop("n"), lower, upper, top[0] if top else None)


STEPS = pa.list_(pa.struct([("place", pa.int32()), ("siblings", pa.list_(pa.string()))]))
STEPS_DDL = "array<struct<place: int, siblings: array<string>>>"


def _descended(state: DataFrame, pages: DataFrame, asked: DataFrame) -> DataFrame:
    """One join by digest. ``state`` (grp, page, node, path) says which page is whose, and how it was reached from the root;
    ``asked`` (grp, rank, more columns) are requests for what lies below. Returns them with ``reached`` and ``path``."""
    more = [c for c in asked.columns if c not in ("grp", "rank")]
    wanted = asked.groupBy(F.col("grp").alias("g"), F.expr(f"rank div {SPAN}").alias("p")).agg(F.collect_list(F.struct("rank", *more)).alias("requests"))
    content = pages.select("top", "height", "records").dropDuplicates(["top"])
    met = wanted.join(state, F.col("g").eqNullSafe(F.col("grp")) & (F.col("p") == F.col("page")))
    met = met.join(content, F.col("node") == F.col("top")).select("grp", "node", "path", "height", "records", "requests")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                row = one.select(["grp", "node", "path", "height", "records"]).to_pylist()[0]
                requests = one.column("requests").flatten()
                records = {r["node"]: r["children"] for r in row["records"]}
                ranks = requests.field("rank")
                found = [descend(row["node"], records, rank % SPAN, row["height"]) for rank in ranks.to_pylist()]
                yield pa.record_batch(
                    [pa.array([row["grp"]] * len(found), pa.string()), ranks, *(requests.field(c) for c in more), pa.array([node for node, _ in found], pa.string()), pa.array([row["path"] + path for _, path in found], STEPS)],
                    names=["grp", "rank", *more, "reached", "path"],
                )

    kept = "".join(f", `{c}` {asked.schema[c].dataType.simpleString()}" for c in more)
    return met.mapInArrow(run, f"grp string, rank long{kept}, reached string, path {STEPS_DDL}")


def proofs(manifest: Manifest, wanted: DataFrame | None = None) -> DataFrame:
    """The manifest's leaves, or those with (grp, rank) in ``wanted``, each with its proof; see :class:`Manifest`.

    Returns grp, rank, leaf, row, reached (the digest the descent ends at), subroot and ``proof``: from the leaf's own run
    up to the root's, the leaf's place in the run and the other members from left to right. Repeated rows of
    ``wanted`` count once, ranks that do not exist have no proof.
    """
    leaves = manifest.leaves.drop("n")
    if wanted is not None:
        chosen = wanted.select(F.col("grp").alias("g"), F.col("rank").alias("r")).distinct()
        leaves = leaves.join(chosen, F.col("grp").eqNullSafe(F.col("g")) & (F.col("rank") == F.col("r")), "left_semi")
    groups = manifest.groups
    # requests for pages, from those of the leaves up
    asked = [leaves]
    for _ in manifest.lower[1:]:
        asked.append(asked[-1].select("grp", F.expr(f"rank div {SPAN}").alias("rank")).distinct())
    places = groups if wanted is None else groups.join(leaves.select(F.col("grp").alias("g")).distinct(), F.col("grp").eqNullSafe(F.col("g")), "left_semi")
    above = [places.select(F.lit(None).cast("string").alias("grp"), F.col("place").alias("rank"))]
    for _ in manifest.upper[1:]:
        above.append(above[-1].select("grp", F.expr(f"rank div {SPAN}").alias("rank")).distinct())
    spark = leaves.sparkSession
    root = [] if manifest.root is None else [(None, 0, manifest.root, [])]
    state = spark.createDataFrame(root, f"grp string, page long, node string, path {STEPS_DDL}")

    def down(state: DataFrame, tables: list[DataFrame], asked: list[DataFrame]) -> DataFrame:
        for pages, requests in zip(tables[:0:-1], asked[:0:-1], strict=True):
            state = _descended(state, pages, requests).select("grp", F.col("rank").alias("page"), F.col("reached").alias("node"), "path")
        return _descended(state, tables[0], asked[0])

    found = down(state, manifest.upper, above).select(F.col("rank").alias("place"), "reached", "path")
    state = groups.join(found, "place").select("grp", F.lit(0).cast("long").alias("page"), F.col("reached").alias("node"), "path")
    out = down(state, manifest.lower, asked)
    out = out.join(groups.select(F.col("grp").alias("g"), "subroot"), F.col("grp").eqNullSafe(F.col("g")))
    return out.select("grp", "rank", "leaf", "row", "reached", "subroot", F.reverse("path").alias("proof"))


def climbed(node: Column, proof: Column) -> Column:
    """The root that ``node`` leads to with the siblings of ``proof``."""

    def up(below: Column, step: Column) -> Column:
        others, place = step["siblings"], step["place"]
        left = F.array_join(F.slice(others, F.lit(1), place), "")
        right = F.array_join(F.slice(others, place + 1, F.greatest(F.size(others) - place, F.lit(0))), "")
        return F.sha2(F.concat(left, below, right), 256)

    return F.aggregate(proof, node, up)


def proof_digest(proof: Column) -> Column:
    """sha256 of all siblings of a proof, joined."""
    return F.sha2(F.array_join(F.flatten(F.transform(proof, lambda step: step["siblings"])), ""), 256)
