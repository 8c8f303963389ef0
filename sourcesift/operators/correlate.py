"""Joins by position and by value: band joins, as-of chains, values shared between artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcesift.functions.lineage import cut_lineage
from sourcesift.functions.text import rx
from sourcesift.operators.extract import entry_points
from sourcesift.operators.matching import explode_matches
from sourcesift.rules import taint as t

_SALTS = 32


def band_join(left: DataFrame, right: DataFrame, before: int, after: int, how: str = "inner") -> DataFrame:
    """Pairs of one artifact with ``left.pos - before <= right.r_pos <= left.pos + after``.

    Both sides are cut into offset buckets as wide as the band, so the join key is
    (artifact, bucket): a huge artifact spreads over many tasks and no pair outside neighbouring
    buckets is ever formed.
    """
    width = before + after + 1
    wide = left.selectExpr(
        "*", f"explode(sequence(cast(greatest(pos - {before}, 0) div {width} AS int), cast((pos + {after}) div {width} AS int))) AS _bucket"
    )
    keyed = right.selectExpr("*", f"cast(r_pos div {width} AS int) AS _bucket")
    near = (F.col("r_pos") >= F.col("pos") - before) & (F.col("r_pos") <= F.col("pos") + after)
    return wide.join(keyed, ["artifact_id", "_bucket"], how).filter(near).drop("_bucket")


def nearest_entry_point(findings: DataFrame, entries: DataFrame, reach: int = 500) -> DataFrame:
    """The first entry point within ``reach`` characters of each finding (left join)."""
    right = entries.selectExpr("artifact_id", "kind", "pos AS r_pos")
    near = band_join(findings.select("artifact_id", "rule_id", "pos").distinct(), right, reach - 1, reach - 1)
    first = near.groupBy("artifact_id", "rule_id", "pos").agg(F.min(F.struct("r_pos", "kind")).alias("e"))
    return findings.join(first, ["artifact_id", "rule_id", "pos"], "left").selectExpr(
        "artifact_id", "rule_id", "pos", "e.kind AS entry_kind", "e.r_pos AS entry_pos"
    )


def function_starts(df: DataFrame) -> DataFrame:
    """Function starts with name, kind, end of the header and the call they are passed to."""
    hits = explode_matches(df, t.FUNCTION_STARTS, windows={"w": (300, 0)}, line=True)
    order = "CASE rule_id WHEN 'function' THEN 0 WHEN 'arrow' THEN 1 ELSE 2 END"
    rows = hits.selectExpr(
        "artifact_id", "pos AS r_pos", "pos + length(m) AS r_end", "rule_id AS kind", f"{order} AS turn",
        "CASE WHEN g1 = '' THEN 'anonymous' ELSE g1 END AS name",
        f"nullif(regexp_extract(w, {rx(t.CALLER)}, 1), '') AS caller", "line AS r_line",
    )
    first = rows.groupBy("artifact_id", "r_pos").agg(F.min(F.struct("turn", "r_end", "kind", "name", "caller", "r_line")).alias("f"))
    return first.select("artifact_id", "r_pos", "f.r_end", "f.kind", "f.name", "f.caller", "f.r_line")


def _closest_before(points: DataFrame, starts: DataFrame, reach: int) -> DataFrame:
    """As-of join: the last function that starts and whose header ends before each point."""
    near = band_join(points, starts, reach, 0).filter("r_pos < pos AND r_end <= pos")
    best = F.max(F.struct("r_pos", "kind", "name", "caller", "r_line")).alias("f")
    return near.groupBy("artifact_id", "pos").agg(best)


def enclosing_functions(findings: DataFrame, starts: DataFrame, hops: int = 5, reach: int = 1000) -> DataFrame:
    """The chain of functions around each finding, nearest first, up to ``hops`` long.

    Which function encloses which is worked out once for all starts; the chain of a place then follows that
    link table with one equi join per hop instead of repeating the as-of join for every finding.
    """
    starts = cut_lineage(starts)
    resume = starts.selectExpr("artifact_id", "greatest(r_pos - 50, 0) AS pos").distinct()
    links = cut_lineage(
        _closest_before(resume, starts, reach).selectExpr("artifact_id", "pos AS from_pos", "f.*")
    )
    points = cut_lineage(findings.select("artifact_id", "rule_id", "pos").distinct())  # read twice below, found once
    # one row per place with its whole chain: a union of the hops would work out the first ones again for each later one
    chain = _closest_before(points.select("artifact_id", "pos").distinct(), starts, reach).withColumnRenamed("f", "f0")
    link = F.struct("r_pos", "kind", "name", "caller", "r_line")
    for hop in range(1, hops):
        chain = chain.withColumn("from_pos", F.expr(f"CASE WHEN f{hop - 1} IS NOT NULL THEN greatest(f{hop - 1}.r_pos - 50, 0) END"))
        chain = chain.join(links.select("artifact_id", "from_pos", link.alias(f"f{hop}")), ["artifact_id", "from_pos"], "left").drop("from_pos")
    listed = f"filter(array({', '.join(f'f{hop}' for hop in range(hops))}), f -> f IS NOT NULL)"
    rows = points.join(chain.selectExpr("artifact_id", "pos", f"{listed} AS chain"), ["artifact_id", "pos"])
    rows = rows.selectExpr("artifact_id", "rule_id", "pos", "posexplode(chain) AS (hop, f)")
    return rows.selectExpr("artifact_id", "rule_id", "pos", "hop", "f.kind", "f.name", "f.caller", "f.r_line AS line")


def near_source_sink(df: DataFrame, before: int = 100, after: int = 250) -> DataFrame:
    """Taint sources that start within a window around a sink."""
    sinks = explode_matches(df, t.SINKS).selectExpr("artifact_id", "path", "rule_id AS sink_id", "pos")
    sources = explode_matches(df, t.SOURCES).selectExpr("artifact_id", "rule_id AS source_id", "pos AS r_pos")
    return band_join(sinks, sources, before, after).selectExpr(
        "artifact_id", "path", "sink_id", "pos AS sink_pos", "source_id", "r_pos AS source_pos"
    )


def shared_values(findings: DataFrame) -> DataFrame:
    """Values that one rule finds in more than one artifact, with how many and the first path.

    (rule, value, artifact) is made distinct first, so a value repeated everywhere shrinks before
    the second shuffle; only counts and one path are kept, never a list of unbounded length.
    """
    once = findings.groupBy("rule_id", "value", "artifact_id").agg(F.min("path").alias("path"))
    shared = once.groupBy("rule_id", "value").agg(F.count("*").alias("n_artifacts"), F.min("path").alias("first_path"))
    return shared.filter("n_artifacts > 1")


def artifact_links(findings: DataFrame) -> DataFrame:
    """Artifact pairs that share a value, as links to the first artifact with it.

    A value in n artifacts gives n - 1 rows (a star) instead of n * (n - 1) / 2; two artifacts
    share a value exactly when they have the same (rule, value, hub).
    """
    once = findings.groupBy("rule_id", "value", "artifact_id").agg(F.count("*").alias("uses"))
    hubs = once.groupBy("rule_id", "value").agg(F.min("artifact_id").alias("hub_id"), F.count("*").alias("n"))
    # a value may sit in a third of all artifacts, so its rows are salted over several tasks
    hubs = hubs.filter("n > 1").selectExpr("rule_id", "value", "hub_id", f"explode(sequence(0, {_SALTS - 1})) AS salt")
    salted = once.withColumn("salt", F.pmod(F.xxhash64("artifact_id"), F.lit(_SALTS)).cast("int"))
    return salted.join(hubs, ["rule_id", "value", "salt"]).filter("artifact_id != hub_id").selectExpr(
        "rule_id", "value", "hub_id", "artifact_id"
    )
