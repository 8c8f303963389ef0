"""What happens to findings: suppression, configuration, scores, counts and report rows."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sourcesift.functions.lineage import written
from sourcesift.functions.text import has, local_table, quote, rx
from sourcesift.operators import graph
from sourcesift.operators.extract import DEPENDENCY_RULES, endpoints_of, hidden_of, unguarded_of, versions_of, vulnerable_dependencies
from sourcesift.operators.matching import Raw, explode_matches, findings_of, match_table, raw_of, scan_rules, severity_rank, severity_weight
from sourcesift.operators.normalise import normalise, normalise_with_literals
from sourcesift.operators.taint import FALLBACK_WINDOWS, fallback_of, flows_of, numbered, with_fallback
from sourcesift.rules import extended
from sourcesift.rules import extraction as x
from sourcesift.rules import surface as s
from sourcesift.rules import taint as t
from sourcesift.rules.levels import DEFAULT_LEVELS
from sourcesift.rules.model import SEVERITIES
from sourcesift.rules.packs import FAST_PACKS, PACKS
from sourcesift.rules.surface import spec

FINDING = ["artifact_id", "path", "rule_id", "category", "severity", "value", "context", "pos", "line"]
# The packs a whole scan runs; the others are asked for by name.
WIRED = [
    "credentials", "security", "dynamic_code", "business_logic", "websocket", "crypto_context",
    "info_leakage", "idor", "web3", "config_flags", "lazy_loading",
]


def scan_packs(df: DataFrame, names: list[str]) -> DataFrame:
    """Several packs in one pass over the text."""
    return scan_rules(df, [r for n in names for r in PACKS[n]]).select(*FINDING)


_LEADS = " OR ".join(f"(({' OR '.join(has('src', g) for g in r.gate)}) AND src RLIKE {rx(r.pattern)})" for r in t.SOURCES)

_SIGNS = " OR ".join(f"contains(src, {quote(sign.replace(chr(92), ''))})" for sign in extended.SERVICE_WORKER_SIGNS.split("|"))


def scan_table(df: DataFrame, marker: str = "scan-ignore") -> DataFrame:
    """Everything a whole scan reads off the texts, as narrow rows written once.

    The texts are normalised, their literals decoded, and then read in one pass for the rule packs and for
    the matches that taint flows, dependencies, routes and suppressions are worked out from. Assignments and
    sinks are looked for only where a taint source occurs. The corpus itself is never written.
    """
    packs = {**{n: PACKS[n] for n in WIRED}, "race": extended.RACE, "service_worker": extended.SERVICE_WORKER}
    raws = [
        Raw("taint", tuple(t.SOURCES), before=300), Raw("assignments", tuple(t.ASSIGNMENTS), before=20, only="_leads"),
        Raw("sinks", tuple(t.SINKS), before=100, after=250, only="_leads"),
        Raw("near_sources", tuple(s.FALLBACK_SOURCES), before=FALLBACK_WINDOWS["sources"][0]),
        Raw("near_sinks", tuple(s.FALLBACK_SINKS), *FALLBACK_WINDOWS["sinks"]),
        Raw("dependencies", tuple(DEPENDENCY_RULES)), Raw("suppressions", tuple(suppression_rules(marker))),
        Raw("any_route", tuple(x.ANY_ROUTE)), Raw("guarded_route", tuple(x.GUARDED_ROUTE)), Raw("endpoints", tuple(x.ENDPOINT), before=300, after=50),
    ]
    texts = normalise_with_literals(df).selectExpr("*", f"{_LEADS} AS _leads", f"{_SIGNS} AS _signs")
    return written(numbered(match_table(texts, packs, raws, only={"service_worker": "_signs"}, literals="literals")))


class WholeScan:
    """A scan of a corpus from its findings to its report, all read from one match table and one table of modules.

    ``findings`` are those of every scanner, ``kept`` and ``suppressed`` what comments leave of them, ``breakdown`` and
    ``scores`` the attack surface, ``report`` one row per artifact. Two jobs read the texts, when the object
    is made: one for the matches, one for the modules of bundles, which are taken from the texts as they are.
    """

    def __init__(self, df: DataFrame, marker: str = "scan-ignore", steps: Sequence[str] | None = None) -> None:
        self.artifacts, self.marker, self.steps = df, marker, list(STEPS if steps is None else steps)
        self.table = scan_table(df, marker)
        self.modules = written(graph.module_facts(graph.placed_modules(df)))

    def raw(self, name: str) -> DataFrame:
        return raw_of(self.table, name)

    @cached_property
    def findings(self) -> DataFrame:
        """What the registered steps find; those named when the scan was made, or all."""
        parts = [STEPS[name](self).select(*FINDING) for name in self.steps]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    @cached_property
    def _written(self) -> DataFrame:
        """The findings, written for the parts of a report that each read them."""
        return written(self.findings)

    @property
    def suppressions(self) -> DataFrame:
        return suppressions_of(self.raw("suppressions"))

    @property
    def kept(self) -> DataFrame:
        return suppress_findings(self._written, self.suppressions)

    @property
    def suppressed(self) -> DataFrame:
        return suppressed_findings(self._written, self.suppressions, self.marker)

    @property
    def breakdown(self) -> DataFrame:
        return surface_breakdown(
            self._written, unguarded_of(self.raw("any_route"), self.raw("guarded_route")), endpoints_of(self.raw("endpoints")),
            hidden_of(self.raw("literals").selectExpr("artifact_id", "path", "m AS value", "pos")),
        )

    @property
    def scores(self) -> DataFrame:
        return attack_surface_score(self.breakdown)

    @property
    def report(self) -> DataFrame:
        """Per artifact: size, findings kept and suppressed, score and risk; zeros included."""
        head = self.artifacts.selectExpr("artifact_id", "path AS filename", "cast(octet_length(src) AS bigint) AS size")
        counts = [self.kept.groupBy("artifact_id").agg(F.count("*").alias("total")), self.suppressed.groupBy("artifact_id").agg(F.count("*").alias("suppressed")), self.scores]
        for more in counts:
            head = head.join(more, "artifact_id", "left")
        return head.selectExpr("artifact_id", "filename", "size", "coalesce(total, 0L) AS total", "coalesce(suppressed, 0L) AS suppressed", "coalesce(score, 0L) AS score", "coalesce(risk, 'LOW') AS risk")


#: What a whole scan is made of: name -> step from the scan (its texts, match table and modules) to findings.
STEPS: dict[str, Callable[[WholeScan], DataFrame]] = {}


def register_step(name: str, step: Callable[[WholeScan], DataFrame]) -> None:
    """Add a step to every whole scan made from now on. It returns rows with the columns ``FINDING``."""
    STEPS[name] = step


def _pack_step(*packs: str) -> Callable[[WholeScan], DataFrame]:
    return lambda scan: findings_of(scan.table, packs=packs)


def _taint_step(scan: WholeScan) -> DataFrame:
    hits = scan.table.filter(F.col("grp").isin("taint", "assignments", "sinks"))
    hits = hits.selectExpr("*", "before AS w", "before AS near", "before AS b", "after AS a")
    fallback = fallback_of(scan.raw("near_sources"), scan.raw("near_sinks"))
    return with_fallback(flows_of(hits), fallback).withColumn("category", F.lit("Taint Flow"))


register_step("packs", _pack_step(*WIRED))
register_step("race", _pack_step("race"))
register_step("service_worker", _pack_step("service_worker"))
register_step("dependencies", lambda scan: vulnerable_dependencies(versions_of(scan.raw("dependencies"))))
register_step("taint", _taint_step)
register_step("modules", lambda scan: graph.findings_of_facts(scan.modules).withColumn("category", F.lit("Module Graph")))


def full_scan(df: DataFrame, fast: bool = False) -> DataFrame:
    """Every scanner that a whole scan runs, over normalised texts; ``fast`` keeps the two main packs."""
    if fast:
        return scan_packs(normalise(df), list(FAST_PACKS))
    return WholeScan(df).findings


def suppression_rules(marker: str = "scan-ignore"):
    m = re.escape(marker)
    return [
        spec("line", rf"(?i)//[ \t]*{m}:[ \t]*(.+)", (marker,), 1),
        spec("next", rf"(?i)//[ \t]*{m}-next-line:[ \t]*(.+)", (marker,), 1),
        spec("block", rf"(?i)/\*[ \t]*{m}:[ \t]*(.+?)[ \t]*\*/", (marker,), 1),
    ]


def suppression_rows(df: DataFrame, marker: str = "scan-ignore") -> DataFrame:
    """(line, rule, reason) of suppression comments: lists, ``all``, block and next-line forms."""
    return suppressions_of(explode_matches(df, suppression_rules(marker), line=True))


def suppressions_of(hits: DataFrame) -> DataFrame:
    """Suppressions from the matches of :func:`suppression_rules`."""
    target = "line + CASE WHEN rule_id = 'next' OR (rule_id = 'line' AND contains(lower(g1), 'next-line')) THEN 1 ELSE 0 END"
    rows = hits.selectExpr("artifact_id", f"{target} AS line", "pos", "posexplode(split(g1, ',')) AS (i, entry)")
    rows = rows.selectExpr(
        "artifact_id", "line", "pos", "i",
        "lower(regexp_extract(trim(entry), '^[^ \\\\t]*', 0)) AS rule_id",
        "regexp_replace(trim(regexp_replace(trim(entry), '^[^ \\\\t]*', '')), '[ \\\\t]+', ' ') AS reason",
    ).filter("rule_id NOT IN ('', 'next-line')")
    last = F.max(F.struct(F.col("reason") != "", "pos", "i", "reason")).getField("reason")
    return rows.groupBy("artifact_id", "line", "rule_id").agg(last.alias("reason"))


def suppress_findings(findings: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Findings that no comment on their line suppresses."""
    # two equi anti joins: an OR in one join would compare every pair on a minified line
    everything = suppressions.filter("rule_id = 'all'").select("artifact_id", "line")
    named = suppressions.selectExpr("artifact_id", "line", "rule_id AS hidden_rule")
    kept = findings.join(everything, ["artifact_id", "line"], "left_anti")
    kept = kept.withColumn("hidden_rule", F.lower("rule_id"))
    return kept.join(named, ["artifact_id", "line", "hidden_rule"], "left_anti").select(*findings.columns)


def suppressed_findings(findings: DataFrame, suppressions: DataFrame, marker: str = "scan-ignore") -> DataFrame:
    """The suppressed ones, with the reason; ``all`` speaks before a named rule."""
    keys = ["artifact_id", "line"]
    everything = suppressions.filter("rule_id = 'all'").selectExpr(
        *keys, f"coalesce(nullif(reason, ''), {quote('suppressed by ' + marker + ': all')}) AS reason"
    )
    named = suppressions.selectExpr(
        *keys, "rule_id AS hidden_rule",
        f"coalesce(nullif(reason, ''), {quote('suppressed by ' + marker + ' comment')}) AS named_reason",
    )
    rows = findings.selectExpr(*keys, "rule_id", "pos", "substring(value, 1, 60) AS value", "lower(rule_id) AS hidden_rule")
    both = rows.join(everything, keys, "left").join(named, [*keys, "hidden_rule"], "left")
    return both.selectExpr(
        "artifact_id", "rule_id", "pos", "line", "value", "coalesce(reason, named_reason) AS reason"
    ).filter("reason IS NOT NULL")


def merge_config(base: dict | None, override: dict) -> dict:
    """Layer one configuration over another; without a base, over the default levels."""
    base = base or {"rules": dict(DEFAULT_LEVELS)}
    return {
        "rules": {**base.get("rules", {}), **override.get("rules", {})},
        "severityOverrides": {**base.get("severityOverrides", {}), **override.get("severityOverrides", {})},
        "suppressions": [*base.get("suppressions", []), *override.get("suppressions", [])],
        "output": {**base.get("output", {}), **override.get("output", {})},
    }


def _glob(glob: str) -> str:
    return "^" + "".join("[^\\n]*" if c == "*" else "[^\\n]" if c == "?" else re.escape(c) for c in glob) + "$"


def apply_rule_config(findings: DataFrame, config: dict) -> DataFrame:
    """Switch rules off, override and cap severities, and drop configured (rule, file) pairs.

    The configuration is a small hand-written file, so its rule table is broadcast.
    """
    spark = findings.sparkSession
    names = sorted({*config.get("rules", {}), *config.get("severityOverrides", {})})
    rows = [(n, config.get("rules", {}).get(n), config.get("severityOverrides", {}).get(n)) for n in names]
    table = local_table(spark, rows, "rule_id string, level string, override string")
    out = findings.join(F.broadcast(table), "rule_id", "left").filter("coalesce(level, '') != 'off'")
    base = "coalesce(override, severity)"
    severity = (
        f"CASE level WHEN 'error' THEN CASE WHEN {base} = 'critical' THEN 'critical' ELSE 'high' END "
        f"WHEN 'warn' THEN CASE WHEN {base} IN ('critical', 'high') THEN 'medium' ELSE {base} END "
        f"WHEN 'info' THEN 'info' ELSE {base} END"
    )
    for s in config.get("suppressions", []):
        rule = "true" if s["rule"] == "*" else f"rule_id = {quote(s['rule'])}"
        out = out.filter(f"NOT ({rule} AND path RLIKE {rx(_glob(s.get('file', '*')))})")
    return out.withColumn("severity", F.expr(severity)).select(*findings.columns)


def severity_counts(findings: DataFrame) -> DataFrame:
    """Findings per severity, zeros included."""
    spark = findings.sparkSession
    scale = local_table(spark, [(s, r) for s, (r, _) in SEVERITIES.items()], "severity string, rank int")
    counts = findings.groupBy("severity").agg(F.count("*").alias("n"))
    return scale.join(F.broadcast(counts), "severity", "left").selectExpr("severity", "rank", "coalesce(n, 0) AS findings")


def category_breakdown(findings: DataFrame) -> DataFrame:
    """Weighted points per artifact and category."""
    points = findings.selectExpr("artifact_id", "category", f"{severity_weight()} AS points")
    return points.groupBy("artifact_id", "category").agg(F.sum("points").alias("points"))


def surface_breakdown(findings: DataFrame, unguarded: DataFrame, endpoints: DataFrame, hidden: DataFrame) -> DataFrame:
    """Category points plus 8 per unguarded route, 6 per unprotected endpoint, 4 per hidden route."""
    extra = [
        (unguarded, "Unguarded Routes", 8),
        (endpoints.filter("risk = 'potential-unprotected'"), "Unprotected Endpoints", 6),
        (hidden, "Hidden Routes", 4),
    ]
    out = category_breakdown(findings)
    for rows, name, weight in extra:
        counted = rows.groupBy("artifact_id").agg((F.count("*") * weight).alias("points"))
        out = out.unionByName(counted.selectExpr("artifact_id", f"'{name}' AS category", "points"))
    return out


_RISK = "CASE WHEN score >= 80 THEN 'CRITICAL' WHEN score >= 40 THEN 'HIGH' WHEN score >= 15 THEN 'MEDIUM' ELSE 'LOW' END"


def attack_surface_score(breakdown: DataFrame) -> DataFrame:
    scores = breakdown.groupBy("artifact_id").agg(F.sum("points").alias("score"))
    return scores.withColumn("risk", F.expr(_RISK))


def top_categories(breakdown: DataFrame, top: int = 5) -> DataFrame:
    order = W.partitionBy("artifact_id").orderBy(F.desc("points"), "category")
    return breakdown.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def corpus_score(findings: DataFrame) -> DataFrame:
    total = findings.selectExpr(f"{severity_weight()} AS points").agg(
        F.coalesce(F.sum("points"), F.lit(0)).alias("score"), F.count("*").alias("findings")
    )
    return total.withColumn("risk", F.expr(_RISK))


def corpus_rollup(findings: DataFrame) -> DataFrame:
    return findings.rollup("path", "category", "severity").agg(
        F.count("*").alias("findings"), F.grouping_id().cast("int").alias("level")
    )


def rule_frequency(findings: DataFrame) -> DataFrame:
    """Findings and artifacts per rule; repeats merge per (rule, artifact) before the final count."""
    once = findings.groupBy("rule_id", "artifact_id").agg(F.count("*").alias("n"))
    return once.groupBy("rule_id").agg(F.sum("n").alias("findings"), F.count("*").alias("artifacts"))


def rule_frequency_approx(findings: DataFrame) -> DataFrame:
    return findings.groupBy("rule_id").agg(
        F.count("*").alias("findings"), F.approx_count_distinct("artifact_id", 0.02).alias("artifacts")
    )


def report_rows(findings: DataFrame) -> DataFrame:
    """Per category and in total: findings by severity."""
    cells = [F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES]
    rows = findings.rollup("category").agg(F.count("*").alias("findings"), *cells, F.grouping("category").alias("g"))
    return rows.selectExpr("CASE WHEN g = 1 THEN 'TOTAL' ELSE category END AS category", "findings", *SEVERITIES)


def consolidate_findings(*tables: DataFrame) -> DataFrame:
    """Findings of several tools, counted by severity."""
    out = tables[0].select("severity")
    for more in tables[1:]:
        out = out.unionByName(more.select("severity"))
    return out.groupBy("severity").agg(F.count("*").alias("findings")).withColumn("rank", F.expr(severity_rank()))
