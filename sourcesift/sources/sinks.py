"""Findings as JSON, SARIF rows, annotation lines and graph text, and the writers for them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The level names the formats define.
SARIF_LEVEL = "CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END"
ANNOTATION_LEVEL = "CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' WHEN 'low' THEN 'warning' ELSE 'notice' END"


def findings_json(findings: DataFrame) -> DataFrame:
    """One JSON document per finding."""
    return findings.selectExpr(
        "artifact_id", "pos", "rule_id",
        "to_json(struct(path AS file, rule_id AS rule, category, severity, value, pos, line)) AS json",
    )


def scan_metadata(artifacts: DataFrame, findings: DataFrame) -> DataFrame:
    """The head of a report per artifact: size and number of findings, zero included."""
    totals = findings.groupBy("artifact_id").agg(F.count("*").alias("total"))
    head = artifacts.selectExpr("artifact_id", "path AS filename", "cast(octet_length(src) AS bigint) AS size")
    return head.join(totals, "artifact_id", "left").selectExpr("artifact_id", "filename", "size", "coalesce(total, 0L) AS total")


def report_lines(artifacts: DataFrame, findings: DataFrame) -> DataFrame:
    """The lines of one JSON document per artifact: head, findings (most severe first), total.

    ``section`` and ``no`` order the lines. No list of findings is ever built: lines are numbered as they stream by, and counted
    by a window that may spill.
    """
    # heads and findings go to their artifact in one shuffle, so that the findings are worked out once
    finding = "struct(rule_id AS rule, category, severity, value, context, description, cwe, pos, line)"
    kind = findings.selectExpr(f"{finding} AS finding").schema["finding"].dataType.simpleString()
    heads = artifacts.selectExpr("artifact_id", "0 AS section", "path AS filename", "cast(octet_length(src) AS bigint) AS size", f"cast(NULL AS {kind}) AS finding")
    rows = findings.selectExpr("artifact_id", "1 AS section", "cast(NULL AS string) AS filename", "cast(NULL AS bigint) AS size", f"{finding} AS finding")
    order = [F.expr(_RANK.replace("severity", "finding.severity", 1)), "finding.pos", "finding.rule", "finding.value"]
    both = heads.unionByName(rows).withColumn("no", F.row_number().over(W.partitionBy("artifact_id", "section").orderBy(*order)))
    # an artifact without an id has no findings of its own
    both = both.withColumn("total", F.expr("CASE WHEN artifact_id IS NULL THEN 0L ELSE count_if(section = 1) OVER (PARTITION BY artifact_id) END"))
    line = """inline(CASE WHEN section = 1 THEN array(
        struct(1 AS section, no, concat(CASE WHEN no > 1 THEN ',' ELSE '' END, to_json(finding)) AS line)) ELSE array(
        struct(0 AS section, 0 AS no, concat('{"metadata":', to_json(struct(filename, size, total)), ',"findings":[') AS line),
        struct(2 AS section, 0 AS no, concat('],"total":', total, '}') AS line)) END)"""
    return both.selectExpr("artifact_id", line)


def write_reports(artifacts: DataFrame, findings: DataFrame, target: str) -> None:
    """One document per artifact, in a folder ``artifact_id=...`` of its own.

    A document is one file, so one task writes it, line by line from an external sort.
    """
    # by a hash: the parts of the union are each spread by artifact_id already, and a repartition by it is left out
    lines = report_lines(artifacts, findings).repartition(F.xxhash64("artifact_id")).sortWithinPartitions("artifact_id", "section", "no")
    lines.select("artifact_id", F.col("line").alias("value")).write.partitionBy("artifact_id").text(target)


_RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END"


def sarif_rules(findings: DataFrame) -> DataFrame:
    """Each rule once, with its index, text and weakness. There are as many rows as rules, whatever the findings."""
    rules = findings.groupBy("rule_id").agg(
        F.min("category").alias("category"),
        F.min(F.struct(F.expr(_RANK).alias("r"), "severity")).getField("severity").alias("severity"),
        *(F.min(c).alias(c) for c in ("description", "cwe") if c in findings.columns),
    )
    for c in ("description", "cwe"):
        if c not in rules.columns:
            rules = rules.withColumn(c, F.lit(""))
    index = (F.dense_rank().over(W.orderBy("rule_id")) - 1).alias("rule_index")
    text = F.coalesce(F.nullif("description", F.lit("")), "category").alias("text")
    return rules.select(index, "rule_id", "category", F.expr(SARIF_LEVEL).alias("level"), text, F.nullif("cwe", F.lit("")).alias("cwe"))


def sarif_rule_json(rules: DataFrame) -> DataFrame:
    """SARIF rule objects as JSON text; a rule with a weakness has a relation to it."""
    weakness = (
        "CASE WHEN cwe IS NOT NULL THEN array(struct(struct(cwe AS id, struct('CWE' AS name) AS toolComponent) AS target, "
        "array('superset') AS kinds)) END"
    )
    return rules.selectExpr(
        "rule_index",
        f"to_json(struct(rule_id AS id, struct(text) AS shortDescription, struct(level) AS defaultConfiguration, {weakness} AS relationships)) AS json",
    )


def sarif_results(findings: DataFrame) -> DataFrame:
    """Result rows with level, own rule index, message, location and snippet."""
    rules = sarif_rules(findings).select("rule_id", "rule_index")
    rows = findings.join(F.broadcast(rules), "rule_id")
    return rows.selectExpr(
        "artifact_id", "path AS uri", "rule_id", "rule_index", f"{SARIF_LEVEL} AS level",
        "concat(category, ': ', substring(value, 1, 200)) AS message", "line AS start_line",
        "substring(context, 1, 100) AS snippet", "pos",
    )


def sarif_json(findings: DataFrame) -> DataFrame:
    """SARIF result objects as JSON text, one per row."""
    return sarif_results(findings).selectExpr(
        "artifact_id",
        "to_json(struct(rule_id AS ruleId, rule_index AS ruleIndex, level, struct(message AS text) AS message, "
        "array(struct(struct(struct(uri) AS artifactLocation, struct(start_line AS startLine, struct(snippet AS text) AS snippet) "
        "AS region) AS physicalLocation)) AS locations)) AS json",
    )


def annotation_lines(findings: DataFrame) -> DataFrame:
    """``::level file=..,title=..::message`` lines for build logs."""
    escaped = "replace(replace({0}, '\"', '\\\\\"'), '\\n', ' ')"
    return findings.selectExpr(
        "artifact_id", "pos",
        f"concat('::', {ANNOTATION_LEVEL}, ' file=', path, ',title=', replace(rule_id, '\"', '\\\\\"'), '::', {escaped.format('value')}) AS line",
    )


def write_json(df: DataFrame, target: str) -> None:
    df.write.json(target)


def write_lines(df: DataFrame, column: str, target: str) -> None:
    """One text line per row."""
    df.select(F.col(column).alias("value")).write.text(target)
