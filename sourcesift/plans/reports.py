"""Queries for suppression, configuration, scores, reports, incremental and streamed scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from sourcesift.functions.dialect import sql_text
from sourcesift.functions.lineage import shared_folder, written
from sourcesift.operators import extract as e
from sourcesift.operators import findings as op
from sourcesift.operators import surface
from sourcesift.operators.matching import order_findings, scan_rules, severity_rank
from sourcesift.plans import oracle as o
from sourcesift.plans.corpora import corpus_sql, mixed_corpus, stream_corpus, table
from sourcesift.plans.extracts import (
    _FIXES, _UNESCAPED, DEPS_CTE, ENDPOINT_CTE, HIDDEN_CTE, HIDDEN_ROWS, OUTDATED, REWRITTEN, UNGUARDED_CTE, decoded_ctes, mixed,
)
from sourcesift.plans.flows import FALLBACK, TAINT
from sourcesift.plans.graphs import CHUNK_CTE, DEGREE_CTE, EDGES_CTE, hot_cte, modules_cte
from sourcesift.plans.registry import add
from sourcesift.plans.scans import NETWORK_CTE, RACE_CTE, _SIGNED
from sourcesift.rules import extended
from sourcesift.rules.levels import DEFAULT_LEVELS
from sourcesift.rules.model import SEVERITIES
from sourcesift.rules.packs import PACKS
from sourcesift.sources import incremental, sinks
from sourcesift.sources.corpus import read_table_corpus
from sourcesift.streaming import scan as streaming

MAIN = [r for n in op.FAST_PACKS for r in PACKS[n]]
MAIN_CTE = o.scan_cte(MAIN)


def main_findings(spark, sf):
    return op.scan_packs(mixed_corpus(spark, sf), list(op.FAST_PACKS))


def suppressions(spark, sf):
    """Suppression comments, written as each of two joins reads them."""
    return written(op.suppression_rows(mixed_corpus(spark, sf)))


RANK = "CASE severity " + " ".join(f"WHEN '{s}' THEN {r}" for s, (r, _) in SEVERITIES.items()) + " END"
WEIGHT = "CASE severity " + " ".join(f"WHEN '{s}' THEN {w}" for s, (_, w) in SEVERITIES.items()) + " ELSE 0 END"
RISK = "CASE WHEN score >= 80 THEN 'CRITICAL' WHEN score >= 40 THEN 'HIGH' WHEN score >= 15 THEN 'MEDIUM' ELSE 'LOW' END"

# --- suppression and configuration -----------------------------------------------------------
_SUP = op.suppression_rules()
SUPPRESSION_CTE = (
    o.matches_cte(_SUP, "sh")
    + f""", sl AS (SELECT artifact_id, pos, {o.line()} + CASE WHEN rule_id = 'next' OR (rule_id = 'line' AND contains(lower(g1), 'next-line')) THEN 1 ELSE 0 END AS line, string_split(g1, ',') AS entries FROM sh),
    se AS (SELECT artifact_id, line, pos, i, trim(entries[i]) AS entry FROM (SELECT *, unnest(range(1, len(entries) + 1)) AS i FROM sl)),
    sr AS (SELECT *, lower(regexp_extract(entry, '^[^ \\t]*', 0)) AS rule_id, regexp_replace(trim(regexp_replace(entry, '^[^ \\t]*', '')), '[ \\t]+', ' ', 'g') AS reason FROM se),
    suppressions AS (SELECT artifact_id, line, rule_id, reason FROM sr WHERE rule_id NOT IN ('', 'next-line')
      QUALIFY row_number() OVER (PARTITION BY artifact_id, line, rule_id ORDER BY (reason <> '') DESC, pos DESC, i DESC) = 1)"""
)
add("suppression_rows", lambda spark, sf: op.suppression_rows(mixed_corpus(spark, sf)), mixed(SUPPRESSION_CTE) + " SELECT * FROM suppressions")
add(
    "suppress_findings",
    lambda spark, sf: op.suppress_findings(main_findings(spark, sf), suppressions(spark, sf)).select(
        "artifact_id", "rule_id", "pos", "line", "value"
    ),
    mixed(MAIN_CTE, SUPPRESSION_CTE)
    + """ SELECT artifact_id, rule_id, pos, line, value FROM findings f WHERE NOT EXISTS (SELECT 1 FROM suppressions s
    WHERE s.artifact_id = f.artifact_id AND s.line = f.line AND s.rule_id IN ('all', lower(f.rule_id)))""",
)
add(
    "suppressed_findings",
    lambda spark, sf: op.suppressed_findings(main_findings(spark, sf), suppressions(spark, sf)),
    mixed(MAIN_CTE, SUPPRESSION_CTE)
    + """ SELECT f.artifact_id, f.rule_id, f.pos, f.line, substring(f.value, 1, 60) AS value,
      coalesce(nullif(s.reason, ''), CASE s.rule_id WHEN 'all' THEN 'suppressed by scan-ignore: all' ELSE 'suppressed by scan-ignore comment' END) AS reason
    FROM findings f JOIN suppressions s ON s.artifact_id = f.artifact_id AND s.line = f.line AND s.rule_id IN ('all', lower(f.rule_id))
    QUALIFY row_number() OVER (PARTITION BY f.artifact_id, f.rule_id, f.pos ORDER BY s.rule_id = 'all' DESC) = 1""",
)
CONFIG = {
    "rules": {"storage-local": "off", "xss-eval": "warn"},
    "severityOverrides": {"network-http-open": "high", "hardcoded-email": "critical"},
    "suppressions": [
        {"rule": "pii-email-field", "file": "*", "reason": "form labels"},
        {"rule": "*", "file": "documents/1*.txt", "reason": "archive"},
    ],
}
_MERGED = {**DEFAULT_LEVELS, **CONFIG["rules"]}
_NAMES = sorted({*_MERGED, *CONFIG["severityOverrides"]})
_CONFIG_ROWS = ", ".join(
    f"({sql_text(n)}, {sql_text(_MERGED[n]) if n in _MERGED else 'NULL'}, {sql_text(CONFIG['severityOverrides'][n]) if n in CONFIG['severityOverrides'] else 'NULL'})"
    for n in _NAMES
)
add(
    "apply_rule_config",
    lambda spark, sf: op.apply_rule_config(main_findings(spark, sf), op.merge_config(None, CONFIG)).select(
        "artifact_id", "rule_id", "pos", "severity"
    ),
    mixed(MAIN_CTE, f"config(rule_id, level, override) AS (VALUES {_CONFIG_ROWS})")
    + """, joined AS (SELECT f.*, level, coalesce(override, severity) AS base FROM findings f LEFT JOIN config USING (rule_id))
    SELECT artifact_id, rule_id, pos, CASE level WHEN 'error' THEN CASE WHEN base = 'critical' THEN 'critical' ELSE 'high' END
      WHEN 'warn' THEN CASE WHEN base IN ('critical', 'high') THEN 'medium' ELSE base END WHEN 'info' THEN 'info' ELSE base END AS severity
    FROM joined WHERE coalesce(level, '') <> 'off' AND rule_id <> 'pii-email-field' AND NOT (path LIKE 'documents/1%.txt')""",
)

add(
    "order_findings",
    lambda spark, sf: order_findings(main_findings(spark, sf).select("severity", "artifact_id", "pos", "rule_id")).selectExpr(
        f"{severity_rank()} AS rank", "severity", "artifact_id", "pos", "rule_id"
    ),
    mixed(MAIN_CTE) + f" SELECT {RANK} AS rank, severity, artifact_id, pos, rule_id FROM findings ORDER BY 1, 3, 4, 5",
)

# --- counts and scores -----------------------------------------------------------------------
_SCALE = ", ".join(f"('{s}', {r})" for s, (r, _) in SEVERITIES.items())
add(
    "severity_counts",
    lambda spark, sf: op.severity_counts(main_findings(spark, sf)),
    mixed(MAIN_CTE, f"scale(severity, rank) AS (VALUES {_SCALE})")
    + " SELECT scale.severity, rank, count(f.rule_id) AS findings FROM scale LEFT JOIN findings f USING (severity) GROUP BY 1, 2",
)
BREAKDOWN = f"breakdown AS (SELECT artifact_id, category, CAST(sum({WEIGHT}) AS BIGINT) AS points FROM findings GROUP BY 1, 2)"
add(
    "category_breakdown",
    lambda spark, sf: op.category_breakdown(main_findings(spark, sf)),
    mixed(MAIN_CTE, BREAKDOWN) + " SELECT * FROM breakdown",
)
SURFACE_ROWS = """surface AS (SELECT * FROM breakdown
    UNION ALL SELECT artifact_id, 'Unguarded Routes', CAST(count(*) * 8 AS BIGINT) FROM unguarded GROUP BY 1
    UNION ALL SELECT artifact_id, 'Unprotected Endpoints', CAST(count(*) * 6 AS BIGINT) FROM endpoints WHERE NOT has_auth_header AND NOT has_guard_context GROUP BY 1
    UNION ALL SELECT artifact_id, 'Hidden Routes', CAST(count(*) * 4 AS BIGINT) FROM hidden GROUP BY 1)"""
SURFACE = f"{BREAKDOWN}, {UNGUARDED_CTE}, {ENDPOINT_CTE}, {HIDDEN_CTE}, {SURFACE_ROWS}"


def surface_of(spark, sf):
    df = mixed_corpus(spark, sf)
    return op.surface_breakdown(
        main_findings(spark, sf), e.unguarded_sensitive_routes(df), e.endpoint_protection(df), e.hidden_routes(df)
    )


add(
    "attack_surface_score",
    lambda spark, sf: op.attack_surface_score(surface_of(spark, sf)),
    mixed(MAIN_CTE, SURFACE) + f", s AS (SELECT artifact_id, CAST(sum(points) AS BIGINT) AS score FROM surface GROUP BY 1) SELECT *, {RISK} AS risk FROM s",
)
add(
    "top_categories",
    lambda spark, sf: op.top_categories(surface_of(spark, sf)),
    mixed(MAIN_CTE, SURFACE)
    + " SELECT *, CAST(row_number() OVER (PARTITION BY artifact_id ORDER BY points DESC, category) AS INTEGER) AS rank FROM surface QUALIFY rank <= 5",
)
add(
    "corpus_score",
    lambda spark, sf: op.corpus_score(main_findings(spark, sf)),
    mixed(MAIN_CTE) + f", s AS (SELECT CAST(coalesce(sum({WEIGHT}), 0) AS BIGINT) AS score, count(*) AS findings FROM findings) SELECT *, {RISK} AS risk FROM s",
)
add(
    "corpus_rollup",
    lambda spark, sf: op.corpus_rollup(main_findings(spark, sf)),
    mixed(MAIN_CTE)
    + " SELECT path, category, severity, count(*) AS findings, CAST(GROUPING_ID(path, category, severity) AS INTEGER) AS level FROM findings GROUP BY ROLLUP (path, category, severity)",
)
add(
    "rule_frequency",
    lambda spark, sf: op.rule_frequency(main_findings(spark, sf)),
    mixed(MAIN_CTE) + " SELECT rule_id, count(*) AS findings, count(DISTINCT artifact_id) AS artifacts FROM findings GROUP BY 1",
)


def _frequency_bounds(spark, sf):
    """The estimates beside the exact counts: five times the sketch's standard error is the bound."""
    found = main_findings(spark, sf)
    near = op.rule_frequency_approx(found).withColumnRenamed("artifacts", "estimate").drop("findings")
    return op.rule_frequency(found).join(near, "rule_id").selectExpr(
        "rule_id", "findings", "artifacts", "abs(estimate - artifacts) <= 0.1 * artifacts AS within"
    )


add(
    "rule_frequency_approx",
    _frequency_bounds,
    mixed(MAIN_CTE)
    + " SELECT rule_id, count(*) AS findings, count(DISTINCT artifact_id) AS artifacts, true AS within FROM findings GROUP BY 1",
)
add(
    "report_rows",
    lambda spark, sf: op.report_rows(main_findings(spark, sf)),
    mixed(MAIN_CTE)
    + " SELECT CASE WHEN GROUPING(category) = 1 THEN 'TOTAL' ELSE category END AS category, count(*) AS findings, "
    + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in SEVERITIES)
    + " FROM findings GROUP BY ROLLUP (category)",
)
add(
    "consolidate_findings",
    lambda spark, sf: op.consolidate_findings(main_findings(spark, sf), surface.scan_network(mixed_corpus(spark, sf))),
    mixed(MAIN_CTE, NETWORK_CTE)
    + f" SELECT severity, count(*) AS findings, {RANK} AS rank FROM (SELECT severity FROM findings UNION ALL SELECT severity FROM network) GROUP BY 1",
)

# --- output rows -----------------------------------------------------------------------------
add(
    "findings_json",
    lambda spark, sf: sinks.findings_json(main_findings(spark, sf)),
    mixed(MAIN_CTE)
    + """ SELECT artifact_id, pos, rule_id, CAST(to_json({'file': path, 'rule': rule_id, 'category': category, 'severity': severity, 'value': value, 'pos': pos, 'line': line}) AS VARCHAR) AS json FROM findings""",
)
add(
    "scan_metadata",
    lambda spark, sf: sinks.scan_metadata(mixed_corpus(spark, sf), main_findings(spark, sf)),
    mixed(MAIN_CTE)
    + """ SELECT artifact_id, c.path AS filename, CAST(strlen(src) AS BIGINT) AS size, count(f.rule_id) AS total
    FROM corpus c LEFT JOIN findings f USING (artifact_id) GROUP BY ALL""",
)
_LEVEL = sinks.SARIF_LEVEL
_RULES = f"""srules AS (SELECT CAST(dense_rank() OVER (ORDER BY rule_id) - 1 AS INTEGER) AS rule_index, rule_id, category, {_LEVEL} AS level
    FROM (SELECT rule_id, min(category) AS category, arg_min(severity, {RANK}) AS severity FROM findings GROUP BY 1))"""
_TEXTS = "rule_texts(rule_id, text, cwe) AS (VALUES " + ", ".join(f"({sql_text(r.rule_id)}, {sql_text(r.description or r.category)}, {sql_text(r.cwe)})" for r in MAIN) + ")"
_TEXT_RULES = mixed(MAIN_CTE, _RULES, _TEXTS) + " SELECT rule_index, rule_id, category, level, text, nullif(cwe, '') AS cwe FROM srules JOIN rule_texts USING (rule_id)"


def described_findings(spark, sf):
    return scan_rules(mixed_corpus(spark, sf), MAIN)


add("sarif_rules", lambda spark, sf: sinks.sarif_rules(described_findings(spark, sf)), _TEXT_RULES)
add(
    "sarif_rule_json",
    lambda spark, sf: sinks.sarif_rule_json(sinks.sarif_rules(described_findings(spark, sf))),
    f"""SELECT rule_index, '{{"id":"' || rule_id || '","shortDescription":{{"text":' || to_json(text) || '}},"defaultConfiguration":{{"level":"' || level || '"}}' ||
    CASE WHEN cwe IS NULL THEN '' ELSE ',"relationships":[{{"target":{{"id":"' || cwe || '","toolComponent":{{"name":"CWE"}}}},"kinds":["superset"]}}]' END || '}}' AS json FROM ({_TEXT_RULES})""",
)
add(
    "report_lines",
    lambda spark, sf: sinks.report_lines(mixed_corpus(spark, sf), described_findings(spark, sf)),
    mixed(MAIN_CTE)
    + f""", plain(rule_id, description, cwe) AS (VALUES {", ".join(f"({sql_text(r.rule_id)}, {sql_text(r.description)}, {sql_text(r.cwe)})" for r in MAIN)}),
    totals AS (SELECT artifact_id, c.path AS filename, CAST(strlen(src) AS BIGINT) AS size, count(f.rule_id) AS total FROM corpus c LEFT JOIN findings f USING (artifact_id) GROUP BY ALL),
    numbered AS (SELECT f.*, description, cwe, CAST(row_number() OVER (PARTITION BY artifact_id ORDER BY {RANK}, pos, f.rule_id, value) AS INTEGER) AS no FROM findings f JOIN plain USING (rule_id))
    SELECT artifact_id, 0 AS section, 0 AS no, '{{"metadata":' || CAST(to_json({{'filename': filename, 'size': size, 'total': total}}) AS VARCHAR) || ',"findings":[' AS line FROM totals
    UNION ALL SELECT artifact_id, 1, no, CASE WHEN no > 1 THEN ',' ELSE '' END || CAST(to_json({{'rule': rule_id, 'category': category, 'severity': severity, 'value': value, 'context': context,
      'description': description, 'cwe': cwe, 'pos': pos, 'line': line}}) AS VARCHAR) FROM numbered
    UNION ALL SELECT artifact_id, 2, 0, '],"total":' || total || '}}' FROM totals""",
)
_RESULTS = f"""sresults AS (SELECT artifact_id, path AS uri, rule_id, rule_index, CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END AS level,
    f.category || ': ' || substring(value, 1, 200) AS message, line AS start_line, substring(context, 1, 100) AS snippet, pos FROM findings f JOIN srules USING (rule_id))"""
add("sarif_results", lambda spark, sf: sinks.sarif_results(main_findings(spark, sf)), mixed(MAIN_CTE, _RULES, _RESULTS) + " SELECT * FROM sresults")
add(
    "annotation_lines",
    lambda spark, sf: sinks.annotation_lines(main_findings(spark, sf)),
    mixed(MAIN_CTE)
    + f""" SELECT artifact_id, pos, '::' || {sinks.ANNOTATION_LEVEL} || ' file=' || path || ',title=' || replace(rule_id, '"', '\\"') || '::' ||
    replace(replace(value, '"', '\\"'), chr(10), ' ') AS line FROM findings""",
)

# --- whole, incremental and streamed scans ---------------------------------------------------
_WIRED = [r for name in op.WIRED for r in PACKS[name]]
# The whole scan: ``raw_corpus`` is the texts, ``corpus`` what normalising and decoding make of them.
_LINE = "CAST(1 + length(substring(src, 1, pos)) - length(replace(substring(src, 1, pos), chr(10), '')) AS INTEGER)"
_WHOLE = ", ".join([
    corpus_sql("mixed").replace("corpus AS MATERIALIZED", "raw_corpus AS MATERIALIZED", 1), decoded_ctes("raw_corpus", _UNESCAPED),
    f"corpus AS MATERIALIZED (SELECT artifact_id, path, {REWRITTEN} AS src FROM lit_texts)",
    o.scan_cte(_WIRED, "wired"), RACE_CTE, o.scan_cte(extended.SERVICE_WORKER, "sw", _SIGNED),
    DEPS_CTE, f"fixes(package, ma, mi, pa, cve, severity) AS (VALUES {_FIXES})", TAINT, FALLBACK, modules_cte("raw_corpus"), EDGES_CTE, DEGREE_CTE, hot_cte(10), CHUNK_CTE,
    f"""graphs AS (SELECT c.artifact_id, rc.path, c.rule_id, c.severity, c.value, c.context, rc.src,
      (SELECT min(pos) FROM places p WHERE p.artifact_id = c.artifact_id AND (p.module_id = c.module_id OR p.format = c.format)) AS pos
      FROM chunk_findings c JOIN raw_corpus rc USING (artifact_id)),
    findings AS MATERIALIZED (SELECT {o.FINDING_COLUMNS} FROM wired
    UNION ALL SELECT {o.FINDING_COLUMNS} FROM race
    UNION ALL SELECT {o.FINDING_COLUMNS} FROM sw
    UNION ALL SELECT artifact_id, path, 'dep-' || package, 'Vulnerable Dependency', severity, package || '@' || version, 'below ' || ma || '.' || mi || '.' || pa, pos, line
      FROM versions JOIN fixes USING (package) WHERE {OUTDATED}
    UNION ALL SELECT artifact_id, path, rule_id, 'Taint Flow', severity, value, context, pos, line FROM flows
    UNION ALL SELECT artifact_id, path, rule_id, 'Taint Flow', severity, value, context, pos, line FROM fallback WHERE artifact_id NOT IN (SELECT artifact_id FROM flows)
    UNION ALL SELECT artifact_id, path, rule_id, 'Module Graph', severity, value, context, pos, {_LINE} FROM graphs)""",
])
add("full_scan", lambda spark, sf: op.full_scan(mixed_corpus(spark, sf)), f"WITH RECURSIVE {_WHOLE} SELECT * FROM findings")
_SUP_JOIN = "s.artifact_id = f.artifact_id AND s.line = f.line AND s.rule_id IN ('all', lower(f.rule_id))"
add(
    "scan_report",
    lambda spark, sf: op.WholeScan(mixed_corpus(spark, sf)).report,
    f"""WITH RECURSIVE {_WHOLE}, {SUPPRESSION_CTE}, {BREAKDOWN}, {UNGUARDED_CTE}, {ENDPOINT_CTE}, {HIDDEN_ROWS}, {SURFACE_ROWS},
    hit AS (SELECT f.artifact_id, EXISTS (SELECT 1 FROM suppressions s WHERE {_SUP_JOIN}) AS hidden FROM findings f),
    counts AS (SELECT artifact_id, count(*) FILTER (NOT hidden) AS total, count(*) FILTER (hidden) AS suppressed FROM hit GROUP BY 1),
    sums AS (SELECT artifact_id, CAST(sum(points) AS BIGINT) AS score FROM surface GROUP BY 1),
    whole AS (SELECT artifact_id, path AS filename, CAST(strlen(src) AS BIGINT) AS size, coalesce(total, 0) AS total, coalesce(suppressed, 0) AS suppressed,
      coalesce(score, 0) AS score FROM raw_corpus LEFT JOIN counts USING (artifact_id) LEFT JOIN sums USING (artifact_id))
    SELECT *, {RISK} AS risk FROM whole""",
)


def _scan_credentials(df):
    return scan_rules(df, PACKS["credentials"]).select("artifact_id", "path", "rule_id", "value", "pos")


def _incremental(spark, sf):
    """Documents with a label were scanned before; those labelled toxic have changed since."""
    docs = table(spark, sf, "documents")
    corpus = read_table_corpus(docs, F.col("doc_id"), "text")
    old = docs.join(table(spark, sf, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id")
    state = old.selectExpr("cast(doc_id AS string) AS path", "md5(CASE WHEN toxic = 1 THEN concat(lang, text) ELSE text END) AS content_md5")
    return incremental.incremental_scan(corpus, state, _scan_credentials(corpus), _scan_credentials)


add(
    "incremental_scan",
    _incremental,
    "WITH corpus AS (SELECT doc_id AS artifact_id, CAST(doc_id AS VARCHAR) AS path, text AS src FROM documents), "
    + o.scan_cte(PACKS["credentials"])
    + """ SELECT artifact_id, path, rule_id, value, pos, CASE WHEN coalesce((SELECT max(toxic) FROM labels WHERE labels.doc_id = findings.artifact_id), 1) = 1
      THEN 'scanned' ELSE 'cached' END AS origin FROM findings""",
)
add(
    "split_unchanged",
    lambda spark, sf: incremental.split_unchanged(
        read_table_corpus(table(spark, sf, "documents"), F.col("doc_id"), "text"),
        table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left_semi").selectExpr(
            "cast(doc_id AS string) AS path", "md5(text) AS content_md5"
        ),
    )[1].select("artifact_id", "path", "content_md5"),
    """SELECT doc_id AS artifact_id, CAST(doc_id AS VARCHAR) AS path, md5(text) AS content_md5 FROM documents
    WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)

_DYN = PACKS["dynamic_code"]
_EVENT_IDS = ("artifact_id", "path", "ts")
_EVENTS = o.with_corpus("events", o.scan_cte(_DYN))
add(
    "severity_windows",
    lambda spark, sf: streaming.severity_windows(
        scan_rules(stream_corpus(spark, table(spark, sf, "events")), _DYN, ids=_EVENT_IDS)
    ).selectExpr("date_format(window_start, 'yyyy-MM-dd HH:mm:ss') AS window_start", "severity", "findings"),
    _EVENTS
    + """ SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, severity, count(*) AS findings
    FROM findings JOIN events ON event_id = artifact_id GROUP BY 1, 2""",
)


def _events_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return stream_corpus(spark, raw).withColumn("content_md5", F.md5("src"))


def _drain(spark, df, schema):
    """Run a stream over what is there and read back what it wrote."""
    root = shared_folder(spark)
    streaming.append_batches(df, f"{root}/rows", f"{root}/checkpoint").awaitTermination()
    return spark.read.schema(schema).parquet(f"{root}/rows/*")


def _stream_scan(spark, sf):
    found = streaming.stream_scan(_events_stream(spark, sf), _DYN).select("artifact_id", "path", "rule_id", "value", "pos")
    return _drain(spark, found, found.schema)


add("stream_scan", _stream_scan, _EVENTS + " SELECT artifact_id, path, rule_id, value, pos FROM findings")


def _stream_dedupe(spark, sf):
    # the path is the event type, so the same text in one type is a duplicate within the horizon
    arts = _events_stream(spark, sf).selectExpr("artifact_id", "kind AS path", "ts", "src", "content_md5")
    kept = streaming.stream_dedupe(arts, "1 day").select("path", "content_md5")
    return _drain(spark, kept, kept.schema).groupBy("path", "content_md5").agg(F.count("*").alias("kept"))


add(
    "stream_dedupe_findings",
    _stream_dedupe,
    o.with_corpus("events") + " SELECT DISTINCT event_type AS path, md5(src) AS content_md5, CAST(1 AS BIGINT) AS kept FROM corpus JOIN events ON event_id = artifact_id",
)
