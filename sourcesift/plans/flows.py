"""Queries for taint flows and for joins by position or value."""

from __future__ import annotations

from sourcesift.functions.dialect import sql_text
from sourcesift.operators import correlate as c
from sourcesift.operators import extract as e
from sourcesift.operators import taint as op
from sourcesift.operators.matching import scan_rules
from sourcesift.plans import oracle as o
from sourcesift.plans.corpora import mixed_corpus
from sourcesift.plans.extracts import found, mixed
from sourcesift.plans.graphs import MODULES_CTE, modules_of
from sourcesift.plans.registry import add
from sourcesift.rules import extraction as x
from sourcesift.rules import surface as s
from sourcesift.rules import taint as t
from sourcesift.rules.packs import PACKS


def lookup(rules, attr: str, column: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {sql_text(r.rule_id)} THEN {sql_text(getattr(r, attr))}" for r in rules) + " END"


def rank(rules, column: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {sql_text(r.rule_id)} THEN {i}" for i, r in enumerate(rules)) + " END"


def names_in(text: str) -> str:
    chains = f"list_transform(regexp_extract_all({text}, {o.rx(t.NAME_CHAIN)}, 0), lambda n: string_split(n, '.'))"
    pairs = "list_transform(range(1, len(p)), lambda i: p[i] || '.' || p[i + 1])"
    return f"list_distinct(flatten(list_transform({chains}, lambda p: list_concat(p, {pairs}))))"


def taint_ctes(keys: str = "artifact_id, path", source: str = "corpus", text: str = "src") -> str:
    k = keys.split(", ")
    same = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in k)
    on = ", ".join(k)
    statement = f"regexp_extract({o.win(300, 0, text=text)}, {o.rx(t.STATEMENT)}, 0)"
    rounds = ""
    for hop in range(1, 6):
        rounds += f""", level{hop} AS MATERIALIZED (SELECT {on}, var, source_id, hop FROM level{hop - 1} UNION ALL
          SELECT {', '.join('e.' + c for c in k)}, e.var, min(f.source_id), {hop} FROM aedges e JOIN level{hop - 1} f ON {same('e', 'f')} AND f.var = e.used AND f.hop = {hop - 1}
          WHERE NOT EXISTS (SELECT 1 FROM level{hop - 1} r WHERE {same('r', 'e')} AND r.var = e.var) GROUP BY ALL)"""
    return f"""{o.matches_cte(t.SOURCES, 'th', source, text=text, ids=keys)},
    ts AS (SELECT *, {rank(t.SOURCES, 'rule_id')} AS turn, {statement} AS statement FROM th),
    tn AS (SELECT {on}, rule_id AS source_id, turn, pos, regexp_extract(statement, {o.rx(t.DECLARED)}, 1) AS var FROM ts
      UNION ALL SELECT {on}, rule_id, turn, pos, regexp_extract(statement, {o.rx(t.REASSIGNED)}, 1) FROM ts
        WHERE NOT regexp_matches(regexp_extract(statement, {o.rx(t.REASSIGNED)}, 1), {o.rx(t.NOT_A_NAME)})),
    seeds AS (SELECT {on}, var, source_id, pos FROM tn WHERE var <> '' QUALIFY row_number() OVER (PARTITION BY {on}, var ORDER BY turn DESC, pos DESC) = 1),
    {o.matches_cte(t.ASSIGNMENTS, 'ah', source, text=text, ids=keys)},
    assigned AS (SELECT {on}, rule_id AS kind, g1 AS var, trim(g2) AS rhs, pos FROM ah WHERE rule_id <> 'reassignment'
      OR NOT (regexp_matches(g1, {o.rx(t.KEYWORD)}) OR regexp_matches({o.win(20, 0, text=text)}, {o.rx(t.CONDITION)}))),
    aedges AS MATERIALIZED (SELECT DISTINCT * FROM (SELECT {on}, var, unnest({names_in('rhs')}) AS used FROM assigned) WHERE var <> used),
    level0 AS (SELECT {on}, var, source_id, 0 AS hop FROM seeds){rounds},
    tainted AS (SELECT * FROM level5),
    {o.matches_cte(t.SINKS, 'kh', source, text=text, ids=keys)},
    kw AS (SELECT *, {o.win(100, 0, text=text)} AS b, {o.win(0, 250, text=text)} AS a, {o.line(text=text)} AS line FROM kh),
    kc AS (SELECT *, substring({o.one_line('a')}, 1, 120) AS context FROM kw),
    kn AS (SELECT DISTINCT {on}, rule_id AS sink_id, pos, line, context, unnest(list_concat({names_in('a')}, {names_in('b')})) AS var FROM kc),
    reached AS MATERIALIZED (SELECT {', '.join('kn.' + c for c in k)}, 'taint-flow' AS rule_id, {lookup(t.SINKS, 'severity', 'sink_id')} AS severity,
      sink_id || ' ← "' || kn.var || '" (src:' || source_id || ')' AS value, source_id, sink_id, kn.var, hop, context,
      {lookup(t.SINKS, 'cwe', 'sink_id')} AS cwe, kn.pos, line FROM kn JOIN tainted ON {same('kn', 'tainted')} AND kn.var = tainted.var),
    direct_all AS ({' UNION ALL '.join(f"SELECT {on}, {sql_text(r.rule_id)} AS source_id, rule_id AS sink_id, context, pos, line FROM kc WHERE {found(r.pattern, 'a')} OR {found(r.pattern, 'b')}" for r in t.SOURCES)}),
    direct AS (SELECT {on}, 'taint-flow-direct' AS rule_id, {lookup(t.SINKS, 'severity', 'sink_id')} AS severity, source_id || ' → ' || sink_id || ' (direct)' AS value,
      source_id, sink_id, '' AS var, 0 AS hop, context, {lookup(t.SINKS, 'cwe', 'sink_id')} AS cwe, pos, line FROM direct_all),
    flows AS MATERIALIZED (SELECT * FROM reached UNION ALL SELECT * FROM direct WHERE EXISTS (SELECT 1 FROM tainted WHERE {same('tainted', 'direct')}))"""


TAINT = taint_ctes()
add("taint_seeds", lambda spark, sf: op.taint_seeds(mixed_corpus(spark, sf)), mixed(TAINT) + " SELECT * FROM seeds")
add("assignments", lambda spark, sf: op.assignments(mixed_corpus(spark, sf)), mixed(TAINT) + " SELECT * FROM assigned")
add(
    "assignment_edges",
    lambda spark, sf: op.assignment_edges(op.assignments(mixed_corpus(spark, sf))),
    mixed(TAINT) + " SELECT * FROM aedges",
)
add("propagate_taint", lambda spark, sf: op.taint_closure(mixed_corpus(spark, sf)), mixed(TAINT) + " SELECT * FROM tainted")
add(
    "taint_sinks_reached",
    lambda spark, sf: op.taint_sinks_reached(mixed_corpus(spark, sf), op.taint_closure(mixed_corpus(spark, sf))),
    mixed(TAINT) + " SELECT * FROM reached",
)
add("taint_direct", lambda spark, sf: op.taint_direct(mixed_corpus(spark, sf)), mixed(TAINT) + " SELECT * FROM direct")
add(
    "taint_by_module",
    lambda spark, sf: op.taint_by_module(modules_of(spark, sf)),
    mixed(MODULES_CTE, taint_ctes("artifact_id, module_id", "modules", "module_src")) + " SELECT * FROM flows",
)
add(
    "taint_summary",
    lambda spark, sf: op.taint_summary(op.taint_flows(mixed_corpus(spark, sf))),
    mixed(TAINT)
    + """ SELECT artifact_id, count(*) AS flows, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high,
    count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (hop > 0) AS multi_hop, count(DISTINCT nullif(var, '')) AS vars_in_flows FROM flows GROUP BY 1""",
)
_VAR = (
    f"coalesce(nullif(regexp_extract({o.win(120, 0)}, {o.rx(t.FALLBACK_DECLARED)}, 1), ''), nullif(regexp_extract({o.win(120, 0)}, {o.rx(t.FALLBACK_MEMBER)}, 1), ''), "
    f"nullif(regexp_extract({o.win(120, 0)} || substring(m, 1, 1), {o.rx(t.FALLBACK_PARAM)}, 1), ''))"
)
_NEAR = " ".join(f"WHEN {found(r.pattern, 'w')} THEN {sql_text(r.rule_id)}" for r in s.FALLBACK_SOURCES)
FALLBACK = f"""{o.matches_cte(s.FALLBACK_SOURCES, 'fh')},
    fs AS (SELECT artifact_id, {_VAR} AS var, {rank(s.FALLBACK_SOURCES, 'rule_id')} AS turn, pos AS s_pos FROM fh),
    fseeds AS MATERIALIZED (SELECT * FROM fs WHERE var IS NOT NULL QUALIFY row_number() OVER (PARTITION BY artifact_id, var ORDER BY turn, s_pos) = 1),
    {o.matches_cte(s.FALLBACK_SINKS, 'fk')},
    fw AS (SELECT *, {o.win(200, 200)} AS w, {o.line()} AS line FROM fk),
    fn AS MATERIALIZED (SELECT *, CASE {_NEAR} WHEN {found(t.PARAMETERS, 'w')} AND {found(t.PARAMETER_PROPERTY, 'w')} THEN 'function parameter property' END AS near FROM fw),
    fv AS (SELECT f.artifact_id, f.sink, f.pos, f.var FROM (SELECT artifact_id, rule_id AS sink, pos, unnest(regexp_extract_all(w, '[A-Za-z_$][A-Za-z0-9_$]*', 0)) AS var FROM fw) f
      JOIN fseeds USING (artifact_id, var) QUALIFY row_number() OVER (PARTITION BY f.artifact_id, f.sink, f.pos ORDER BY turn, s_pos, f.var) = 1),
    fallback AS MATERIALIZED (SELECT fn.artifact_id, fn.path, 'taint-flow' AS rule_id, {lookup(s.FALLBACK_SINKS, 'severity', 'fn.rule_id')} AS severity,
      fn.rule_id || ' (src: ' || coalesce(fv.var, near) || ')' AS value, {o.one_line(o.win(150, 150, 'fn.pos'))} AS context,
      {lookup(s.FALLBACK_SINKS, 'cwe', 'fn.rule_id')} AS cwe, fn.pos, line
      FROM fn LEFT JOIN fv ON fv.artifact_id = fn.artifact_id AND fv.sink = fn.rule_id AND fv.pos = fn.pos WHERE coalesce(fv.var, near) IS NOT NULL)"""
add("scan_taint_fallback", lambda spark, sf: op.scan_taint_fallback(mixed_corpus(spark, sf)), mixed(FALLBACK) + " SELECT * FROM fallback")
add(
    "taint_with_fallback",
    lambda spark, sf: op.taint_with_fallback(mixed_corpus(spark, sf)),
    mixed(TAINT, FALLBACK)
    + """ SELECT artifact_id, path, rule_id, severity, value, cwe, pos, line FROM flows
    UNION ALL SELECT artifact_id, path, rule_id, severity, value, cwe, pos, line FROM fallback WHERE artifact_id NOT IN (SELECT artifact_id FROM flows)""",
)

# --- joins -----------------------------------------------------------------------------------
_SEC = PACKS["security"]
FINDINGS_CTE = o.scan_cte(_SEC)


def findings_of(spark, sf, pack="security"):
    return scan_rules(mixed_corpus(spark, sf), PACKS[pack])


add(
    "near_source_sink",
    lambda spark, sf: c.near_source_sink(mixed_corpus(spark, sf)),
    mixed(o.matches_cte(t.SINKS, "kh"), o.matches_cte(t.SOURCES, "th"))
    + """ SELECT k.artifact_id, k.path, k.rule_id AS sink_id, k.pos AS sink_pos, s.rule_id AS source_id, s.pos AS source_pos
    FROM kh k JOIN th s ON k.artifact_id = s.artifact_id AND s.pos BETWEEN k.pos - 100 AND k.pos + 250""",
)
add(
    "nearest_entry_point",
    lambda spark, sf: c.nearest_entry_point(findings_of(spark, sf), e.entry_points(mixed_corpus(spark, sf))),
    mixed(FINDINGS_CTE, o.matches_cte(x.ENTRY_POINTS, "ep"))
    + """ SELECT f.artifact_id, f.rule_id, f.pos, e.rule_id || e.g1 AS entry_kind, e.pos AS entry_pos FROM findings f
    LEFT JOIN ep e ON e.artifact_id = f.artifact_id AND abs(e.pos - f.pos) < 500
    QUALIFY row_number() OVER (PARTITION BY f.artifact_id, f.rule_id, f.pos ORDER BY e.pos, e.rule_id || e.g1) = 1""",
)
_HOPS = ", h0 AS (SELECT *, 0 AS hop, pos AS cur FROM (SELECT DISTINCT artifact_id, rule_id, pos FROM findings))"
for _h in range(5):
    _HOPS += f""", c{_h} AS (SELECT h.artifact_id, h.rule_id, h.pos, {_h} AS hop, s.kind, s.name, s.caller, s.line, greatest(s.s_pos - 50, 0) AS cur FROM h{_h} h
      JOIN starts s ON s.artifact_id = h.artifact_id AND s.s_pos >= h.cur - 1000 AND s.s_pos < h.cur AND s.s_end <= h.cur
      QUALIFY row_number() OVER (PARTITION BY h.artifact_id, h.rule_id, h.pos ORDER BY s.s_pos DESC) = 1),
    h{_h + 1} AS (SELECT artifact_id, rule_id, pos, cur FROM c{_h})"""
add(
    "enclosing_functions",
    lambda spark, sf: c.enclosing_functions(findings_of(spark, sf), c.function_starts(mixed_corpus(spark, sf))),
    mixed(FINDINGS_CTE, o.matches_cte(t.FUNCTION_STARTS, "fst"))
    + f""", starts AS (SELECT artifact_id, pos AS s_pos, pos + length(m) AS s_end, rule_id AS kind, CASE WHEN g1 = '' THEN 'anonymous' ELSE g1 END AS name,
      nullif(regexp_extract({o.win(300, 0)}, {o.rx(t.CALLER)}, 1), '') AS caller, {o.line()} AS line FROM fst
      QUALIFY row_number() OVER (PARTITION BY artifact_id, pos ORDER BY CASE rule_id WHEN 'function' THEN 0 WHEN 'arrow' THEN 1 ELSE 2 END) = 1){_HOPS}
    SELECT artifact_id, rule_id, pos, hop, kind, name, caller, line FROM ("""
    + " UNION ALL ".join(f"SELECT * FROM c{h}" for h in range(5))
    + ")",
)
_CREDS = mixed(o.scan_cte(PACKS["credentials"]))
add(
    "shared_values",
    lambda spark, sf: c.shared_values(findings_of(spark, sf, "credentials")),
    _CREDS
    + """ SELECT rule_id, value, count(DISTINCT artifact_id) AS n_artifacts, min(path) AS first_path FROM findings
    GROUP BY 1, 2 HAVING count(DISTINCT artifact_id) > 1""",
)
add(
    "artifact_pairs_sharing",
    lambda spark, sf: c.artifact_links(findings_of(spark, sf, "credentials")),
    _CREDS
    + """, d AS (SELECT DISTINCT rule_id, value, artifact_id FROM findings)
    SELECT * FROM (SELECT rule_id, value, min(artifact_id) OVER (PARTITION BY rule_id, value) AS hub_id, artifact_id FROM d) WHERE hub_id <> artifact_id""",
)
