"""Queries for modules and graphs."""

from __future__ import annotations

from sourcesift.functions.dialect import sql_text
from sourcesift.operators import extract as e
from sourcesift.operators import graph as op
from sourcesift.operators import normalise as n
from sourcesift.plans import oracle as o
from sourcesift.plans.extracts import NAMES_CTE, ROUTES_CTE, _BW, found, mixed
from sourcesift.plans.corpora import mixed_corpus
from sourcesift.plans.registry import add
from sourcesift.rules import extraction as x
from sourcesift.rules import graph as g


def _parts(pattern: str, text: str, head: bool, group: int = 1) -> str:
    """Columns ids, bodies for an unnested boundary number ``i``."""
    whole = f"regexp_extract_all({text}, {o.rx(pattern)}, 0)"
    rest = f"regexp_split_to_array({text}, {o.rx(pattern)})[i + 1]"
    body = f"({whole}[i] || {rest})" if head else rest
    return f"regexp_extract_all({text}, {o.rx(pattern)}, {group})[i] AS id, {body} AS body"


def _slices(select: str, source: str, pattern: str, text: str, where: str, head: bool, places: bool = False) -> str:
    at = ""
    if places:  # where the boundary begins and ends
        gaps, ms = f"regexp_split_to_array({text}, {o.rx(pattern)})[1:i]", f"regexp_extract_all({text}, {o.rx(pattern)}, 0)"
        at = "".join(f", CAST({o._len_sum.format(gaps)} + {o._len_sum.format(f'{ms}[1:{last}]')} AS INTEGER) AS {name}" for name, last in (("opens", "i-1"), ("ends", "i")))
    return (
        f"SELECT {select}, i, {_parts(pattern, text, head)}{at} FROM (SELECT *, unnest(range(1, len(regexp_extract_all({text}, {o.rx(pattern)}, 0)) + 1)) AS i "
        f"FROM {source} WHERE {where})"
    )


_HAS = {k: found(p) for k, p in [("head", g.CHUNK_HEAD), ("line", g.MODULE_LINE), ("push", g.PUSHED_CHUNK), ("list", g.LISTED_CHUNK)]}
_IDS = "artifact_id, path"
add(
    "split_modules",
    lambda spark, sf: op.split_modules(mixed_corpus(spark, sf)),
    mixed(
        "parts AS ("
        + _slices(_IDS, "corpus", g.CHUNK_HEAD, "src", _HAS["head"], True)
        + " UNION ALL "
        + _slices(_IDS, "corpus", g.MODULE_LINE, "src", f"NOT {_HAS['head']} AND {_HAS['line']}", True)
        + f" UNION ALL SELECT {_IDS}, 1, 'main', src FROM corpus WHERE NOT {_HAS['head']} AND NOT {_HAS['line']})"
    )
    + " SELECT artifact_id, path, CAST(i - 1 AS INTEGER) AS module_no, id AS module_id, body AS module_src FROM parts",
)

_IMPORT_NAME = "coalesce(" + ", ".join(f"nullif(regexp_extract_all(src, {o.rx(g.ESM_IMPORT)}, {k})[i], '')" for k in range(1, 5)) + ")"
_ESM = "bundler IN ('ESM', 'Vite')"
_N_IMPORTS = f"len(regexp_extract_all(src, {o.rx(g.ESM_IMPORT)}, 0))"
add(
    "split_by_bundler",
    lambda spark, sf: op.split_by_bundler(e.bundler_detect(mixed_corpus(spark, sf), keep=("src",))),
    mixed(f"bc AS MATERIALIZED (SELECT *, CASE {_BW} ELSE 'Unknown' END AS bundler FROM corpus)")
    + ", parts AS ("
    + " UNION ALL ".join(
        _slices("artifact_id, path, bundler", "bc", p, "src", f"bundler = '{b}'", head)
        for b, p, head in [("Rollup", g.ROLLUP_FILE, True), ("Parcel", g.PARCEL_DEFINE, False), ("esbuild", g.ESBUILD_FILE, True)]
    )
    + f""" UNION ALL SELECT artifact_id, path, bundler, i, 'import:' || {_IMPORT_NAME}, regexp_extract_all(src, {o.rx(g.ESM_IMPORT)}, 0)[i]
      FROM (SELECT *, unnest(range(1, {_N_IMPORTS} + 1)) AS i FROM bc WHERE {_ESM})
    UNION ALL SELECT artifact_id, path, bundler, i + {_N_IMPORTS}, 'export:' || regexp_extract_all(src, {o.rx(g.ESM_EXPORT)}, 3)[i], regexp_extract_all(src, {o.rx(g.ESM_EXPORT)}, 0)[i]
      FROM (SELECT *, unnest(range(1, len(regexp_extract_all(src, {o.rx(g.ESM_EXPORT)}, 0)) + 1)) AS i FROM bc WHERE {_ESM}))
    SELECT artifact_id, path, bundler, CAST(i - 1 AS INTEGER) AS module_no, id AS module_id, body AS module_src FROM parts""",
)

_HINTS = " ".join(f"WHEN {found(p, 'body')} THEN {sql_text(v)}" for p, v in x.MODULE_HINTS)
def modules_cte(source: str = "corpus") -> str:
    """CTEs ending in ``modules``, and ``places`` with the offset at which each of them begins."""
    return f"""{NAMES_CTE}, chunks AS (
    {_slices(_IDS + ", 'webpack5' AS format", source, g.PUSHED_CHUNK, "src", _HAS['push'], False, True)}
    UNION ALL {_slices(_IDS + ", 'webpack4' AS format", source, g.LISTED_CHUNK, "src", f"NOT {_HAS['push']} AND {_HAS['list']}", False, True)}
    UNION ALL SELECT {_IDS}, 'webpack-iife', 1, 'main', src, 0, 0 FROM {source} WHERE NOT {_HAS['push']} AND NOT {_HAS['list']}),
  chunked AS (SELECT artifact_id, path, format, i AS chunk_no, id AS chunk, body AS chunk_src, ends AS begin FROM chunks),
  mods AS ({_slices("artifact_id, path, format, chunk_no, begin, CASE WHEN format = 'webpack5' THEN chunk ELSE 'main' END AS chunk", "chunked", g.MODULE_FUNCTION, "chunk_src", "true", False, True)}),
  numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY artifact_id ORDER BY chunk_no, i) - 1 AS INTEGER) AS module_no FROM mods),
  lasts AS MATERIALIZED (SELECT * FROM numbered QUALIFY row_number() OVER (PARTITION BY artifact_id, id ORDER BY module_no DESC) = 1),
  places AS (SELECT artifact_id, format, id AS module_id, begin + opens AS pos FROM lasts),
  modules AS MATERIALIZED (SELECT artifact_id, path, format, chunk, id AS module_id, module_no, body AS module_src,
    coalesce(CASE {_HINTS} END, names.name, nullif(regexp_extract(substring({o.trim_all("string_split(body, chr(10))[1]")}, 1, 60), {o.rx(g.REQUIRE_NAME)}, 1), ''), 'module-' || id) AS name
    FROM lasts LEFT JOIN names ON names.module_id = id)"""


MODULES_CTE = modules_cte()
TARGETS = f"list_concat(regexp_extract_all(module_src, {o.rx(g.D_CALL)}, 1), regexp_extract_all(module_src, {o.rx(g.REQUIRE_CALL)}, 1))"
EDGES_CTE = f"edge_rows AS (SELECT artifact_id, module_id AS src_id, unnest({TARGETS}) AS dst_id FROM modules), edges AS (SELECT artifact_id, src_id, dst_id, count(*) AS weight FROM edge_rows GROUP BY ALL)"
DEGREE_CTE = f"degrees AS (SELECT artifact_id, module_id, chunk, name, CAST(len(list_distinct({TARGETS})) AS INTEGER) AS total_calls FROM modules)"


def hot_cte(top: int) -> str:
    return f"""hot AS (SELECT h.artifact_id, h.module_id, coalesce(m.name, 'module-' || h.module_id) AS name, h.refs, h.rank FROM
      (SELECT *, CAST(row_number() OVER (PARTITION BY artifact_id ORDER BY refs DESC, module_id) AS INTEGER) AS rank FROM
        (SELECT artifact_id, dst_id AS module_id, CAST(sum(weight) AS BIGINT) AS refs FROM edges GROUP BY 1, 2)) h
      LEFT JOIN modules m ON m.artifact_id = h.artifact_id AND m.module_id = h.module_id WHERE h.rank <= {top})"""


def modules_of(spark, sf):
    return op.extract_modules(mixed_corpus(spark, sf))


add("extract_modules", modules_of, mixed(MODULES_CTE) + " SELECT * FROM modules")
add(
    "name_modules",
    lambda spark, sf: modules_of(spark, sf).select("artifact_id", "module_id", "chunk", "name"),
    mixed(MODULES_CTE) + " SELECT artifact_id, module_id, chunk, name FROM modules",
)
add(
    "dependency_uses",
    lambda spark, sf: op.dependency_uses(mixed_corpus(spark, sf), n.module_names(spark)),
    mixed(NAMES_CTE, f"u AS (SELECT artifact_id, unnest(regexp_extract_all(src, {o.rx(g.USES)}, 1)) AS module_id FROM corpus)")
    + " SELECT artifact_id, module_id, coalesce(name, 'module-' || module_id) AS name, count(*) AS uses FROM u LEFT JOIN names USING (module_id) GROUP BY ALL",
)
add("module_edges", lambda spark, sf: op.module_edges(modules_of(spark, sf)), mixed(MODULES_CTE, EDGES_CTE) + " SELECT * FROM edges")
add("out_degree", lambda spark, sf: op.out_degree(modules_of(spark, sf)), mixed(MODULES_CTE, DEGREE_CTE) + " SELECT * FROM degrees")
add(
    "module_target_names",
    lambda spark, sf: op.module_target_names(op.module_edges(modules_of(spark, sf)), modules_of(spark, sf)),
    mixed(MODULES_CTE, EDGES_CTE)
    + """ SELECT e.artifact_id, e.src_id, e.dst_id, coalesce(m.name, 'module-' || e.dst_id) AS dst_name, e.weight
    FROM edges e LEFT JOIN modules m ON m.artifact_id = e.artifact_id AND m.module_id = e.dst_id""",
)
add(
    "hot_modules",
    lambda spark, sf: op.hot_modules(op.module_edges(modules_of(spark, sf)), modules_of(spark, sf)),
    mixed(MODULES_CTE, EDGES_CTE, hot_cte(20)) + " SELECT * FROM hot",
)


def _listed(name: str, patterns, value: str) -> str:
    return f"{name} AS (" + " UNION ALL ".join(
        f"SELECT artifact_id, module_id, '{kind}' AS kind, unnest(regexp_extract_all(module_src, {o.rx(p)}, 1)) AS {value} FROM modules" for kind, p in patterns
    ) + ")"


IMPORTS_CTE = _listed("imports", g.IMPORTS, "source")
CALLS_CTE = _listed("calls", g.CALLS, "target")
add("module_imports", lambda spark, sf: op.module_imports(modules_of(spark, sf)), mixed(MODULES_CTE, IMPORTS_CTE) + " SELECT * FROM imports")
add(
    "module_exports",
    lambda spark, sf: op.module_exports(modules_of(spark, sf)),
    mixed(MODULES_CTE, _listed("exports", g.EXPORTS, "exported")) + " SELECT * FROM exports",
)
add("module_calls", lambda spark, sf: op.module_calls(modules_of(spark, sf)), mixed(MODULES_CTE, CALLS_CTE) + " SELECT * FROM calls")
TYPED_CTE = """typed AS (SELECT artifact_id, module_id AS src_id,
    CASE kind WHEN 'module-dep' THEN target WHEN 'http-call' THEN 'http:' || target WHEN 'http-fetch' THEN 'http:' || target
      WHEN 'socket-emit' THEN 'socket:emit:' || target ELSE 'socket:on:' || target END AS dst_id,
    CASE kind WHEN 'module-dep' THEN 'dep' WHEN 'http-call' THEN 'http' WHEN 'http-fetch' THEN 'http' ELSE kind END AS edge_type, count(*) AS weight
    FROM calls WHERE kind IN ('module-dep', 'http-call', 'http-fetch', 'socket-emit', 'socket-on') GROUP BY ALL)"""
add("typed_edges", lambda spark, sf: op.typed_edges(modules_of(spark, sf)), mixed(MODULES_CTE, CALLS_CTE, TYPED_CTE) + " SELECT * FROM typed")
CHUNK_CTE = f"""chunk_findings AS (
    SELECT artifact_id, 'chunk-hub' AS rule_id, 'low' AS severity, 'Hub module: ' || name || ' (' || total_calls || ' deps)' AS value,
      'Module ' || module_id || ' in chunk ' || chunk AS context, module_id, '' AS format FROM degrees WHERE total_calls > 20 AND NOT {found(g.UNNAMED, 'name')}
    UNION ALL SELECT artifact_id, 'chunk-admin-module', 'medium', 'Admin logic in chunk ' || chunk || ': ' || name, 'Module ' || module_id || ' — ' || name, module_id, ''
      FROM degrees WHERE {found(g.ADMIN_NAME, 'name')}
    UNION ALL SELECT artifact_id, 'chunk-hot-module', 'info', 'Hot module: ' || name || ' (' || refs || ' refs)', 'Module ' || module_id, module_id, ''
      FROM hot WHERE refs > 50 AND NOT {found(g.UNNAMED, 'name')}
    UNION ALL SELECT artifact_id, 'chunk-format', 'info', 'Webpack ' || format || ': ' || count(*) || ' modules', '', NULL, format FROM modules
      WHERE format <> 'webpack-iife' GROUP BY artifact_id, format)"""
add(
    "chunk_findings",
    lambda spark, sf: op.chunk_findings(modules_of(spark, sf)),
    mixed(MODULES_CTE, EDGES_CTE, DEGREE_CTE, hot_cte(10), CHUNK_CTE) + " SELECT artifact_id, rule_id, severity, value, context FROM chunk_findings",
)
_SCORES = " UNION ALL ".join(
    f"SELECT artifact_id, module_id, {sql_text(name)} AS framework, {i} AS turn, CAST({weight} * (2 * coalesce((SELECT count(*) FROM imports JOIN (VALUES "
    + ", ".join(f"({sql_text(p)})" for p in packages)
    + ") pk(p) ON contains(source, p) WHERE imports.artifact_id = modules.artifact_id AND imports.module_id = modules.module_id), 0) + "
    + " + ".join(f"(len(string_split(module_src, {sql_text(m)})) - 1)" for m in markers)
    + ") AS INTEGER) AS score FROM modules"
    for i, (name, weight, packages, markers) in enumerate(g.SIGNATURES)
)
FRAMEWORK_CTE = f"""fscores AS ({_SCORES}), frameworks AS (SELECT artifact_id, module_id, framework, score FROM fscores WHERE score > 0
    QUALIFY row_number() OVER (PARTITION BY artifact_id, module_id ORDER BY score DESC, turn) = 1)"""
add(
    "module_frameworks",
    lambda spark, sf: op.module_frameworks(modules_of(spark, sf)),
    mixed(MODULES_CTE, IMPORTS_CTE, FRAMEWORK_CTE) + " SELECT * FROM frameworks",
)
_SEEN = " UNION ALL ".join(
    f"SELECT artifact_id, {sql_text(name)} AS framework, 1 AS modules FROM corpus WHERE " + " OR ".join(f"contains(src, {sql_text(m)})" for m in markers)
    for name, _, _, markers in g.SIGNATURES
)
add(
    "framework_module_counts",
    lambda spark, sf: op.framework_module_counts(mixed_corpus(spark, sf), op.module_frameworks(modules_of(spark, sf))),
    mixed(MODULES_CTE, IMPORTS_CTE, FRAMEWORK_CTE)
    + f""" SELECT artifact_id, framework, CAST(max(modules) AS BIGINT) AS modules FROM (SELECT artifact_id, framework, count(*) AS modules FROM frameworks GROUP BY ALL
    UNION ALL {_SEEN}) GROUP BY ALL""",
)
add(
    "route_guard_modules",
    lambda spark, sf: op.route_guard_modules(
        e.extract_routes(mixed_corpus(spark, sf), e.hidden_routes(mixed_corpus(spark, sf))), modules_of(spark, sf)
    ),
    mixed(
        ROUTES_CTE, MODULES_CTE,
        f"""declared AS (SELECT *, {found(g.HAS_GUARD, 'module_src')} AS has_guard,
          array_to_string(list_transform(regexp_extract_all(module_src, {o.rx(g.GUARD_LIST)}, 1), lambda v: {o.trim_all('v')}), '|') AS guards,
          unnest(regexp_extract_all(module_src, {o.rx(g.ROUTE_PATH)}, 1)) AS declared FROM modules),
        last_declared AS (SELECT * FROM declared QUALIFY row_number() OVER (PARTITION BY artifact_id, declared ORDER BY module_no DESC) = 1)""",
    )
    + """ SELECT r.artifact_id, r.route, r.kind, d.module_id, d.name AS module_name, d.has_guard, CASE WHEN d.has_guard THEN d.guards ELSE '' END AS guards
    FROM routes r LEFT JOIN last_declared d ON d.artifact_id = r.artifact_id AND d.declared = regexp_replace(r.route, '^/', '')""",
)
_COLOUR = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in g.EDGE_COLOURS.items())
_CLEAN = "regexp_replace({0}, '[^a-zA-Z0-9_@./:-]', '_', 'g')"
add(
    "dot_edges",
    lambda spark, sf: op.dot_edges(op.typed_edges(modules_of(spark, sf))),
    mixed(MODULES_CTE, CALLS_CTE, TYPED_CTE)
    + f""" SELECT artifact_id, line_no, '  "' || {_CLEAN.format('src_id')} || '" -> "' || {_CLEAN.format('dst_id')} || '" [color="' || CASE edge_type {_COLOUR} END || '", label="' || weight || '"];' AS line
    FROM (SELECT *, CAST(row_number() OVER (PARTITION BY artifact_id ORDER BY src_id, dst_id, edge_type) AS INTEGER) AS line_no FROM typed) WHERE line_no <= 200""",
)
