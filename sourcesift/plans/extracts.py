"""Queries for sources, normalisation and extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from sourcesift.functions.dialect import re2_regex, sql_text
from sourcesift.operators import extract as e
from sourcesift.operators import normalise as n
from sourcesift.operators.matching import explode_matches, scan_rules
from sourcesift.plans import oracle as o
from sourcesift.plans.corpora import code_corpus, mixed_corpus, table, text_corpus
from sourcesift.plans.registry import add
from sourcesift.rules import extraction as x
from sourcesift.rules.packs import PACKS
from sourcesift.rules.surface import spec
from sourcesift.sources import corpus as c
from sourcesift.sources.sourcemaps import recover_sources


def cnt(pattern: str, text: str = "src") -> str:
    return f"CAST(len(regexp_extract_all({text}, {o.rx(pattern)}, 0)) AS INTEGER)"


def found(pattern: str, text: str = "src") -> str:
    return f"regexp_matches({text}, {o.rx(pattern)})"


def replaced(text: str, pairs) -> str:
    for pattern, to, *_ in pairs:
        to = to.replace("\\", "\\\\").replace("{1}", "\\1")
        text = f"regexp_replace({text}, {o.rx(pattern)}, {sql_text(to)}, 'g')"
    return text


def code(*ctes: str) -> str:
    return o.with_corpus("code", *ctes)


def mixed(*ctes: str) -> str:
    return o.with_corpus("mixed", *ctes)


# --- sources ---------------------------------------------------------------------------------
add(
    "read_table_corpus",
    lambda spark, sf: c.read_table_corpus(table(spark, sf, "conversations"), F.col("conv_id") * 1000 + F.col("turn"), "text"),
    """SELECT conv_id * 1000 + turn AS artifact_id, CAST(conv_id * 1000 + turn AS VARCHAR) AS path, text AS src,
       CAST(strlen(text) AS BIGINT) AS n_bytes, md5(text) AS content_md5 FROM conversations""",
)
add(
    "extract_inline_scripts",
    lambda spark, sf: c.extract_inline_scripts(table(spark, sf, "pages"), "page_id", "html"),
    """SELECT page_id, CAST(i - 1 AS INTEGER) AS script_no, s[i] AS script FROM (SELECT page_id, s, unnest(range(1, len(s) + 1)) AS i
       FROM (SELECT page_id, regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script>', 1) AS s FROM pages)) WHERE s[i] <> ''""",
)


def _links(spark, sf, name, text):
    rows = table(spark, sf, name).selectExpr(f"explode(regexp_extract_all({text}, 'href=\"([^\"]+)\"', 1)) AS url")
    return rows.selectExpr("concat(url, '.js') AS url").unionByName(rows)


add(
    "harvest_urls",
    lambda spark, sf: c.harvest_urls(
        _links(spark, sf, "pages", "html"),
        table(spark, sf, "pages").selectExpr("concat(split(url, '[?#]')[0], '/app.mjs') AS url"),
        code_corpus(spark, sf).selectExpr("concat('https://cdn.example.org/', path) AS url"),
    ),
    code()
    + """, hrefs AS (SELECT unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS url FROM pages),
    urls AS (SELECT url || '.js' AS url FROM hrefs UNION ALL SELECT url FROM hrefs
      UNION ALL SELECT regexp_extract(url, '^[^?#]*', 0) || '/app.mjs' FROM pages
      UNION ALL SELECT 'https://cdn.example.org/' || path FROM corpus)
    SELECT DISTINCT url, md5(url) || '.js' AS file_name FROM urls WHERE regexp_matches(url, '(?i)[.](js|mjs)$')""",
)
add(
    "recover_sources",
    lambda spark, sf: recover_sources(mixed_corpus(spark, sf)),
    mixed()
    + f""", last AS (SELECT artifact_id, path, regexp_extract(src, '([^\\n]*)$', 1) AS l FROM corpus),
    maps AS (SELECT *, TRY(decode(from_base64(regexp_extract(l, {o.rx(r'//[#@]\s*sourceMappingURL\s*=\s*data:application/json;base64,([A-Za-z0-9+/=]+)\s*$')}, 1)))) AS j FROM last),
    items AS (SELECT artifact_id, path, CAST(j AS JSON) AS j, unnest(range(0, CAST(json_array_length(CAST(j AS JSON), '$.sources') AS BIGINT))) AS i
      FROM maps WHERE j IS NOT NULL AND json_valid(j))
    SELECT artifact_id, path, CAST(i AS INTEGER) AS source_no, json_extract_string(j, '$.sources[' || i || ']') AS file_name,
      json_extract_string(j, '$.sourcesContent[' || i || ']') AS content FROM items
    WHERE json_extract_string(j, '$.sourcesContent[' || i || ']') IS NOT NULL""",
)

# --- normalisation ---------------------------------------------------------------------------
for _name, _op, _pairs in [
    ("normalise_literals", n.normalise_literals, x.NORMALISE_LITERALS),
    ("cleanup_bundle", n.cleanup_bundle, x.CLEANUP_BUNDLE),
    ("brackets_to_dots", n.brackets_to_dots, x.BRACKETS_TO_DOTS),
]:
    add(
        _name,
        lambda spark, sf, op=_op: op(mixed_corpus(spark, sf)),
        mixed() + f" SELECT artifact_id, path, {replaced('src', _pairs)} AS src FROM corpus",
    )
_UNESCAPED = "src"
for _entity, _char in x.ENTITIES:
    _UNESCAPED = f"replace({_UNESCAPED}, {sql_text(_entity)}, {sql_text(_char)})"
add(
    "unescape_entities",
    lambda spark, sf: n.unescape_entities(
        mixed_corpus(spark, sf).unionByName(table(spark, sf, "pages").selectExpr("-page_id - 1 AS artifact_id", "url AS path", "html AS src"))
    ),
    mixed()
    + f" SELECT artifact_id, path, {_UNESCAPED} AS src, {cnt(x.ENTITY)} AS n_entities FROM "
    "(SELECT * FROM corpus UNION ALL SELECT -page_id - 1, url, html FROM pages)",
)
add(
    "escape_stats",
    lambda spark, sf: n.escape_stats(mixed_corpus(spark, sf)),
    mixed()
    + f""" SELECT artifact_id, path, {' + '.join(cnt(p) for p in x.UNICODE_ESCAPES)} AS unicode_escapes,
    {cnt(x.HEX_ESCAPE)} AS hex_escapes, {cnt(x.ENTITY)} AS entities FROM corpus""",
)

# Rounds of decoding as a recursion over texts: gaps and values in turn, values by their own expressions.
_LIT = o.rx(x.literal())
_CODES = (
    "list_filter(list_transform(string_split(g, ','), lambda c: TRY_CAST(regexp_extract(trim(c), '^[+-]?[0-9]+', 0) AS INTEGER)), "
    "lambda c: c IS NOT NULL)"
)
_HEXES = "list_filter(string_split(g, ','), lambda h: trim(h) <> '')"
_HEX_OK = f"len({_HEXES}) >= 2 AND len(list_filter({_HEXES}, lambda h: NOT regexp_matches(h, {o.rx(r'^\s*0x[0-9a-fA-F]{1,4}\s*$')}))) = 0"
_HEX = f"array_to_string(list_transform({_HEXES}, lambda h: chr(CAST(trim(h) AS INTEGER))), '')"
_PARTS = f"regexp_extract_all(g, {o.rx(x.STRING_LITERAL)}, 1)"
_PLAIN = [
    f"CASE WHEN len({_CODES}) > 0 THEN array_to_string(list_transform({_CODES}, lambda c: chr(c)), '') END",
    "TRY(decode(from_base64(g)))",
    f"CASE WHEN {_HEX_OK} AND regexp_matches({_HEX}, {o.rx(r'^[ -~\t\n\r]+$')}) THEN {_HEX} END",
    f"array_to_string({_PARTS}, '')",
    f"CASE WHEN len({_PARTS}) >= 2 THEN array_to_string({_PARTS}, '') END",
]


def _choose(values) -> str:
    return "CASE " + " ".join(f"WHEN g{i}[i] <> '' THEN {v}" for i, v in enumerate(values)) + " END"


def decoded_ctes(source: str = "corpus", first: str = "src", name: str = "lit") -> str:
    """CTEs: ``{name}_texts`` (artifact_id, path, src: decoded to the end) and ``literals`` (kind, round, pos, value)."""
    lists = ", ".join(f"regexp_extract_all(s, {_LIT}, {i}) AS g{i - 1}" for i in range(1, 6))
    plain = _choose(f"list_transform([g{i}[i]], lambda g: {v})[1]" for i, v in enumerate(_PLAIN))
    return f"""{name}_rounds AS (SELECT artifact_id, path, 0 AS round, {first} AS s, [] :: STRUCT(kind VARCHAR, pos INTEGER, value VARCHAR)[] AS found, true AS more FROM {source}
      UNION ALL SELECT artifact_id, path, round + 1,
        array_to_string(list_transform(range(1, len(gaps) + 1), lambda i: gaps[i] || CASE WHEN i > len(m) THEN '' ELSE coalesce(CAST(to_json(v[i]) AS VARCHAR), m[i]) END), ''),
        list_filter(list_transform(range(1, len(m) + 1), lambda i: {{'kind': {_choose(sql_text(k) for k in x.LITERAL_KINDS)}, 'pos':
          CAST({o._len_sum.format('gaps[1:i]')} + {o._len_sum.format('m[1:i-1]')} AS INTEGER), 'value': v[i]}}), lambda f: f.value IS NOT NULL),
        len(list_filter(v, lambda w: w IS NOT NULL)) > 0
      FROM (SELECT *, list_transform(range(1, len(m) + 1), lambda i: {plain}) AS v FROM (SELECT artifact_id, path, round, regexp_split_to_array(s, {_LIT}) AS gaps,
        regexp_extract_all(s, {_LIT}, 0) AS m, {lists} FROM {name}_rounds WHERE more AND round < {x.LITERAL_ROUNDS} AND regexp_matches(s, {_LIT}))) AS step),
    {name}_all AS MATERIALIZED (SELECT * FROM {name}_rounds),
    {name}_texts AS MATERIALIZED (SELECT artifact_id, path, arg_max(s, round) AS src FROM {name}_all GROUP BY 1, 2),
    {name}erals AS MATERIALIZED (SELECT artifact_id, path, f.kind AS kind, CAST(round - 1 AS INTEGER) AS round, f.pos AS pos, f.value AS value
      FROM (SELECT artifact_id, path, round, unnest(found) AS f FROM {name}_all))"""


LITERALS_CTE = decoded_ctes()
add("decode_literals", lambda spark, sf: n.decode_literals(mixed_corpus(spark, sf)), mixed(LITERALS_CTE) + " SELECT * FROM literals")
add("decode_text", lambda spark, sf: n.decode_text(mixed_corpus(spark, sf)), mixed(LITERALS_CTE) + " SELECT * FROM lit_texts")
REWRITTEN = replaced(replaced(replaced("src", x.NORMALISE_LITERALS), x.CLEANUP_BUNDLE), x.BRACKETS_TO_DOTS)
#: ``rewritten``: the corpus as the whole scan reads it.
REWRITTEN_CTE = decoded_ctes(first=_UNESCAPED) + f", rewritten AS MATERIALIZED (SELECT artifact_id, path, {REWRITTEN} AS src FROM lit_texts)"
add("normalise", lambda spark, sf: n.normalise(mixed_corpus(spark, sf)), mixed(REWRITTEN_CTE) + " SELECT * FROM rewritten")
_BOTH = PACKS["credentials"] + PACKS["security"]
add(
    "decoded_literal_findings",
    lambda spark, sf: scan_rules(n.literals_as_artifacts(n.decode_literals(mixed_corpus(spark, sf))), _BOTH).select(
        "artifact_id", "path", "rule_id", "severity", "value", "pos"
    ),
    mixed(
        LITERALS_CTE,
        "lit AS MATERIALIZED (SELECT artifact_id, path || '#' || kind || '@' || CASE WHEN round > 0 THEN round || ':' ELSE '' END || CAST(pos AS VARCHAR) AS path, value AS src FROM literals)",
        o.scan_cte(_BOTH, source="lit"),
    )
    + " SELECT artifact_id, path, rule_id, severity, value, pos FROM findings",
)
NAMES_CTE = "names(module_id, name) AS (VALUES " + ", ".join(f"('{k}', {sql_text(v)})" for k, v in x.MODULE_NAMES.items()) + ")"
add(
    "resolve_module_aliases",
    lambda spark, sf: n.resolve_module_aliases(mixed_corpus(spark, sf), n.module_names(spark)),
    mixed(NAMES_CTE, o.matches_cte(x.ALIAS))
    + """, l AS (SELECT artifact_id, path, g1 AS alias, g2 AS module_id FROM hits
      QUALIFY row_number() OVER (PARTITION BY artifact_id, g1 ORDER BY pos DESC) = 1)
    SELECT artifact_id, path, alias, module_id, name FROM l JOIN names USING (module_id)""",
)
_SYMBOLS = ", ".join(f"('{f}', '{s}', '{full}')" for f, m in x.SYMBOLS.items() for s, full in m.items())
_GATES = " UNION ALL ".join(f"SELECT artifact_id, '{f}' AS framework FROM corpus WHERE {found(p)}" for f, p in x.SYMBOL_GATES.items())
add(
    "symbol_usage",
    lambda spark, sf: n.symbol_usage(mixed_corpus(spark, sf), n.symbols(spark)),
    mixed(
        f"symbols(framework, short, full_name) AS (VALUES {_SYMBOLS})",
        o.matches_cte(x.CALL_NAMES),
        f"gates AS ({_GATES} UNION ALL SELECT artifact_id, 'angular' FROM corpus UNION ALL SELECT artifact_id, 'rxjs' FROM corpus)",
    )
    + """ SELECT h.artifact_id, h.path, s.framework, s.full_name, count(*) AS uses FROM hits h JOIN symbols s ON h.g1 = s.short
      JOIN gates g ON g.artifact_id = h.artifact_id AND g.framework = s.framework
    WHERE (s.framework = 'rxjs') = (h.rule_id = 'member') GROUP BY ALL""",
)
_STRIP = [
    (r"(?i)//\s*scan-ignore:\s*[\w\-, ]+(?:\s+next-line)?.*\n?", ""),
    (r"(?i)/\*\s*scan-ignore:\s*[\w\-, ]+\s*\*/", ""),
]
add(
    "strip_suppressions",
    lambda spark, sf: n.strip_suppressions(mixed_corpus(spark, sf)),
    mixed() + f" SELECT artifact_id, path, {replaced('src', _STRIP)} AS src FROM corpus",
)
_FUNCTION = [spec("function", r"function", ("function",)), spec("dot", r"[.]\n", (".",))]
add(
    "add_line_index",
    lambda spark, sf: explode_matches(mixed_corpus(spark, sf), _FUNCTION, line=True).select("artifact_id", "rule_id", "pos", "line"),
    mixed(o.matches_cte(_FUNCTION)) + f" SELECT artifact_id, rule_id, pos, {o.line()} AS line FROM hits",
)

# --- extraction ------------------------------------------------------------------------------
_COUNTS = ", ".join(f"{cnt(p)} + 1 AS cyclomatic" if k == "decisions" else f"{cnt(p)} AS {k}" for k, p in x.METRICS.items())
_LISTS = ", ".join(
    f"array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(src, {o.rx(p)}, 1), lambda v: "
    f"{o.trim_all('v') if k == 'route_guards' else 'v'}))), '|') AS {k}"
    for k, p in x.METRIC_LISTS.items()
)
add(
    "code_metrics",
    lambda spark, sf: e.code_metrics(mixed_corpus(spark, sf)).selectExpr(
        "artifact_id", "path", *[("cyclomatic" if k == "decisions" else k) for k in x.METRICS], "max_nesting",
        *[f"array_join({k}, '|') AS {k}" for k in x.METRIC_LISTS],
    ),
    mixed()
    + f""", br AS (SELECT artifact_id, regexp_replace(regexp_replace(src, {o.rx(x.STRINGS)}, '', 'g'), '[^{{}}]+', '', 'g') AS b FROM corpus),
    bc AS (SELECT artifact_id, i, CASE WHEN substring(b, i, 1) = '{{' THEN 1 ELSE -1 END AS d FROM (SELECT artifact_id, b, unnest(range(1, length(b) + 1)) AS i FROM br)),
    bs AS (SELECT artifact_id, i, sum(d) OVER (PARTITION BY artifact_id ORDER BY i) AS s FROM bc),
    bm AS (SELECT artifact_id, s - least(0, min(s) OVER (PARTITION BY artifact_id ORDER BY i)) AS depth FROM bs),
    bd AS (SELECT artifact_id, max(depth) AS depth FROM bm GROUP BY 1)
    SELECT artifact_id, path, {_COUNTS}, CAST(coalesce(depth, 0) AS INTEGER) AS max_nesting, {_LISTS} FROM corpus LEFT JOIN bd USING (artifact_id)""",
)
_COMP = ", ".join(f"{cnt(p)} AS {k}" for k, p in x.COMPONENTS.items())
add(
    "component_counts",
    lambda spark, sf: e.component_counts(mixed_corpus(spark, sf)),
    mixed()
    + f""", k AS (SELECT artifact_id, path, {_COMP} FROM corpus)
    SELECT artifact_id, path, angular_components, angular_services, angular_pipes, angular_directives,
      greatest(vue_nodes, vue_apps) AS vue_components, vue_apps, react_components, svelte_components,
      functions + arrow_functions AS functions, arrow_functions, classes, decisions + 1 AS cyclomatic FROM k""",
)
add(
    "storage_keys",
    lambda spark, sf: e.storage_keys(mixed_corpus(spark, sf)).withColumn("ops", F.array_join("ops", ",")),
    mixed(o.matches_cte(x.STORAGE))
    + f""" SELECT artifact_id, path, CASE g1 WHEN 'localStorage' THEN 'local' WHEN 'sessionStorage' THEN 'session' ELSE 'cookie' END AS store,
    g3 AS key, string_agg(DISTINCT replace(g2, 'Item', ''), ',' ORDER BY replace(g2, 'Item', '')) AS ops, {found(x.SENSITIVE_KEY, 'g3')} AS sensitive
    FROM hits GROUP BY ALL""",
)
add(
    "guarded_routes",
    lambda spark, sf: e.guarded_routes(mixed_corpus(spark, sf)).withColumn("guards", F.array_join("guards", "|")),
    mixed(o.matches_cte(x.GUARDED_ROUTE))
    + f" SELECT artifact_id, path, '/' || g1 AS route, array_to_string(list_transform(string_split({o.trim_all('g2')}, ','), lambda g: {o.trim_all('g')}), '|') AS guards, pos FROM hits",
)
UNGUARDED_CTE = ", ".join(
    [
        o.matches_cte(x.ANY_ROUTE, "ar"),
        o.matches_cte(x.GUARDED_ROUTE, "gr"),
        f"""unguarded AS (SELECT DISTINCT artifact_id, path, '/' || g1 AS route FROM ar WHERE {found(x.SENSITIVE_ROUTE, 'g1')}
        AND NOT EXISTS (SELECT 1 FROM gr WHERE gr.artifact_id = ar.artifact_id AND gr.g1 = ar.g1))""",
    ]
)
add(
    "unguarded_sensitive_routes",
    lambda spark, sf: e.unguarded_sensitive_routes(mixed_corpus(spark, sf)),
    mixed(UNGUARDED_CTE) + " SELECT * FROM unguarded",
)
ENDPOINT_CTE = (
    o.matches_cte(x.ENDPOINT, "eh")
    + f""", endpoints AS (SELECT artifact_id, path, g1 AS endpoint, pos, {found(x.AUTH_WORDS, o.win(300, 50))} AS has_auth_header,
    {found(x.GUARD_WORDS, o.win(300, 50))} AS has_guard_context FROM eh)"""
)
add(
    "endpoint_protection",
    lambda spark, sf: e.endpoint_protection(mixed_corpus(spark, sf)),
    mixed(ENDPOINT_CTE)
    + " SELECT *, CASE WHEN has_auth_header OR has_guard_context THEN 'appears-protected' ELSE 'potential-unprotected' END AS risk FROM endpoints",
)
add(
    "reversible_encoding",
    lambda spark, sf: e.reversible_encoding(mixed_corpus(spark, sf)),
    mixed(o.matches_cte(x.REVERSIBLE))
    + f""" SELECT artifact_id, path, substring({o.trim_all('g1')}, 1, 100) AS expr, {o.trim_all(o.one_line(o.win(40, 100)))} AS context, pos FROM hits
    QUALIFY row_number() OVER (PARTITION BY artifact_id, substring({o.trim_all('g1')}, 1, 100) ORDER BY pos) = 1""",
)
_FW = " UNION ALL ".join(
    f"SELECT artifact_id, path, {sql_text(name)} AS name, {' + '.join(f'CAST({found(m)} AS INTEGER)' for m in markers) or '-1'} AS n FROM corpus WHERE {found(p)}"
    + (f" AND NOT {found(refuse, f'substring(src, 1, {head})')}" if refuse else "")
    for name, p, refuse, head, markers in x.FRAMEWORKS
)
add(
    "detect_frameworks",
    lambda spark, sf: e.detect_frameworks(mixed_corpus(spark, sf)),
    mixed()
    + f""", f AS (SELECT * FROM ({_FW}) WHERE n <> 0)
    SELECT artifact_id, path, name, CAST(CASE WHEN n < 0 THEN 0.6 ELSE round(least(CAST(0.5 AS DOUBLE) + n * CAST(0.15 AS DOUBLE), 1.0), 2) END AS DOUBLE) AS confidence
    FROM f WHERE name <> 'Vue' OR NOT EXISTS (SELECT 1 FROM f a WHERE a.artifact_id = f.artifact_id AND a.name = 'Angular')""",
)

HIDDEN_ROWS = f"hidden AS (SELECT artifact_id, path, '/' || value AS route, min(pos) AS pos FROM literals WHERE {found(x.HIDDEN_ROUTE, 'value')} GROUP BY ALL)"
HIDDEN_CTE = f"{LITERALS_CTE}, {HIDDEN_ROWS}"
_RANK = " ".join(f"WHEN {sql_text(r.rule_id)} THEN {i}" for i, r in enumerate(x.ROUTES))
ROUTE_ROWS_CTE = (
    o.matches_cte(x.ROUTES, "rh")
    + f""", rb AS (SELECT *, CASE rule_id {_RANK} END AS producer FROM rh),
    rchild AS (SELECT *, regexp_extract_all(g2, {o.rx(x.CHILD_PATH)}, 1) AS cs FROM rb WHERE rule_id = 'Angular-Parent'),
    route_rows AS (
      SELECT artifact_id, path, producer, pos, 0 AS step, '/' || g1 AS route, 'Angular' AS kind, contains({o.win(0, 300)}, 'canActivate') AS guarded FROM rb WHERE rule_id = 'Angular' AND g1 <> ''
      UNION ALL SELECT artifact_id, path, producer, pos, 0, '/**', 'Angular', false FROM rb WHERE rule_id = 'Wildcard'
      UNION ALL SELECT artifact_id, path, producer, pos, 0, '/' || g1, 'Angular-Parent', false FROM rchild
      UNION ALL SELECT artifact_id, path, producer, pos, j, '/' || g1 || '/' || cs[j], 'Angular-Child', false FROM (SELECT *, unnest(range(1, len(cs) + 1)) AS j FROM rchild)
      UNION ALL SELECT artifact_id, path, producer, pos, 0, '/' || g1, rule_id, false FROM rb WHERE rule_id = 'Angular-Child' AND contains(g1, '/')
      UNION ALL SELECT artifact_id, path, producer, pos, 0, CASE WHEN regexp_matches(g1, '^/[a-zA-Z]') THEN g1 ELSE '/' || g1 END, rule_id, false FROM rb
        WHERE rule_id = 'Angular-RouterLink' AND (regexp_matches(g1, '^/[a-zA-Z]') OR regexp_matches(g1, '^[a-zA-Z][a-zA-Z0-9_-]+/'))
      UNION ALL SELECT artifact_id, path, producer, pos, 0, '/' || ltrim(g1, '/'), rule_id, false FROM rb WHERE rule_id = 'Angular-Nav' AND length(ltrim(g1, '/')) > 1
      UNION ALL SELECT artifact_id, path, producer, pos, 0, m, rule_id, false FROM rb WHERE rule_id IN ('WebSocket', 'GraphQL')
      UNION ALL SELECT artifact_id, path, producer, pos, 0, g1, rule_id, false FROM rb WHERE rule_id IN ('REST', 'HTTP', 'Next.js'))"""
)
ROUTES_CTE = (
    ROUTE_ROWS_CTE
    + f""", {HIDDEN_CTE}, all_rows AS (SELECT * FROM route_rows UNION ALL SELECT artifact_id, path, 99, pos, 0, route, 'Hidden-Decoded', false FROM hidden),
    clean_rows AS (SELECT * REPLACE (replace(regexp_replace(route, {o.rx(r'\s+')}, '', 'g'), '\\n', '') AS route) FROM all_rows),
    routes AS (SELECT artifact_id, path, route, first(kind ORDER BY producer, pos, step) AS kind, bool_or(guarded) AS guarded
      FROM clean_rows WHERE route <> '' GROUP BY artifact_id, path, route)"""
)


def routes_of(df):
    return e.extract_routes(df, e.hidden_routes(df))


add("extract_routes", lambda spark, sf: routes_of(mixed_corpus(spark, sf)), mixed(ROUTES_CTE) + " SELECT * FROM routes")
add(
    "nested_routes",
    lambda spark, sf: e.nested_routes(mixed_corpus(spark, sf)),
    mixed(ROUTE_ROWS_CTE) + " SELECT artifact_id, path, route, pos, CAST(step AS INTEGER) AS step FROM route_rows WHERE producer = 4 AND step > 0",
)
add("hidden_routes", lambda spark, sf: e.hidden_routes(mixed_corpus(spark, sf)), mixed(HIDDEN_CTE) + " SELECT * FROM hidden")

# Own statement of where versions stand: the first match of one pattern per package, or the last pair.
_QUOTED = """["']{0}["'].*?["']([0-9.]+)["']|{0}@([0-9.]+)"""
_OWN = {p: _QUOTED.format(p) for p in ("lodash", "axios", "d3")} | {"jquery": "(?i)" + _QUOTED.format("jquery"), "angular/core": "@angular/core@([0-9.]+)"}
_OWN |= {p: p.replace(".", "[.]") + "@([0-9.]+)" for p in ("socket.io", "moment", "marked", "node-fetch", "minimatch")}


def _specific(source: str) -> str:
    parts = []
    for package, *_ in x.VULNERABLE:
        pattern = _OWN[package]
        value = ", ".join(f"nullif(regexp_extract(src, {o.rx(pattern)}, {g}), '')" for g in range(1, pattern.count("([0-9.]+)") + 1))
        parts.append(
            f"SELECT artifact_id, path, {sql_text(package)} AS package, coalesce({value}) AS version, "
            f"CAST(length(regexp_split_to_array(src, {o.rx(pattern)})[1]) AS INTEGER) AS pos, src FROM {source} WHERE {found(pattern)}"
        )
    return " UNION ALL ".join(parts)


_KNOWN = ", ".join(sql_text(v[0]) for v in x.VULNERABLE)


def deps_cte(source: str = "corpus") -> str:
    return (
        o.matches_cte(x.PACKAGE_REF, "ph", source)
        + f""", sv AS (SELECT * FROM ({_specific(source)}) WHERE version IS NOT NULL),
    pv AS (SELECT artifact_id, path, lower(g1) AS package, regexp_replace(g2, '[\\^~>=< ]', '', 'g') AS version, pos, src FROM ph WHERE lower(g1) IN ({_KNOWN})
      QUALIFY row_number() OVER (PARTITION BY artifact_id, lower(g1) ORDER BY pos DESC) = 1),
    versions AS (SELECT artifact_id, path, package, version, how, pos, {o.line()} AS line FROM (SELECT *, 'specific' AS how FROM sv UNION ALL SELECT *, 'pair' FROM pv WHERE version <> ''
      AND NOT EXISTS (SELECT 1 FROM sv WHERE sv.artifact_id = pv.artifact_id AND sv.package = pv.package)))"""
    )


DEPS_CTE = deps_cte()
add("dependency_versions", lambda spark, sf: e.dependency_versions(mixed_corpus(spark, sf)), mixed(DEPS_CTE) + " SELECT * FROM versions")
_FIXES = ", ".join(f"({sql_text(p)}, {a}, {b}, {d}, '{cve}', '{sev}')" for p, (a, b, d), cve, sev in x.VULNERABLE)
_V = [f"coalesce(TRY_CAST(nullif(split_part(version, '.', {i}), '') AS INTEGER), 0)" for i in (1, 2, 3)]
OUTDATED = f"""TRY_CAST(split_part(version, '.', 1) AS INTEGER) IS NOT NULL
      AND ({_V[0]} < ma OR ({_V[0]} = ma AND {_V[1]} < mi) OR ({_V[0]} = ma AND {_V[1]} = mi AND {_V[2]} < pa))"""
add(
    "vulnerable_dependencies",
    lambda spark, sf: e.vulnerable_dependencies(e.dependency_versions(mixed_corpus(spark, sf))),
    mixed(DEPS_CTE, f"fixes(package, ma, mi, pa, cve, severity) AS (VALUES {_FIXES})")
    + f""" SELECT artifact_id, path, 'dep-' || package AS rule_id, 'Vulnerable Dependency' AS category, severity, package || '@' || version AS value, cve,
    'below ' || ma || '.' || mi || '.' || pa AS context, pos, line FROM versions JOIN fixes USING (package) WHERE {OUTDATED}""",
)
_BW = " ".join(f"WHEN {found(p)} THEN {sql_text(b)}" for b, p, _ in x.BUNDLERS)
_BS = " ".join(f"WHEN {sql_text(b)} THEN 1 + " + " + ".join(f"least({cnt(m)}, 5)" for m in ms) for b, _, ms in x.BUNDLERS)
add(
    "bundler_detect",
    lambda spark, sf: e.bundler_detect(mixed_corpus(spark, sf)),
    mixed() + f", b AS (SELECT *, CASE {_BW} ELSE 'Unknown' END AS bundler FROM corpus) SELECT artifact_id, path, bundler, CASE bundler {_BS} ELSE 0 END AS confidence FROM b",
)
add(
    "entry_points",
    lambda spark, sf: e.entry_points(mixed_corpus(spark, sf)),
    mixed(o.matches_cte(x.ENTRY_POINTS)) + " SELECT artifact_id, path, rule_id || g1 AS kind, pos FROM hits",
)
