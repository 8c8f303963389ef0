"""Structured extraction: metrics, storage keys, routes, endpoints, frameworks, dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcesift.functions.text import local_table, one_line, quote, rx, trim_all
from sourcesift.operators.matching import explode_matches
from sourcesift.operators.normalise import decode_literals
from sourcesift.operators.surface import first_occurrence
from sourcesift.rules import extraction as x

_JAVA_STRINGS = x.STRINGS.replace(")*(?:", ")*+(?:")  # possessive: no stack use on long strings


def code_metrics(df: DataFrame) -> DataFrame:
    """Construct counts, branching, nesting depth outside strings, and named lists."""
    counts = [f"regexp_count(src, {rx(p)}) AS {name}" for name, p in x.METRICS.items()]
    braces = f"regexp_replace(regexp_replace(src, {rx(_JAVA_STRINGS)}, ''), '[^{{}}]+', '')"
    depth = (
        f"aggregate(filter(split({braces}, ''), c -> c != ''), struct(0 AS d, 0 AS m), (a, c) -> "
        "struct(greatest(a.d + CASE WHEN c = '{' THEN 1 ELSE -1 END, 0) AS d, "
        "greatest(a.m, a.d + CASE WHEN c = '{' THEN 1 ELSE -1 END) AS m), a -> a.m)"
    )
    lists = [
        f"array_sort(array_distinct(transform(regexp_extract_all(src, {rx(p)}, 1), v -> "
        f"{trim_all('v') if name == 'route_guards' else 'v'}))) AS {name}"
        for name, p in x.METRIC_LISTS.items()
    ]
    out = df.selectExpr("artifact_id", "path", *counts, f"{depth} AS max_nesting", *lists)
    return out.withColumn("cyclomatic", F.col("decisions") + 1).drop("decisions")


def component_counts(df: DataFrame) -> DataFrame:
    """Framework constructs, functions and branching per artifact."""
    counted = df.selectExpr(
        "artifact_id", "path", *[f"regexp_count(src, {rx(p)}) AS {n}" for n, p in x.COMPONENTS.items()]
    )
    return counted.selectExpr(
        "artifact_id", "path", "angular_components", "angular_services", "angular_pipes",
        "angular_directives", "greatest(vue_nodes, vue_apps) AS vue_components", "vue_apps",
        "react_components", "svelte_components", "functions + arrow_functions AS functions",
        "arrow_functions", "classes", "decisions + 1 AS cyclomatic",
    )


def storage_keys(df: DataFrame) -> DataFrame:
    """(store, key) with the operations seen on it."""
    hits = explode_matches(df, x.STORAGE)
    store = "CASE g1 WHEN 'localStorage' THEN 'local' WHEN 'sessionStorage' THEN 'session' ELSE 'cookie' END"
    rows = hits.selectExpr("artifact_id", "path", f"{store} AS store", "g3 AS key", "replace(g2, 'Item', '') AS op")
    out = rows.groupBy("artifact_id", "path", "store", "key").agg(F.array_sort(F.collect_set("op")).alias("ops"))
    return out.withColumn("sensitive", F.expr(f"key RLIKE {rx(x.SENSITIVE_KEY)}"))


def guarded_routes(df: DataFrame) -> DataFrame:
    hits = explode_matches(df, x.GUARDED_ROUTE)
    guards = f"transform(split({trim_all('g2')}, ','), g -> {trim_all('g')})"
    return hits.selectExpr("artifact_id", "path", "concat('/', g1) AS route", f"{guards} AS guards", "pos")


def unguarded_of(routes: DataFrame, guarded: DataFrame) -> DataFrame:
    """Sensitive routes among the matches of declared routes that no guarded one of the artifact names."""
    named = routes.selectExpr("artifact_id", "path", "g1 AS name").filter(f"name RLIKE {rx(x.SENSITIVE_ROUTE)}").distinct()
    return named.join(guarded.selectExpr("artifact_id", "g1 AS name").distinct(), ["artifact_id", "name"], "left_anti").selectExpr(
        "artifact_id", "path", "concat('/', name) AS route"
    )


def unguarded_sensitive_routes(df: DataFrame) -> DataFrame:
    """Declared routes with a sensitive name and no guard anywhere in the artifact."""
    return unguarded_of(explode_matches(df, x.ANY_ROUTE), explode_matches(df, x.GUARDED_ROUTE))


def endpoints_of(hits: DataFrame) -> DataFrame:
    """Endpoints from matches with 300 characters ``before`` and 50 ``after`` their offset."""
    w = "concat(before, after)"
    out = hits.selectExpr(
        "artifact_id", "path", "g1 AS endpoint", "pos",
        f"{w} RLIKE {rx(x.AUTH_WORDS)} AS has_auth_header", f"{w} RLIKE {rx(x.GUARD_WORDS)} AS has_guard_context",
    )
    risk = "CASE WHEN has_auth_header OR has_guard_context THEN 'appears-protected' ELSE 'potential-unprotected' END"
    return out.withColumn("risk", F.expr(risk))


def endpoint_protection(df: DataFrame) -> DataFrame:
    """Typed HTTP calls, with signs of authentication or a guard around them."""
    return endpoints_of(explode_matches(df, x.ENDPOINT, windows={"before": (300, 0), "after": (0, 50)}))


def reversible_encoding(df: DataFrame) -> DataFrame:
    """Reversed or split text passed to base64: each expression once per artifact."""
    hits = explode_matches(df, x.REVERSIBLE, windows={"w": (40, 100)})
    rows = hits.selectExpr(
        "artifact_id", "path", f"substring({trim_all('g1')}, 1, 100) AS expr",
        f"{trim_all(one_line('w'))} AS context", "pos",
    )
    return first_occurrence(rows, ["artifact_id", "path", "expr"])


def detect_frameworks(df: DataFrame) -> DataFrame:
    """Framework fingerprints with a confidence; Vue gives way to Angular."""
    rows = []
    for name, pattern, refuse, head, markers in x.FRAMEWORKS:
        seen = " + ".join(f"cast(src RLIKE {rx(m)} AS int)" for m in markers) or "-1"
        test = f"src RLIKE {rx(pattern)}"
        if refuse:
            test += f" AND NOT substring(src, 1, {head}) RLIKE {rx(refuse)}"
        rows.append(f"CASE WHEN {test} THEN struct({quote(name)} AS name, {seen} AS n) END")
    found = f"filter(array({', '.join(rows)}), f -> f.n != 0)"
    out = df.selectExpr("artifact_id", "path", f"{found} AS found")
    kept = "CASE WHEN exists(found, f -> f.name = 'Angular') THEN filter(found, f -> f.name != 'Vue') ELSE found END"
    out = out.selectExpr("artifact_id", "path", f"inline({kept})")
    return out.selectExpr(
        "artifact_id", "path", "name",
        "cast(CASE WHEN n < 0 THEN 0.6 ELSE round(least(0.5D + n * 0.15D, 1.0D), 2) END AS double) AS confidence",
    )


def _route_rows(df: DataFrame) -> DataFrame:
    hits = explode_matches(df, x.ROUTES, windows={"ahead": (0, 300)})
    order = {r.rule_id: i for i, r in enumerate(x.ROUTES)}
    ranks = " ".join(f"WHEN {quote(k)} THEN {i}" for k, i in order.items())
    one = "array(struct({0} AS route, rule_id AS kind, false AS guarded, 0 AS step))"
    rows = f"""CASE rule_id
      WHEN 'Angular' THEN CASE WHEN g1 != '' THEN array(struct(concat('/', g1) AS route, 'Angular' AS kind, contains(ahead, 'canActivate') AS guarded, 0 AS step)) END
      WHEN 'Wildcard' THEN array(struct('/**' AS route, 'Angular' AS kind, false AS guarded, 0 AS step))
      WHEN 'Angular-Parent' THEN concat(
        array(struct(concat('/', g1) AS route, 'Angular-Parent' AS kind, false AS guarded, 0 AS step)),
        transform(regexp_extract_all(g2, {rx(x.CHILD_PATH)}, 1),
          (c, i) -> struct(concat('/', g1, '/', c) AS route, 'Angular-Child' AS kind, false AS guarded, i + 1 AS step)))
      WHEN 'Angular-Child' THEN CASE WHEN contains(g1, '/') THEN {one.format("concat('/', g1)")} END
      WHEN 'Angular-RouterLink' THEN CASE WHEN g1 RLIKE '^/[a-zA-Z]' THEN {one.format('g1')}
        WHEN g1 RLIKE '^[a-zA-Z][a-zA-Z0-9_-]+/' THEN {one.format("concat('/', g1)")} END
      WHEN 'Angular-Nav' THEN CASE WHEN length(regexp_replace(g1, '^/+', '')) > 1 THEN {one.format("concat('/', regexp_replace(g1, '^/+', ''))")} END
      WHEN 'WebSocket' THEN {one.format('m')}
      WHEN 'GraphQL' THEN {one.format('m')}
      ELSE {one.format('g1')} END"""
    return hits.selectExpr("artifact_id", "path", f"CASE rule_id {ranks} END AS producer", "pos", f"inline({rows})")


def extract_routes(df: DataFrame, hidden: DataFrame | None = None) -> DataFrame:
    """Every route of an artifact once: the first producer names its kind, guards are or-ed in."""
    rows = _route_rows(df)
    if hidden is not None:
        rows = rows.unionByName(
            hidden.selectExpr(
                "artifact_id", "path", "99 AS producer", "pos", "route",
                "'Hidden-Decoded' AS kind", "false AS guarded", "0 AS step",
            )
        )
    clean = f"replace(regexp_replace(route, {rx(r'\s+')}, ''), '\\\\n', '')"
    rows = rows.withColumn("route", F.expr(clean)).filter("route != ''")
    return rows.groupBy("artifact_id", "path", "route").agg(
        F.min(F.struct("producer", "pos", "step", "kind")).getField("kind").alias("kind"),
        F.bool_or("guarded").alias("guarded"),
    )


def nested_routes(df: DataFrame) -> DataFrame:
    rows = _route_rows(df).filter("producer = 4 AND step > 0")
    return rows.select("artifact_id", "path", "route", "pos", "step")


def hidden_of(literals: DataFrame) -> DataFrame:
    """Routes among decoded literals: see :func:`hidden_routes`."""
    found = literals.filter(f"value RLIKE {rx(x.HIDDEN_ROUTE)}")
    return found.groupBy("artifact_id", "path", F.concat(F.lit("/"), "value").alias("route")).agg(
        F.min("pos").alias("pos")
    )


def hidden_routes(df: DataFrame) -> DataFrame:
    """Decoded literals that look like paths, each once per artifact."""
    return hidden_of(decode_literals(df))


DEPENDENCY_RULES = [*x.VERSION_REFS, *x.PACKAGE_REF]


def versions_of(hits: DataFrame) -> DataFrame:
    """Versions from the matches of ``DEPENDENCY_RULES``: see :func:`dependency_versions`."""
    own = hits.filter("rule_id != 'ref'").selectExpr(
        "artifact_id", "path", "split(rule_id, ':')[0] AS package", "g1 AS version", "'specific' AS how", "pos", "line", "-pos AS turn"
    )
    known = ", ".join(quote(v[0]) for v in x.VULNERABLE)
    pairs = hits.filter("rule_id = 'ref'").selectExpr(
        "artifact_id", "path", "lower(g1) AS package", "regexp_replace(g2, '[\\\\^~>=< ]', '') AS version", "'pair' AS how", "pos", "line", "pos AS turn"
    ).filter(f"package IN ({known})")
    # the first of the own notations, else the last pair, which may have no number
    best = F.max(F.struct(F.col("how") == "specific", "turn", "version", "how", "pos", "line")).alias("best")
    rows = own.unionByName(pairs).groupBy("artifact_id", "path", "package").agg(best).filter("best.version != ''")
    return rows.select("artifact_id", "path", "package", "best.version", "best.how", "best.pos", "best.line")


def dependency_versions(df: DataFrame) -> DataFrame:
    """Version per known package and where it stands: its own notation first, else the last quoted pair."""
    return versions_of(explode_matches(df, DEPENDENCY_RULES, line=True))


def vulnerable_dependencies(versions: DataFrame) -> DataFrame:
    """Versions below the first fixed one; the advisory list is a fixed ten rows and broadcast."""
    spark = versions.sparkSession
    rows = [(p, *fixed, cve, sev) for p, fixed, cve, sev in x.VULNERABLE]
    listed = local_table(spark, 
        rows, "package string, fix_major int, fix_minor int, fix_patch int, cve string, severity string"
    )

    def part(i: int) -> str:
        return f"coalesce(try_cast(get(split(version, '[.]'), {i}) AS int), 0)"

    joined = versions.join(F.broadcast(listed), "package")
    older = joined.filter(
        "try_cast(get(split(version, '[.]'), 0) AS int) IS NOT NULL AND "
        f"struct({part(0)}, {part(1)}, {part(2)}) < struct(fix_major, fix_minor, fix_patch)"
    )
    return older.selectExpr(
        "artifact_id", "path", "concat('dep-', package) AS rule_id", "'Vulnerable Dependency' AS category",
        "severity", "concat(package, '@', version) AS value", "cve",
        "concat('below ', fix_major, '.', fix_minor, '.', fix_patch) AS context", "pos", "line",
    )


def bundler_detect(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Bundler and confidence per artifact; ``keep`` names further columns to pass on."""
    whens, scores = [], []
    for name, pattern, markers in x.BUNDLERS:
        score = " + ".join(f"least(regexp_count(src, {rx(m)}), 5)" for m in markers)
        whens.append(f"WHEN src RLIKE {rx(pattern)} THEN {quote(name)}")
        scores.append(f"WHEN {quote(name)} THEN 1 + {score}")
    out = df.selectExpr("artifact_id", "path", "src", f"CASE {' '.join(whens)} ELSE 'Unknown' END AS bundler")
    return out.selectExpr("artifact_id", "path", *keep, "bundler", f"CASE bundler {' '.join(scores)} ELSE 0 END AS confidence")


def entry_points(df: DataFrame) -> DataFrame:
    hits = explode_matches(df, x.ENTRY_POINTS)
    return hits.selectExpr("artifact_id", "path", "concat(rule_id, g1) AS kind", "pos")
