"""Modules of bundled artifacts and the graphs between them.

A module is the text between two boundary matches, taken straight from the split of the text, so
slicing needs no offsets, no window and no shuffle of source text. Only edges are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sourcesift.functions.lineage import written
from sourcesift.functions.text import join_runs, line_of, quote, running_sum_runs, rx, trim_all, with_text_index
from sourcesift.rules import extraction as x
from sourcesift.rules import graph as g


def _starts(text: str, pattern: str) -> str:
    """Offsets of the boundaries, in order."""
    steps = (
        f"slice(zip_with(split({text}, {rx(pattern)}, -1), concat(array(0), transform(regexp_extract_all({text}, {rx(pattern)}, 0), m -> length(m))), "
        f"(gap, prior) -> length(gap) + prior), 1, regexp_count({text}, {rx(pattern)}))"
    )
    runs = f"element_at(transform(array({steps}), steps -> {running_sum_runs('steps')}), 1)"
    return f"element_at(transform(array({runs}), runs -> {join_runs('runs')}), 1)"


def _slices(text: str, pattern: str, with_head: bool) -> str:
    """array<struct<id, body>>: one element per boundary, up to the next boundary."""
    body = "concat(m, rest)" if with_head else "rest"
    pieces = (
        f"zip_with(regexp_extract_all({text}, {rx(pattern)}, 0), slice(split({text}, {rx(pattern)}, -1), 2, length({text}) + 1), "
        f"(m, rest) -> {body})"
    )
    return f"zip_with(regexp_extract_all({text}, {rx(pattern)}, 1), {pieces}, (id, body) -> struct(id AS id, body AS body))"


def split_modules(df: DataFrame) -> DataFrame:
    """Chunks of a bundle: chunk headers, else module lines, else the whole text as ``main``."""
    parts = (
        f"CASE WHEN src RLIKE {rx(g.CHUNK_HEAD)} THEN {_slices('src', g.CHUNK_HEAD, True)} "
        f"WHEN src RLIKE {rx(g.MODULE_LINE)} THEN {_slices('src', g.MODULE_LINE, True)} "
        "ELSE array(struct('main' AS id, src AS body)) END"
    )
    return df.selectExpr("artifact_id", "path", f"posexplode({parts}) AS (module_no, part)").selectExpr(
        "artifact_id", "path", "module_no", "part.id AS module_id", "part.body AS module_src"
    )


def split_by_bundler(df: DataFrame) -> DataFrame:
    """Modules by the conventions of the bundler found (``bundler`` from ``bundler_detect``)."""
    named = [f"regexp_extract_all(src, {rx(g.ESM_IMPORT)}, {i})" for i in range(1, 5)]
    name = named[0]
    for other in named[1:]:
        name = f"zip_with({name}, {other}, (a, b) -> CASE WHEN coalesce(a, '') != '' THEN a ELSE b END)"
    imports = (
        f"zip_with(regexp_extract_all(src, {rx(g.ESM_IMPORT)}, 0), {name}, "
        "(m, name) -> struct(concat('import:', name) AS id, m AS body))"
    )
    exports = (
        f"zip_with(regexp_extract_all(src, {rx(g.ESM_EXPORT)}, 0), regexp_extract_all(src, {rx(g.ESM_EXPORT)}, 3), "
        "(m, name) -> struct(concat('export:', name) AS id, m AS body))"
    )
    parts = f"""CASE bundler
      WHEN 'Rollup' THEN {_slices('src', g.ROLLUP_FILE, True)}
      WHEN 'Parcel' THEN {_slices('src', g.PARCEL_DEFINE, False)}
      WHEN 'esbuild' THEN {_slices('src', g.ESBUILD_FILE, True)}
      WHEN 'ESM' THEN concat({imports}, {exports})
      WHEN 'Vite' THEN concat({imports}, {exports}) END"""
    return df.selectExpr("artifact_id", "path", "bundler", f"posexplode({parts}) AS (module_no, part)").selectExpr(
        "artifact_id", "path", "bundler", "module_no", "part.id AS module_id", "part.body AS module_src"
    )


def module_name(text: str = "module_src", module_id: str = "module_id") -> str:
    """Package hint in the text, else known id, else a require in the first line, else module-N."""
    hints = " ".join(f"WHEN {text} RLIKE {rx(p)} THEN {quote(n)}" for p, n in x.MODULE_HINTS)
    known = " ".join(f"WHEN '{k}' THEN {quote(v)}" for k, v in x.MODULE_NAMES.items())
    head = f"substring({trim_all(f'''substring_index({text}, chr(10), 1)''')}, 1, 60)"
    return (
        f"coalesce(CASE {hints} END, CASE {module_id} {known} END, "
        f"nullif(regexp_extract({head}, {rx(g.REQUIRE_NAME)}, 1), ''), concat('module-', {module_id}))"
    )


def placed_modules(df: DataFrame) -> DataFrame:
    """:func:`extract_modules` with the offset and line at which each module begins in its artifact."""
    pushed, listed = rx(g.PUSHED_CHUNK), rx(g.LISTED_CHUNK)

    def chunked(pattern: str, literal: str) -> str:
        begins = f"zip_with({_starts('src', pattern)}, regexp_extract_all(src, {literal}, 0), (p, m) -> p + length(m))"
        return f"zip_with({_slices('src', pattern, False)}, {begins}, (c, at) -> struct(c.id AS id, c.body AS body, at AS at))"

    chunks = (
        f"CASE WHEN src RLIKE {pushed} THEN {chunked(g.PUSHED_CHUNK, pushed)} "
        f"WHEN src RLIKE {listed} THEN {chunked(g.LISTED_CHUNK, listed)} "
        "ELSE array(struct('main' AS id, src AS body, 0 AS at)) END"
    )
    fmt = f"CASE WHEN src RLIKE {pushed} THEN 'webpack5' WHEN src RLIKE {listed} THEN 'webpack4' ELSE 'webpack-iife' END"
    bundles = with_text_index(df.filter(F.expr(f"src RLIKE {rx(g.MODULE_FUNCTION)}")).select("artifact_id", "path", "src"), "src")
    rows = bundles.selectExpr("artifact_id", "path", "_blocks", "_lines", f"{fmt} AS format", f"{chunks} AS chunks")
    modules = (
        f"flatten(transform(chunks, c -> zip_with({_slices('c.body', g.MODULE_FUNCTION, False)}, {_starts('c.body', g.MODULE_FUNCTION)}, "
        "(m, p) -> struct(m.id AS id, CASE WHEN format = 'webpack5' THEN c.id ELSE 'main' END AS chunk, m.body AS body, c.at + p AS pos))))"
    )
    keep = ["artifact_id", "path", "_blocks", "_lines", "format"]
    rows = rows.selectExpr(*keep, f"{modules} AS mods")
    rows = rows.selectExpr(
        *keep, "array_sort(transform(mods, (m, i) -> struct(m.id AS id, -i AS back, m.chunk AS chunk, m.body AS body, m.pos AS pos))) AS mods"
    )
    last = "filter(mods, (m, i) -> i = 0 OR get(mods, i - 1).id != m.id)"
    rows = rows.selectExpr(*keep, f"transform({last}, m -> struct(m.id, m.back, m.chunk, m.body, m.pos, {line_of('m.pos')} AS line)) AS mods")
    rows = rows.selectExpr("artifact_id", "path", "format", "inline(mods)")
    return rows.selectExpr(
        "artifact_id", "path", "format", "chunk", "id AS module_id", "-back AS module_no", "body AS module_src",
        f"{module_name('body', 'id')} AS name", "pos", "line",
    )


def extract_modules(df: DataFrame) -> DataFrame:
    """Module functions with chunk, format and name; the last definition of an id wins."""
    return placed_modules(df).drop("pos", "line")


def dependency_uses(df: DataFrame, names: DataFrame) -> DataFrame:
    """Uses of each module id in an artifact, named by ``names`` (module_id, name)."""
    ids = df.selectExpr("artifact_id", f"explode(regexp_extract_all(src, {rx(g.USES)}, 1)) AS module_id")
    uses = ids.groupBy("artifact_id", "module_id").agg(F.count("*").alias("uses"))
    return uses.join(names, "module_id", "left").selectExpr(
        "artifact_id", "module_id", "coalesce(name, concat('module-', module_id)) AS name", "uses"
    )


_TARGETS = f"concat(regexp_extract_all(module_src, {rx(g.D_CALL)}, 1), regexp_extract_all(module_src, {rx(g.REQUIRE_CALL)}, 1))"


def module_edges(modules: DataFrame) -> DataFrame:
    rows = modules.selectExpr("artifact_id", "module_id AS src_id", f"explode({_TARGETS}) AS dst_id")
    return rows.groupBy("artifact_id", "src_id", "dst_id").agg(F.count("*").alias("weight"))


def out_degree(modules: DataFrame) -> DataFrame:
    """Distinct targets per module, worked out inside the module's row."""
    return modules.selectExpr(
        "artifact_id", "module_id", "chunk", "name", f"size(array_distinct({_TARGETS})) AS total_calls"
    )


def module_target_names(edges: DataFrame, modules: DataFrame) -> DataFrame:
    names = modules.selectExpr("artifact_id", "module_id AS dst_id", "name")
    return edges.join(names, ["artifact_id", "dst_id"], "left").selectExpr(
        "artifact_id", "src_id", "dst_id", "coalesce(name, concat('module-', dst_id)) AS dst_name", "weight"
    )


def hot_modules(edges: DataFrame, modules: DataFrame, top: int = 20, more: Sequence[str] = ()) -> DataFrame:
    """The most referenced modules of each artifact; ``more`` names columns of ``modules`` to pass on."""
    incoming = edges.groupBy("artifact_id", F.col("dst_id").alias("module_id")).agg(F.sum("weight").alias("refs"))
    order = W.partitionBy("artifact_id").orderBy(F.desc("refs"), "module_id")
    ranked = incoming.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    names = modules.select("artifact_id", "module_id", "name", *more)
    return ranked.join(names, ["artifact_id", "module_id"], "left").selectExpr(
        "artifact_id", "module_id", "coalesce(name, concat('module-', module_id)) AS name", "refs", "rank", *more
    )


def _named(modules: DataFrame, patterns: list[tuple[str, str]], value: str) -> DataFrame:
    # what a linear pattern only skips has an empty group
    parts = ", ".join(
        f"transform(filter(regexp_extract_all(module_src, {rx(getattr(p, 'linear', p))}, 1), v -> {'v IS NOT NULL' if type(p) is str else chr(34) + chr(34) + ' != v'}), v -> struct('{kind}' AS kind, v AS {value}))"
        for kind, p in patterns
    )
    return modules.selectExpr("artifact_id", "module_id", f"inline(concat({parts}))")


def module_imports(modules: DataFrame) -> DataFrame:
    return _named(modules, g.IMPORTS, "source")


def module_exports(modules: DataFrame) -> DataFrame:
    return _named(modules, g.EXPORTS, "exported")


def module_calls(modules: DataFrame) -> DataFrame:
    return _named(modules, g.CALLS, "target")


def typed_edges(modules: DataFrame) -> DataFrame:
    """Dependency, HTTP and socket edges, repeats merged into a weight."""
    target = (
        "CASE kind WHEN 'module-dep' THEN target WHEN 'http-call' THEN concat('http:', target) "
        "WHEN 'http-fetch' THEN concat('http:', target) WHEN 'socket-emit' THEN concat('socket:emit:', target) "
        "WHEN 'socket-on' THEN concat('socket:on:', target) END"
    )
    kind = "CASE kind WHEN 'module-dep' THEN 'dep' WHEN 'http-call' THEN 'http' WHEN 'http-fetch' THEN 'http' ELSE kind END"
    rows = module_calls(modules).selectExpr(
        "artifact_id", "module_id AS src_id", f"{target} AS dst_id", f"{kind} AS edge_type"
    ).filter("dst_id IS NOT NULL")
    return rows.groupBy("artifact_id", "src_id", "dst_id", "edge_type").agg(F.count("*").alias("weight"))


def module_facts(modules: DataFrame) -> DataFrame:
    """What the graph findings read of each module, without its text."""
    kept = ["artifact_id", "path", "format", "chunk", "module_id", "name", "pos", "line"]
    return modules.selectExpr(*[c for c in kept if c in modules.columns], f"{_TARGETS} AS targets")


def findings_of_facts(facts: DataFrame, top: int = 10) -> DataFrame:
    """Hub, administration, hot and format findings; each at its module, a format's at the first of them."""
    place = [c for c in ("pos", "line", "path") if c in facts.columns]
    unnamed = f"name RLIKE {rx(g.UNNAMED)}"
    single = facts.selectExpr("*", "size(array_distinct(targets)) AS total_calls").selectExpr(
        "artifact_id", *place,
        f"""inline(array_compact(array(
          CASE WHEN total_calls > 20 AND NOT {unnamed} THEN struct('chunk-hub' AS rule_id, 'low' AS severity,
            concat('Hub module: ', name, ' (', total_calls, ' deps)') AS value, concat('Module ', module_id, ' in chunk ', chunk) AS context) END,
          CASE WHEN name RLIKE {rx(g.ADMIN_NAME)} THEN struct('chunk-admin-module' AS rule_id, 'medium' AS severity,
            concat('Admin logic in chunk ', chunk, ': ', name) AS value, concat('Module ', module_id, ' — ', name) AS context) END)))""",
    )
    edges = facts.selectExpr("artifact_id", "module_id AS src_id", "explode(targets) AS dst_id")
    hot = hot_modules(edges.groupBy("artifact_id", "src_id", "dst_id").agg(F.count("*").alias("weight")), facts, top, place)
    hot = hot.filter(f"refs > 50 AND NOT {unnamed}").selectExpr(
        "artifact_id", *place, "'chunk-hot-module' AS rule_id", "'info' AS severity",
        "concat('Hot module: ', name, ' (', refs, ' refs)') AS value", "concat('Module ', module_id) AS context",
    )
    first = [F.min(F.struct(*place)).alias("first")] if "pos" in place else []
    formats = facts.filter("format IN ('webpack5', 'webpack4')").groupBy("artifact_id", "format").agg(F.count("*").alias("n"), *first).selectExpr(
        "artifact_id", *[f"first.{c} AS {c}" for c in place if first], "'chunk-format' AS rule_id", "'info' AS severity",
        "concat('Webpack ', format, ': ', n, ' modules') AS value", "'' AS context",
    )
    return single.unionByName(hot).unionByName(formats)


def chunk_findings(modules: DataFrame) -> DataFrame:
    """Hub, administration, hot and format findings of a bundle's module graph.

    The modules are worked out once: four parts of the findings read the narrow facts that are written.
    """
    return findings_of_facts(written(module_facts(modules).drop("path", "pos", "line")))


def module_frameworks(modules: DataFrame) -> DataFrame:
    """The best scoring framework of each module: imports count twice, markers by occurrence."""
    imports = ", ".join(f"regexp_extract_all(module_src, {rx(p)}, 1)" for _, p in g.IMPORTS)
    rows = modules.selectExpr("artifact_id", "module_id", "module_src", f"concat({imports}) AS imports")
    scores = []
    for i, (name, weight, packages, markers) in enumerate(g.SIGNATURES):
        listed = f"array({', '.join(quote(p) for p in packages)})"
        by_import = (
            f"aggregate(imports, 0, (n, s) -> n + size(filter({listed}, p -> contains(s, p))))"
        )
        by_marker = " + ".join(_occurrences("module_src", m) for m in markers)
        scores.append(f"struct(cast({weight} * (2 * {by_import} + {by_marker}) AS int) AS score, {-i} AS turn, {quote(name)} AS name)")
    best = f"array_max(array({', '.join(scores)}))"
    return rows.selectExpr("artifact_id", "module_id", f"{best} AS best").selectExpr(
        "artifact_id", "module_id", "best.name AS framework", "best.score AS score"
    ).filter("score > 0")


def _occurrences(text: str, literal: str) -> str:
    return f"cast((length({text}) - length(replace({text}, {quote(literal)}, ''))) / {len(literal)} AS int)"


def framework_module_counts(df: DataFrame, frameworks: DataFrame) -> DataFrame:
    """Modules per framework; a framework seen only in the bundle as a whole counts as one."""
    counts = frameworks.groupBy("artifact_id", "framework").agg(F.count("*").alias("modules"))
    seen = ", ".join(
        f"CASE WHEN {' OR '.join(f'contains(src, {quote(m)})' for m in markers)} THEN {quote(name)} END"
        for name, _, _, markers in g.SIGNATURES
    )
    whole = df.selectExpr("artifact_id", f"explode(array_compact(array({seen}))) AS framework", "1L AS modules")
    return counts.unionByName(whole).groupBy("artifact_id", "framework").agg(F.max("modules").alias("modules"))


def route_guard_modules(routes: DataFrame, modules: DataFrame) -> DataFrame:
    """Routes with the last module that declares their path and its guards."""
    guards = f"transform(regexp_extract_all(module_src, {rx(g.GUARD_LIST)}, 1), v -> {trim_all('v')})"
    declared = modules.selectExpr(
        "artifact_id", "module_id", "name", "module_no", f"module_src RLIKE {rx(g.HAS_GUARD)} AS has_guard",
        f"array_join({guards}, '|') AS guards",
        f"explode(array_distinct(regexp_extract_all(module_src, {rx(g.ROUTE_PATH)}, 1))) AS declared",
    )
    last = declared.groupBy("artifact_id", "declared").agg(
        F.max(F.struct("module_no", "module_id", "name", "has_guard", "guards")).alias("last")
    )
    plain = routes.selectExpr("artifact_id", "route", "kind", "regexp_replace(route, '^/', '') AS declared")
    return plain.join(last, ["artifact_id", "declared"], "left").selectExpr(
        "artifact_id", "route", "kind", "last.module_id AS module_id", "last.name AS module_name",
        "last.has_guard AS has_guard", "CASE WHEN last.has_guard THEN last.guards ELSE '' END AS guards",
    )


def dot_edges(edges: DataFrame, limit: int = 200) -> DataFrame:
    """Graph-description lines, at most ``limit`` edges per artifact, coloured by edge type."""
    order = W.partitionBy("artifact_id").orderBy("src_id", "dst_id", "edge_type")
    colour = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in g.EDGE_COLOURS.items())
    clean = "regexp_replace({0}, '[^a-zA-Z0-9_@./:-]', '_')"
    first = edges.withColumn("line_no", F.row_number().over(order)).filter(F.col("line_no") <= limit)
    return first.selectExpr(
        "artifact_id", "line_no",
        f"""format_string('  "%s" -> "%s" [color="%s", label="%d"];', {clean.format('src_id')}, {clean.format('dst_id')},
        CASE edge_type {colour} END, weight) AS line""",
    )
