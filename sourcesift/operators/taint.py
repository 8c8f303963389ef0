"""Taint flows: where user data enters, how assignments carry it on, which sinks it reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcesift.functions.lineage import written
from sourcesift.functions.text import has, one_line, quote, rx
from sourcesift.operators.matching import explode_matches
from sourcesift.rules import surface as s
from sourcesift.rules import taint as t

KEYS = ("artifact_id", "path")


def _lookup(rules, attr: str, column: str) -> str:
    whens = " ".join(f"WHEN {quote(r.rule_id)} THEN {quote(getattr(r, attr))}" for r in rules)
    return f"CASE {column} {whens} END"


def _rank(rules, column: str) -> str:
    whens = " ".join(f"WHEN {quote(r.rule_id)} THEN {i}" for i, r in enumerate(rules))
    return f"CASE {column} {whens} END"


_SOURCE_IDS = {r.rule_id for r in t.SOURCES}
_ASSIGNMENT_IDS = {r.rule_id for r in t.ASSIGNMENTS}
_SINK_IDS = {r.rule_id for r in t.SINKS}


def _one_of(ids: set[str]) -> str:
    return f"rule_id IN ({', '.join(quote(i) for i in sorted(ids))})"


def _source_hits(df: DataFrame, keys) -> DataFrame:
    return explode_matches(df, t.SOURCES, ids=keys, windows={"w": (300, 0)})


def _assignment_hits(df: DataFrame, keys) -> DataFrame:
    return explode_matches(df, t.ASSIGNMENTS, ids=keys, windows={"near": (20, 0)})


def _sink_hits(df: DataFrame, keys) -> DataFrame:
    return explode_matches(df, t.SINKS, ids=keys, windows={"b": (100, 0), "a": (0, 250)}, line=True)


def numbered(hits: DataFrame) -> DataFrame:
    """Matches with a number of their own in ``id``; it holds once they are written."""
    return hits.withColumn("id", F.monotonically_increasing_id())


def taint_hits(df: DataFrame, keys=KEYS) -> DataFrame:
    """Sources, assignments and sinks of the artifacts that hold any source, in one pass.

    No flow can start elsewhere, so the other texts are left after a cheap test. The narrow match
    rows are written once, as every later step reads them; ``id`` numbers them.
    """
    starts = " OR ".join(
        f"(({' OR '.join(has('src', g) for g in r.gate)}) AND src RLIKE {rx(r.pattern)})" for r in t.SOURCES
    )
    windows = {
        "w": (300, 0, _SOURCE_IDS), "near": (20, 0, _ASSIGNMENT_IDS),
        "b": (100, 0, _SINK_IDS), "a": (0, 250, _SINK_IDS),
    }
    rules = [*t.SOURCES, *t.ASSIGNMENTS, *t.SINKS]
    return written(numbered(explode_matches(df.filter(F.expr(starts)), rules, ids=keys, windows=windows, line=True)))


def _seeds(hits: DataFrame, keys) -> DataFrame:
    statement = "substring_index(substring_index(w, ';', -1), '{', -1)"  # what follows the last of the two
    rows = hits.filter(_one_of(_SOURCE_IDS)).selectExpr(
        *keys, "rule_id AS source_id", f"{_rank(t.SOURCES, 'rule_id')} AS turn", "pos", f"{statement} AS statement"
    )
    again = f"regexp_extract(statement, {rx(t.REASSIGNED)}, 1)"
    names = (
        f"array_distinct(filter(array(regexp_extract(statement, {rx(t.DECLARED)}, 1), "
        f"CASE WHEN NOT {again} RLIKE {rx(t.NOT_A_NAME)} THEN {again} ELSE '' END), v -> v != ''))"
    )
    rows = rows.selectExpr(*keys, "source_id", "turn", "pos", f"explode({names}) AS var")
    last = rows.groupBy(*keys, "var").agg(F.max(F.struct("turn", "pos", "source_id")).alias("last"))
    return last.selectExpr(*keys, "var", "last.source_id AS source_id", "last.pos AS pos")


def taint_seeds(df: DataFrame, keys=KEYS) -> DataFrame:
    """Variables assigned from a source in the same statement; the last source of a name wins."""
    return _seeds(_source_hits(df, keys), keys)


def _assigned(hits: DataFrame, keys) -> DataFrame:
    plain = f"(g1 RLIKE {rx(t.KEYWORD)} OR near RLIKE {rx(t.CONDITION)})"
    hits = hits.filter(_one_of(_ASSIGNMENT_IDS))
    return hits.filter(f"rule_id != 'reassignment' OR NOT {plain}").selectExpr(
        *keys, "rule_id AS kind", "g1 AS var", "trim(g2) AS rhs", "pos"
    )


def assignments(df: DataFrame, keys=KEYS) -> DataFrame:
    """(variable, right-hand side) of declarations, assignments and member assignments."""
    return _assigned(_assignment_hits(df, keys), keys)


def _names_in(text: str) -> str:
    """Names and object.member pairs of a text, each once."""
    pairs = f"CASE WHEN contains({text}, '.') THEN regexp_extract_all({text}, {rx(t.NAME_PAIR)}, 1) ELSE array() END"
    return f"array_distinct(concat(regexp_extract_all({text}, {rx(t.NAME)}, 0), {pairs}))"


def _named(columns, var: str = "var") -> str:
    """``_name``: 128 bits for a name in an artifact; null where a key is null, which equals no other."""
    known = " AND ".join(f"{c} IS NOT NULL" for c in columns)
    keys = ", ".join(columns)
    return f"CASE WHEN {known} THEN struct(xxhash64({keys}, {var}) AS a, xxhash64({var}, {keys}) AS b) END AS _name"


def _links(assigned: DataFrame, keys) -> DataFrame:
    return assigned.selectExpr(*keys, "var", f"explode({_names_in('rhs')}) AS used").filter("var != used")


def assignment_edges(assigned: DataFrame, keys=KEYS) -> DataFrame:
    """variable <- each name its right-hand side mentions."""
    return _links(assigned, keys).distinct()


def propagate_taint(seeds: DataFrame, edges: DataFrame, rounds: int = 5, keys=KEYS) -> DataFrame:
    """Variables reached within ``rounds`` assignments, with the shortest hop and its source.

    One plan of ``rounds`` joins by (artifact, name) and no job of its own. A round keeps what it had and adds what one
    more link reaches, so that it reads the one before it once. The state stays where its last aggregation left it and
    is looked up in a hash table there; the links, which may repeat, are shuffled once for all rounds and never sorted.
    """
    keys = list(keys)
    links = edges.selectExpr(*keys, "used AS var", "var AS next")
    state = seeds.groupBy(*keys, "var").agg(F.min(F.struct(F.lit(0).alias("hop"), "source_id")).alias("best"))
    if rounds:  # a name of no known artifact leads nowhere
        state = state.dropna(subset=[*keys, "var"])
    step = (
        "inline(CASE WHEN next IS NULL THEN array(struct(var, best)) ELSE array(struct(var, best), "
        "struct(next AS var, struct(best.hop + 1 AS hop, best.source_id AS source_id) AS best)) END) AS (var, best)"
    )
    for _ in range(rounds):
        moved = state.hint("shuffle_hash").join(links, [*keys, "var"], "left").selectExpr(*keys, step)
        state = moved.groupBy(*keys, "var").agg(F.min("best").alias("best"))
    return state.select(*keys, "var", "best.source_id", "best.hop")


_FLOW = (
    f"{_lookup(t.SINKS, 'severity', 'sink_id')} AS severity", "{value} AS value", "source_id", "sink_id", "{var} AS var",
    "{hop} AS hop", "context", f"{_lookup(t.SINKS, 'cwe', 'sink_id')} AS cwe", "pos", "line",
)


def _flow(rows: DataFrame, keys, rule_id: str, value: str, var: str, hop: str) -> DataFrame:
    columns = [c.format(value=value, var=var, hop=hop) if c[0] == "{" else c for c in _FLOW]
    return rows.selectExpr(*keys, f"'{rule_id}' AS rule_id", *columns)


def _reached(hits: DataFrame, tainted: DataFrame, keys) -> DataFrame:
    """Sinks joined with the tainted names near them.

    A sink has many names near it and few of them are tainted. So only a hash of each name and the ``id`` of its sink
    are shuffled for all names; the sinks with their contexts meet the few that are tainted.
    """
    sinks = hits.filter(_one_of(_SINK_IDS))
    names = f"explode(array_union({_names_in('a')}, {_names_in('b')})) AS var"
    near = sinks.selectExpr(*keys, "id", names).selectExpr("id", _named(keys))
    met = near.join(tainted.selectExpr("var", "source_id", "hop", _named(keys)), "_name").drop("_name")
    sinks = sinks.selectExpr(*keys, "id", "rule_id AS sink_id", "pos", "line", f"substring({one_line('a')}, 1, 120) AS context")
    value = "concat(sink_id, ' ← \"', var, '\" (src:', source_id, ')')"
    return _flow(sinks.join(met, "id"), keys, "taint-flow", value, "var", "hop")


def taint_sinks_reached(df: DataFrame, tainted: DataFrame, keys=KEYS) -> DataFrame:
    """Sinks with a tainted name within 100 characters before or 250 after them."""
    return _reached(written(numbered(_sink_hits(df, keys).drop("m", "g1"))), tainted, keys)


def _direct(hits: DataFrame, tainted: DataFrame | None, keys) -> DataFrame:
    seen = ", ".join(
        f"CASE WHEN a RLIKE {rx(r.pattern)} OR b RLIKE {rx(r.pattern)} THEN {quote(r.rule_id)} END" for r in t.SOURCES
    )
    rows = hits.filter(_one_of(_SINK_IDS)).selectExpr(
        *keys, "rule_id AS sink_id", "pos", "line", f"substring({one_line('a')}, 1, 120) AS context",
        f"explode(array_compact(array({seen}))) AS source_id",
    )
    if tainted is not None:  # an artifact may hold most of the sinks; Spark splits the left side of such a join
        rows = rows.join(tainted.select(*keys).distinct(), list(keys), "left_semi")
    return _flow(rows, keys, "taint-flow-direct", "concat(source_id, ' → ', sink_id, ' (direct)')", "''", "0")


def taint_direct(df: DataFrame, tainted: DataFrame | None = None, keys=KEYS) -> DataFrame:
    """Sinks with a source itself in the window; read off the window text, so no join is needed.

    With ``tainted``, only artifacts that taint some variable count.
    """
    return _direct(_sink_hits(df, keys), tainted, keys)


def _closure(hits: DataFrame, rounds: int, keys) -> DataFrame:
    return propagate_taint(_seeds(hits, keys), _links(_assigned(hits, keys), keys), rounds, keys)


def taint_closure(df: DataFrame, rounds: int = 5, keys=KEYS) -> DataFrame:
    return _closure(taint_hits(df, keys), rounds, keys)


def flows_of(hits: DataFrame, keys=KEYS) -> DataFrame:
    """Flows from matches with their windows, as :func:`taint_hits` returns them."""
    tainted = _closure(hits, 5, keys)
    return _reached(hits, tainted, keys).unionByName(_direct(hits, _seeds(hits, keys), keys))


def taint_flows(df: DataFrame, keys=KEYS) -> DataFrame:
    """Flows through variables and direct ones."""
    return flows_of(taint_hits(df, keys), keys)


def taint_by_module(modules: DataFrame) -> DataFrame:
    """Flows inside each module on its own."""
    keys = ("artifact_id", "module_id")
    return taint_flows(modules.selectExpr(*keys, "module_src AS src"), keys)


def taint_summary(flows: DataFrame) -> DataFrame:
    return flows.groupBy("artifact_id").agg(
        F.count("*").alias("flows"),
        F.count_if(F.col("severity") == "critical").alias("critical"),
        F.count_if(F.col("severity") == "high").alias("high"),
        F.count_if(F.col("severity") == "medium").alias("medium"),
        F.count_if(F.col("hop") > 0).alias("multi_hop"),
        F.count_distinct(F.nullif("var", F.lit(""))).alias("vars_in_flows"),
    )


def fallback_of(sources: DataFrame, sinks: DataFrame) -> DataFrame:
    """The nearby-source heuristic over matches with the characters ``before`` and ``after`` their offset.

    The sinks are read from a written table, in which ``id`` numbers them."""
    var = (
        f"coalesce(nullif(regexp_extract(before, {rx(t.FALLBACK_DECLARED)}, 1), ''), "
        f"nullif(regexp_extract(before, {rx(t.FALLBACK_MEMBER)}, 1), ''), "
        f"nullif(regexp_extract(concat(before, substring(m, 1, 1)), {rx(t.FALLBACK_PARAM)}, 1), ''))"
    )
    seeds = sources.selectExpr("artifact_id", f"{var} AS var", f"{_rank(s.FALLBACK_SOURCES, 'rule_id')} AS turn", "pos AS s_pos")
    seeds = seeds.filter("var IS NOT NULL").groupBy("artifact_id", "var").agg(F.min(F.struct("turn", "s_pos")).alias("turn"))
    by_source = " ".join(f"WHEN w RLIKE {rx(r.pattern)} THEN {quote(r.rule_id)}" for r in s.FALLBACK_SOURCES)
    parameter = f"w RLIKE {rx(t.PARAMETERS)} AND w RLIKE {rx(t.PARAMETER_PROPERTY)}"
    near = sinks.selectExpr(
        "artifact_id", "path", "id", "rule_id AS sink", "pos", "line", "concat(before, after) AS w",
        f"{one_line('concat(right(before, 150), left(after, 150))')} AS context",
    )
    sinks = near.selectExpr(
        "artifact_id", "path", "id", "sink", "pos", "line", "context",
        f"CASE {by_source} WHEN {parameter} THEN 'function parameter property' END AS near",
        f"array_distinct(regexp_extract_all(w, {rx('[A-Za-z_$][A-Za-z0-9_$]*')}, 0)) AS names",
    )
    # as for the other flows, all names near the sinks travel as hashes
    near = sinks.selectExpr("artifact_id", "id", "explode(names) AS var").selectExpr("id", _named(["artifact_id"]))
    met = near.join(seeds.selectExpr("var", "turn", _named(["artifact_id"])), "_name").drop("_name")
    named = sinks.select("artifact_id", "sink", "pos", "id").join(met, "id")
    named = named.groupBy("artifact_id", "sink", "pos").agg(F.min(F.struct("turn", "var")).getField("var").alias("var"))
    found = sinks.drop("names").join(named, ["artifact_id", "sink", "pos"], "left")
    found = found.selectExpr("*", "coalesce(var, near) AS source").filter("source IS NOT NULL")
    return found.selectExpr(
        "artifact_id", "path", "'taint-flow' AS rule_id", f"{_lookup(s.FALLBACK_SINKS, 'severity', 'sink')} AS severity",
        "concat(sink, ' (src: ', source, ')') AS value", "context", f"{_lookup(s.FALLBACK_SINKS, 'cwe', 'sink')} AS cwe", "pos", "line",
    )


FALLBACK_WINDOWS = {"sources": (120, 0), "sinks": (200, 200)}


def scan_taint_fallback(df: DataFrame) -> DataFrame:
    """Nearby-source heuristic: the first tainted name, source or parameter property by a sink."""

    def around(rules, before: int, after: int) -> DataFrame:
        return explode_matches(df, rules, windows={"before": (before, 0), "after": (0, after)}, line=True)

    sinks = written(numbered(around(s.FALLBACK_SINKS, *FALLBACK_WINDOWS["sinks"]).drop("m")))
    return fallback_of(around(s.FALLBACK_SOURCES, *FALLBACK_WINDOWS["sources"]), sinks)


def with_fallback(flows: DataFrame, fallback: DataFrame) -> DataFrame:
    """Main flows; artifacts without any use the nearby-source heuristic."""
    columns = ["artifact_id", "path", "rule_id", "severity", "value", "context", "cwe", "pos", "line"]
    columns = [c for c in columns if c in flows.columns]
    flows = written(flows.select(*columns))  # read twice below, found once
    rest = fallback.select(*columns).join(flows.select("artifact_id").distinct(), "artifact_id", "left_anti")
    return flows.select(*columns).unionByName(rest)


def taint_with_fallback(df: DataFrame) -> DataFrame:
    """Main flows of a corpus, and the nearby-source heuristic for artifacts without any."""
    return with_fallback(taint_flows(df).drop("context"), scan_taint_fallback(df))
