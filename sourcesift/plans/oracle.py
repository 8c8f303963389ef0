"""DuckDB SQL that states each query a second time, from the same rule rows.

Offsets come from summed gap and match lengths and first occurrences from ``row_number``;
the Spark side uses block-wise running sums and in-row sorting instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from sourcesift.functions.dialect import SPACE_CHARS, re2_regex, sql_text
from sourcesift.plans.corpora import corpus_sql
from sourcesift.rules.model import Rule

_len_sum = "coalesce(list_sum(list_transform({0}, lambda g: length(g))), 0)::BIGINT"


def rx(pattern: str) -> str:
    return sql_text(re2_regex(pattern))


def matches_cte(
    rules: Sequence[Rule], name: str = "hits", source: str = "corpus", extra: str = "",
    text: str = "src", ids: str = "artifact_id, path",
) -> str:
    """CTEs ending in ``name``: ids, src, rule_id, i, n, m, g1..gk, pos (one row per match)."""
    k = max(r.groups for r in rules)
    parts = []
    for r in rules:
        low = f"lower({text})" if r.ignore_case else text
        gate = " OR ".join(f"contains({low}, {sql_text(g)})" for g in r.gate) or "true"
        groups = "".join(
            f", regexp_extract_all({text}, {rx(r.pattern)}, {g}) AS a{g}"
            if g <= r.groups
            else f", CAST(NULL AS VARCHAR[]) AS a{g}"
            for g in range(1, k + 1)
        )
        parts.append(
            f"SELECT {ids}, {text}{extra}, {sql_text(r.rule_id)} AS rule_id, "
            f"regexp_extract_all({text}, {rx(r.pattern)}, 0) AS ms, "
            f"regexp_split_to_array({text}, {rx(r.pattern)}) AS gaps{groups} "
            f"FROM {source} WHERE ({gate})"
        )
    groups = "".join(f", coalesce(a{g}[i], '') AS g{g}" for g in range(1, k + 1))
    return (
        f"{name}_u AS ({' UNION ALL '.join(parts)}), "
        f"{name}_x AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM {name}_u WHERE len(ms) > 0), "
        f"{name} AS MATERIALIZED (SELECT {ids}, {text}{extra}, rule_id, i, len(ms) AS n, ms[i] AS m{groups}, "
        f"CAST({_len_sum.format('gaps[1:i]')} + {_len_sum.format('ms[1:i-1]')} AS INTEGER) AS pos "
        f"FROM {name}_x)"
    )


def win(before: int, after: int, pos: str = "pos", text: str = "src") -> str:
    start = f"greatest({pos} - {before}, 0)"
    return f"substring({text}, {start} + 1, {pos} + {after} - {start})"


def line(pos: str = "pos", text: str = "src") -> str:
    head = f"substring({text}, 1, {pos})"
    return f"CAST(1 + length({head}) - length(replace({head}, chr(10), '')) AS INTEGER)"


def trim_all(x: str) -> str:
    return f"trim({x}, {sql_text(SPACE_CHARS)})"


def one_line(x: str) -> str:
    return f"replace({x}, chr(10), ' ')"


def by_rule(rules: Sequence[Rule], pick, default: str, column: str = "rule_id") -> str:
    whens = [(r.rule_id, pick(r)) for r in rules]
    whens = [f"WHEN {sql_text(i)} THEN {c}" for i, c in whens if c is not None]
    return f"CASE {column} {' '.join(whens)} ELSE {default} END" if whens else default


def scan_cte(rules: Sequence[Rule], name: str = "findings", source: str = "corpus") -> str:
    """CTEs ending in ``name``: the findings of a rule pack."""
    k = max(r.groups for r in rules)
    hits = matches_cte(rules, f"{name}_h", source)

    def value(r: Rule):
        if r.extract:
            return f"regexp_extract({win(0, r.extract[0])}, {rx(r.extract[1])}, 1)"
        return "g1" if r.value == "g1" else None

    def context(r: Rule):
        text = "substring(m, 1, 120)" if r.context_from == "match" else one_line(win(*r.context))
        return trim_all(text) if r.trim else text

    def passes(r: Rule):
        tests = []
        for g in r.guards:
            target = {"value": "v", "match": "m", "g2": "g2"}.get(g.on, win(g.before, g.after))
            if g.last:
                target = f"right({target}, {g.last})"
            tests.append(f"{'' if g.keep else 'NOT '}regexp_matches({target}, {rx(g.regex)})")
        if r.min_len:
            tests.append(f"length({trim_all('v')}) >= {r.min_len}")
        if r.extract:
            tests.append("v <> ''")
        return "(" + " AND ".join(tests) + ")" if tests else None

    def key(r: Rule):
        return {
            "full": "vt",
            "value": f"substring(vt, 1, {r.value_len})",
            "context60": "substring(context, 1, 60)",
            "artifact": "''",
            "none": None,
        }[r.dedupe]

    g2 = "g2" if k >= 2 else "''"
    fmt = by_rule(rules, lambda r: sql_text(r.fmt) if r.fmt != "{v}" else None, "'{v}'")
    length = by_rule(rules, lambda r: str(r.value_len), "100")
    full = by_rule(rules, lambda r: trim_all("v") if r.dedupe == "full" else None, "v")
    sev = by_rule(
        rules,
        lambda r: f"CASE WHEN regexp_matches(context, {rx(r.downgrade[0])}) THEN "
        f"{sql_text(r.downgrade[1])} ELSE {sql_text(r.severity)} END"
        if r.downgrade
        else sql_text(r.severity),
        "NULL",
    )
    return (
        f"{hits}, {name}_v AS (SELECT *, coalesce({by_rule(rules, value, 'm')}, '') AS v FROM {name}_h), "
        f"{name}_k AS (SELECT *, {full} AS vt, {by_rule(rules, context, chr(39) * 2)} AS context "
        f"FROM {name}_v WHERE {by_rule(rules, passes, 'true')}), "
        f"{name}_f AS (SELECT *, row_number() OVER (PARTITION BY artifact_id, path, rule_id, "
        f"{by_rule(rules, key, 'CAST(pos AS VARCHAR)')} ORDER BY pos) AS rn FROM {name}_k), "
        f"{name} AS MATERIALIZED (SELECT artifact_id, path, rule_id, "
        f"{by_rule(rules, lambda r: sql_text(r.category), 'NULL')} AS category, {sev} AS severity, "
        f"replace(replace(replace({fmt}, '{{v}}', substring(vt, 1, CAST({length} AS BIGINT))), '{{g2}}', "
        f"substring({g2}, 1, 60)), '{{n}}', CAST(n AS VARCHAR)) AS value, context, pos, "
        f"{line()} AS line FROM {name}_f WHERE rn = 1)"
    )


def with_corpus(kind: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ", ".join([corpus_sql(kind), *[c for c in ctes if c]])


FINDING_COLUMNS = "artifact_id, path, rule_id, category, severity, value, context, pos, line"


def scan_sql(rules: Sequence[Rule], kind: str = "mixed") -> str:
    return with_corpus(kind, scan_cte(rules)) + f" SELECT {FINDING_COLUMNS} FROM findings"
