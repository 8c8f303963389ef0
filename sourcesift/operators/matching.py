"""The scan: every match of every rule, in one pass over the text and without a shuffle.

Each artifact is read once. A literal gate decides cheaply whether a rule's regex runs at all.
Offsets, windows, guards and de-duplication are worked out on arrays inside the artifact's own
row, so no exchange is planned and only narrow result rows leave the scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcesift.functions.lineage import written
from sourcesift.functions.text import (
    has,
    join_runs,
    let,
    line_of,
    one_line,
    quote,
    running_sum_runs,
    rx,
    text_runs,
    trim_all,
    window,
)
from sourcesift.rules.model import SEVERITIES, Guard, Linear, Rule

ID_COLUMNS = ("artifact_id", "path")


def _gate(rule: Rule) -> str:
    text = "_lower" if rule.ignore_case else "_src"
    return " OR ".join(has(text, g) for g in rule.gate) or "true"


def match_arrays(
    df: DataFrame, rules: Sequence[Rule], ids: Sequence[str] = ID_COLUMNS, text: str = "src", only: Sequence[str] = (),
    literals: str | None = None,
) -> DataFrame:
    """One row per (artifact, rule with a match): match, group and offset arrays plus text index.

    ``only`` may give a condition per rule (SQL over the columns of ``df``); where it does not hold, the rule is not run.
    ``literals`` may name an array of decoded literals, which take the place of matches of one more rule.
    """
    n_groups = max([r.groups for r in rules] + [2] * bool(literals))
    # a rule's regex runs over a text once: it sets each match and its groups between marks that the text cannot hold
    # (its own MD5), and a split at the marks gives gap, match, group 1, ... in turn. What a linear pattern has
    # skipped shows in one more group, or goes in front of the first mark, into the gap.
    leads = [isinstance(r.pattern, Linear) and r.pattern.leads for r in rules]
    widths = [r.groups + (isinstance(r.pattern, Linear) and not led) for r, led in zip(rules, leads)] + [2] * bool(literals)
    strides = [str(w + 2) for w in widths]

    def parts(ix: int, rule: Rule) -> str:
        pattern = rx(getattr(rule.pattern, "linear", rule.pattern))
        when = f"({only[ix]}) AND " if only and only[ix] else ""
        put = f"_led{widths[ix]}" if leads[ix] else f"_put{widths[ix]}"
        return f"CASE WHEN {when}({_gate(rule)}) THEN struct({ix} AS ix, split(regexp_replace(_src, {pattern}, {put}), _mark, -1) AS parts) END"

    ids = list(ids)
    more = [*_named_in(df, only, ids, text), *[literals] * bool(literals)]
    base, lines = text_runs(df.select(*ids, *more, F.col(text).alias("_src")), "_src")
    base = base.withColumn("_mark", F.concat(F.lit("m"), F.md5("_src")))  # a digit would be read into the group's number
    for width in sorted(set(widths)):
        put = "".join(f", '$', '{g}', _mark" for g in range(width + 1))
        base = base.withColumn(f"_put{width}", F.expr(f"concat(_mark{put})"))
    for width in sorted({w for w, led in zip(widths, leads) if led}):
        put = "".join(f", '$', '{g + 2}', _mark" for g in range(width + 1))
        base = base.withColumn(f"_led{width}", F.expr(f"concat('$', '1', _mark{put})"))
    if any(r.gate and r.ignore_case for r in rules):
        base = base.withColumn("_lower", F.lower("_src"))
    per_rule = [parts(i, r) for i, r in enumerate(rules)]
    if literals:
        listed = f"flatten(transform({literals}, f -> array('', f.value, concat(f.round, ':', f.pos), f.kind)))"
        per_rule.append(f"CASE WHEN size({literals}) > 0 THEN struct({len(rules)} AS ix, concat({listed}, array('')) AS parts) END")
    # the rules stand in a projection of their own, beside the lambdas of ``lines``: there Spark compiles them, in pieces;
    # inside a generator or a lambda it would interpret every gate
    hits = base.selectExpr(*ids, "_blocks", lines, f"array({', '.join(per_rule)}) AS _hits")
    led = [str(i) for i, at_front in enumerate(leads) if at_front]
    some = f"size(h.parts) > 1 AND (h.ix NOT IN ({', '.join(led)}) OR get(h.parts, 1) != '')" if led else "size(h.parts) > 1"
    hits = hits.selectExpr(*ids, "_blocks", "_lines", f"inline(filter(_hits, h -> {some}))")
    stride = _pick(strides)
    n = f"(size(parts) - 1) div {stride}"
    if led:  # the end of the text stands behind the last match, once or twice, as an empty one
        ends = " - ".join(f"CASE WHEN get(parts, cast(size(parts) - {k} * {stride} AS int)) = '' THEN 1 ELSE 0 END" for k in (1, 2))
        n = f"CASE WHEN ix IN ({', '.join(led)}) THEN {n} - {ends} ELSE {n} END"
    hits = hits.selectExpr(*ids, "_blocks", "_lines", "ix", "parts", f"{stride} AS w", f"{n} AS n")
    # offset of match i = the gap before it plus everything before that gap; most rows have one match
    steps = "transform(sequence(0, n - 1), j -> length(get(parts, j * w)) + CASE WHEN j > 0 THEN length(get(parts, (j - 1) * w + 1)) ELSE 0 END)"
    summed = let({"steps": steps, "runs": running_sum_runs("steps")}, join_runs("runs"))
    places = f"CASE WHEN n = 1 THEN array(cast(length(get(parts, 0)) AS int)) ELSE {summed} END AS places"
    linear = [str(i) for i, r in enumerate(rules) if isinstance(r.pattern, Linear) and not leads[i]]
    real = "sequence(0, n - 1)"
    if linear:
        real = f"CASE WHEN ix IN ({', '.join(linear)}) THEN filter({real}, j -> get(parts, j * w + w - 1) = '') ELSE {real} END"
    keep = [*ids, "_blocks", "_lines", "ix"]
    hits = hits.selectExpr(*keep, "cast(w AS int) AS w", "parts", places, f"transform({real}, j -> cast(j AS int)) AS at").filter("size(at) > 0")
    groups = ["transform(at, j -> get(parts, j * w + 1)) AS g0"]
    for g in range(1, n_groups + 1):
        having = [str(i) for i, r in enumerate(rules) if r.groups >= g] + [str(len(rules))] * (bool(literals) and g <= 2)
        taken = f"transform(at, j -> get(parts, j * w + {g + 1}))"
        if len(having) < len(widths):
            taken = f"CASE WHEN ix IN ({', '.join(having)}) THEN {taken} ELSE cast(array() AS array<string>) END"
        groups.append(f"{taken} AS g{g}")
    return hits.selectExpr(*keep, *groups, "transform(at, j -> get(places, j)) AS pos")


def _named_in(df: DataFrame, only: Sequence[str], ids: Sequence[str], text: str) -> list[str]:
    """Columns besides the ids that conditions read."""
    return [c for c in df.columns if c not in ids and c != text and any(c in (o or "") for o in only)]


def _pick(values: Sequence[str], ix: str = "ix") -> str:
    """A per-rule constant looked up by rule index."""
    return values[0] if len(set(values)) == 1 else f"get(array({', '.join(values)}), {ix})"


def explode_matches(
    df: DataFrame,
    rules: Sequence[Rule],
    ids: Sequence[str] = ID_COLUMNS,
    text: str = "src",
    windows: dict[str, tuple] | None = None,
    line: bool = False,
) -> DataFrame:
    """One row per match: ``rule_id, m, g1..gn, pos`` plus the asked windows and line.

    A window is (before, after), or (before, after, rule ids) to cut it for those rules only.
    """
    n_groups = max(r.groups for r in rules)
    hits = match_arrays(df, rules, ids, text)
    groups = range(1, n_groups + 1)
    fields = ["h.g0 AS m", *[f"coalesce(h.g{g}, '') AS g{g}" for g in groups], "h.pos AS pos"]
    for name, (before, after, *only) in (windows or {}).items():
        cut = window("h.pos", before, after)
        if only:
            ix = [str(i) for i, r in enumerate(rules) if r.rule_id in only[0]]
            cut = f"CASE WHEN ix IN ({', '.join(ix)}) THEN {cut} END"
        fields.append(f"{cut} AS {name}")
    if line:
        fields.append(f"{line_of('h.pos')} AS line")
    zipped = f"arrays_zip({', '.join(f'g{g}' for g in range(n_groups + 1))}, pos)"
    return hits.selectExpr(
        *ids,
        f"{_pick([quote(r.rule_id) for r in rules])} AS rule_id",
        f"inline(transform({zipped}, h -> struct({', '.join(fields)})))",
    )


def _by_rule(rules: Sequence[Rule], pick, default: str) -> str:
    """CASE over the rule index with one branch per distinct expression; None means default."""
    branches: dict[str, list[str]] = {}
    for i, r in enumerate(rules):
        made = pick(r)
        if made is not None and made != default:
            branches.setdefault(made, []).append(str(i))
    if not branches:
        return default
    if len(branches) == 1 and len(next(iter(branches.values()))) == len(rules):
        return next(iter(branches))
    whens = " ".join(f"WHEN ix IN ({', '.join(ix)}) THEN {e}" for e, ix in branches.items())
    return f"CASE {whens} ELSE {default} END"


def _passes(guard: Guard) -> str:
    if guard.on == "window":
        target = window("h.pos", guard.before, guard.after)
        if guard.last:
            target = f"right({target}, {guard.last})"
    else:
        target = {"value": "h.v", "match": "h.m", "g2": "h.g2"}[guard.on]
    if callable(guard.regex):  # user packs may build the predicate on the target's SQL text
        found = guard.regex(target)
    else:
        found = f"({target} RLIKE {rx(guard.regex)})"
    return found if guard.keep else f"(NOT {found})"


@dataclass(frozen=True)
class Raw:
    """Rules whose matches a table keeps as they are, with the characters ``before`` and ``after`` their offset.

    ``only`` is a condition on the artifact (SQL over its columns), without which none of them is run.
    """

    name: str
    rules: tuple[Rule, ...]
    before: int = 0
    after: int = 0
    only: str = ""


RAW = ("m", "g1", "g2", "before", "after")
FOUND = ("category", "severity", "value", "context", "description", "cwe")


def match_table(
    df: DataFrame, packs: dict[str, Sequence[Rule]], raws: Sequence[Raw] = (), ids: Sequence[str] = ID_COLUMNS, text: str = "src",
    only: dict[str, str] | None = None, literals: str | None = None,
) -> DataFrame:
    """Findings of rule packs and plain matches of other rules, all read off the text in one pass.

    A row has the ids, ``grp`` (name of the pack or of the raw group), ``rule_id``, ``pos``, ``line``, and either the
    columns ``FOUND`` or the columns ``RAW``; the others are null. ``only`` gives a condition per pack, as Raw has it.
    ``literals`` names a column of decoded literals (:func:`normalise.decoded`), which become rows of the group
    ``literals`` with their kind as rule, their value as ``m`` and their round as ``g1``.
    """
    rules = [r for pack in packs.values() for r in pack]
    n_found = len(rules)
    whole = {}
    conditions = [(only or {}).get(name, "") for name, pack in packs.items() for _ in pack]
    names = [name for name, pack in packs.items() for _ in pack]
    for raw in raws:
        whole[raw.name] = (len(rules), len(rules) + len(raw.rules), raw)
        rules += raw.rules
        conditions += [raw.only] * len(raw.rules)
        names += [raw.name] * len(raw.rules)
    n_groups = max((r.groups for r in rules), default=0)
    hits = match_arrays(df, rules, ids, text, conditions if any(conditions) else (), literals)
    fields = ["g0", *[f"g{g}" for g in (1, 2) if g <= n_groups], "pos"]

    def value(r: Rule) -> str | None:
        if r.extract:
            return f"regexp_extract({window('h.pos', 0, r.extract[0])}, {rx(r.extract[1])}, 1)"
        return "h.g1" if r.value == "g1" else None

    def passes(r: Rule) -> str | None:
        tests = [_passes(g) for g in r.guards]
        if r.min_len:
            tests.append(f"length({trim_all('h.v')}) >= {r.min_len}")
        if r.extract:
            tests.append("h.v != ''")
        return " AND ".join(tests) if tests else None

    def context(r: Rule) -> str:
        if r.context_from == "match":
            shown = "substring(h.m, 1, 120)"
        else:
            shown = one_line(window("h.pos", *r.context))
        return trim_all(shown) if r.trim else shown

    def key(r: Rule) -> str | None:
        return {
            "full": "h.v",
            "value": f"substring(h.v, 1, {r.value_len})",
            "context60": "substring(h.context, 1, 60)",
            "artifact": "''",
            "none": None,
        }[r.dedupe]

    pack_rules = rules[:n_found]
    g1, g2 = ("coalesce(h.g1, '')" if n_groups >= 1 else "''"), ("coalesce(h.g2, '')" if n_groups >= 2 else "''")
    clean = _by_rule(pack_rules, lambda r: trim_all("h.v") if r.dedupe == "full" else None, "h.v")
    record = f"struct(coalesce({_by_rule(pack_rules, value, 'h.g0')}, '') AS v, h.pos AS pos, h.g0 AS m, {g2} AS g2)"
    shaped = (
        f"struct(h.pos AS pos, {clean} AS v, h.g2 AS g2, {_by_rule(pack_rules, context, chr(39) * 2)} AS context, "
        f"{line_of('h.pos')} AS line)"
    )
    # the first-occurrence key leads the struct, so sorting brings equal keys together by offset
    keyed = (
        f"struct({_by_rule(pack_rules, key, 'cast(h.pos AS string)')} AS key, h.pos AS pos, h.v AS v, "
        "h.g2 AS g2, h.context AS context, h.line AS line)"
    )
    found = f"transform(arrays_zip({', '.join(fields)}), h -> {record})"
    found = f"filter({found}, h -> {_by_rule(pack_rules, passes, 'true')})"
    found = f"array_sort(transform(transform({found}, h -> {shaped}), h -> {keyed}))"
    first = "filter(found, (x, i) -> i = 0 OR get(found, i - 1).key != x.key)"
    columns = [*ids, "ix", "size(g0) AS n"]
    if whole or literals:
        if not pack_rules:
            found = "cast(NULL AS array<struct<key: string, pos: int, v: string, g2: string, context: string, line: int>>)"

        def around(name: str, cut) -> str:
            whens = " ".join(f"WHEN ix BETWEEN {a} AND {b - 1} THEN {cut(raw)}" for a, b, raw in whole.values() if getattr(raw, name))
            return f"CASE {whens} ELSE '' END" if whens else "''"

        raw = (
            f"transform(arrays_zip({', '.join(fields)}), h -> struct(h.pos AS pos, h.g0 AS m, {g1} AS g1, {g2} AS g2, {line_of('h.pos')} AS line, "
            f"{around('before', lambda r: window('h.pos', r.before, 0))} AS before, {around('after', lambda r: window('h.pos', 0, r.after))} AS after))"
        )
        rows = hits.selectExpr(*columns, f"CASE WHEN ix < {n_found} THEN {found} END AS found", f"CASE WHEN ix >= {n_found} THEN {raw} END AS raw")
        as_raw = f"transform({first}, f -> struct(f.pos AS pos, f.v AS m, f.context AS g1, f.g2 AS g2, f.line AS line, '' AS before, '' AS after))"
        rows = rows.selectExpr(*ids, "ix", "n", f"inline(coalesce({as_raw}, raw))")
        # a finding travels as value and context in the columns of a match
        shape = {"v": "m", "context": "g1", "g2": "g2"}
    else:
        rows = hits.selectExpr(*columns, f"{found} AS found")
        rows = rows.selectExpr(*ids, "ix", "n", f"inline({first})")
        shape = {"v": "v", "context": "context", "g2": "g2"}

    def per_rule(attr) -> str:
        return _pick([quote(attr(r)) for r in pack_rules]) if pack_rules else "''"

    length = _pick([str(r.value_len) for r in pack_rules]) if pack_rules else "0"
    shown = f"replace({per_rule(lambda r: r.fmt)}, '{{v}}', substring({shape['v']}, 1, {length}))"
    shown = f"replace({shown}, '{{g2}}', substring({shape['g2']}, 1, 60))"
    shown = f"replace({shown}, '{{n}}', cast(n AS string))"
    severity = _by_rule(
        pack_rules,
        lambda r: f"CASE WHEN {shape['context']} RLIKE {rx(r.downgrade[0])} THEN {quote(r.downgrade[1])} "
        f"ELSE {quote(r.severity)} END"
        if r.downgrade
        else None,
        per_rule(lambda r: r.severity),
    )
    made = {
        "category": per_rule(lambda r: r.category), "severity": severity, "value": shown, "context": shape["context"],
        "description": per_rule(lambda r: r.description), "cwe": per_rule(lambda r: r.cwe),
    }
    kept = {c: c for c in RAW}
    if not (whole or literals):
        kept = {c: "cast(NULL AS string)" for c in RAW}
    elif pack_rules:
        made = {c: f"CASE WHEN ix < {n_found} THEN {e} END" for c, e in made.items()}
        kept = {c: f"CASE WHEN ix >= {n_found} THEN {e} END" for c, e in kept.items()}
    else:
        made = {c: "cast(NULL AS string)" for c in made}
    rule_ids, groups = [quote(r.rule_id) for r in rules], [quote(n) for n in names]
    if literals:  # the pseudo rule behind the others: its second group is the kind
        rule_id = f"CASE WHEN ix = {len(rules)} THEN g2 ELSE {_pick(rule_ids)} END"
        group = f"CASE WHEN ix = {len(rules)} THEN 'literals' ELSE {_pick(groups)} END"
    else:
        rule_id, group = _pick(rule_ids), _pick(groups)
    pos = "pos"
    if literals:  # places in the text of their round come with the literals
        mine = f"ix = {len(rules)}"
        pos = f"CASE WHEN {mine} THEN cast(split(g1, ':')[1] AS int) ELSE pos END"
        kept["g1"], kept["g2"] = f"CASE WHEN {mine} THEN split(g1, ':')[0] ELSE {kept['g1']} END", f"CASE WHEN {mine} THEN '' ELSE {kept['g2']} END"
    columns = {"grp": group, "rule_id": rule_id, "pos": pos, "line": "line", **made, **kept}
    return rows.selectExpr(*ids, *[f"{e} AS {c}" for c, e in columns.items()])


def findings_of(table: DataFrame, ids: Sequence[str] = ID_COLUMNS, packs: Sequence[str] = ()) -> DataFrame:
    """The findings in a match table, of all its packs or of those named."""
    rows = table.filter(F.col("grp").isin(*packs)) if packs else table
    found = ["rule_id", *FOUND, "pos", "line"]
    return rows.selectExpr(*ids, *found, "cast(NULL AS int) AS hop")


def raw_of(table: DataFrame, name: str, ids: Sequence[str] = ID_COLUMNS) -> DataFrame:
    """The plain matches of one raw group in a match table."""
    return table.filter(F.col("grp") == name).select(*ids, "rule_id", "pos", "line", *RAW, *[c for c in ("id",) if c in table.columns])


def scan_rules(
    df: DataFrame, rules: Sequence[Rule], ids: Sequence[str] = ID_COLUMNS, text: str = "src"
) -> DataFrame:
    """Findings of a rule pack: guards, first occurrence, context, line and truncation."""
    return findings_of(match_table(df, {"pack": rules}, ids=ids, text=text), ids)


def severity_rank(column: str = "severity") -> str:
    whens = " ".join(f"WHEN '{s}' THEN {rank}" for s, (rank, _) in SEVERITIES.items())
    return f"CASE {column} {whens} END"


def severity_weight(column: str = "severity") -> str:
    whens = " ".join(f"WHEN '{s}' THEN {weight}" for s, (_, weight) in SEVERITIES.items())
    return f"CASE {column} {whens} ELSE 0 END"


def order_findings(findings: DataFrame) -> DataFrame:
    """Most severe first, ties by artifact, offset and rule.

    A sort looks at its input twice, for the bounds of its ranges and for the rows, so the findings are written first.
    """
    return written(findings).orderBy(F.expr(severity_rank()), "artifact_id", "pos", "rule_id")
