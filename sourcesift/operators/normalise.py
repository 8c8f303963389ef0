"""Text normalisation and literal decoding as projections (no shuffle but for small lookups)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcesift.functions.text import join_runs, let, local_table, quote, running_sum_runs, rx
from sourcesift.operators.matching import explode_matches
from sourcesift.rules import extraction as x


def replace_all(df: DataFrame, text: str, pairs: Sequence[tuple]) -> DataFrame:
    """Regex replacements in order; ``{1}`` in a replacement is group 1.

    The third element of a pair is a literal that every match contains: most texts are left after a test for it.
    """
    for pattern, replacement, *literal in pairs:
        to = replacement.replace("\\", "\\\\").replace("$", "\\$").replace("{1}", "$1")
        changed = f"regexp_replace({text}, {rx(pattern)}, {quote(to)})"
        gate = f"CASE WHEN contains({text}, {quote(literal[0])}) THEN {changed} ELSE {text} END" if literal else changed
        df = df.withColumn(text, F.expr(gate))
    return df


def _rewrite(df: DataFrame, expression: str, text: str) -> DataFrame:
    return df.withColumn(text, F.expr(expression))


def normalise_literals(df: DataFrame, text: str = "src") -> DataFrame:
    return replace_all(df, text, x.NORMALISE_LITERALS)


def cleanup_bundle(df: DataFrame, text: str = "src") -> DataFrame:
    return replace_all(df, text, x.CLEANUP_BUNDLE)


def brackets_to_dots(df: DataFrame, text: str = "src") -> DataFrame:
    return replace_all(df, text, x.BRACKETS_TO_DOTS)


def unescape_entities(df: DataFrame, text: str = "src") -> DataFrame:
    out = text
    for entity, char in x.ENTITIES:
        out = f"replace({out}, {quote(entity)}, {quote(char)})"
    count = F.expr(f"regexp_count({text}, {rx(x.ENTITY)})")
    return df.withColumn("n_entities", count).withColumn(text, F.expr(out))


def normalise(df: DataFrame, text: str = "src") -> DataFrame:
    """The steps that rewrite text, in the order the scanners expect: entities, literals, words, wrappers, brackets."""
    out = decode_text(unescape_entities(df, text).drop("n_entities"), text)
    return brackets_to_dots(cleanup_bundle(normalise_literals(out, text), text), text)


def normalise_with_literals(df: DataFrame, text: str = "src") -> DataFrame:
    """:func:`normalise`, with what was decoded on the way in the column ``literals``."""
    out = unescape_entities(df, text).drop("n_entities").withColumn("_d", F.expr(decoded(text)))
    out = out.withColumn(text, F.col("_d.src")).withColumn("literals", F.col("_d.found")).drop("_d")
    return brackets_to_dots(cleanup_bundle(normalise_literals(out, text), text), text)


def escape_stats(df: DataFrame, text: str = "src") -> DataFrame:
    unicode = " + ".join(f"regexp_count({text}, {rx(p)})" for p in x.UNICODE_ESCAPES)
    return df.selectExpr(
        "artifact_id",
        "path",
        f"{unicode} AS unicode_escapes",
        f"regexp_count({text}, {rx(x.HEX_ESCAPE)}) AS hex_escapes",
        f"regexp_count({text}, {rx(x.ENTITY)}) AS entities",
    )


def _values() -> list[str]:
    """Per kind of literal, SQL for the plain value of its group ``g``; null where it has none."""
    codes = (
        "filter(transform(split(g, ','), c -> try_cast(regexp_extract(trim(c), '^[+-]?[0-9]+', 0) AS int)), "
        "c -> c IS NOT NULL)"
    )
    units = "'UTF-16BE'"
    hexes = "filter(split(g, ','), h -> trim(h) != '')"
    from_hex = (
        f"decode(unhex(array_join(transform({hexes}, h -> lpad(substring(regexp_replace(h, {rx(r'\s')}, ''), 3), 4, '0')), '')), {units})"
    )
    parts = f"regexp_extract_all(g, {rx(x.STRING_LITERAL)}, 1)"
    printable = rx(r"^[ -~\t\n\r]+$")
    return [
        f"CASE WHEN size({codes}) > 0 THEN decode(unhex(array_join(transform({codes}, c -> lpad(hex(pmod(c, 65536)), 4, '0')), '')), {units}) END",
        "make_valid_utf8(cast(try_to_binary(g, 'base64') AS string))",
        f"CASE WHEN size({hexes}) >= 2 AND forall({hexes}, h -> h RLIKE {rx(r'^\s*0x[0-9a-fA-F]{1,4}\s*$')}) "
        f"THEN CASE WHEN {from_hex} RLIKE {printable} THEN {from_hex} END END",
        f"array_join({parts}, '')",
        f"CASE WHEN size({parts}) >= 2 THEN array_join({parts}, '') END",
    ]


def quoted(value: str) -> str:
    """SQL for a text as a double-quoted literal of source code; null for null."""
    return let({"q": f"CASE WHEN {value} IS NOT NULL THEN to_json(named_struct('v', {value})) END"}, "substring(q, 6, length(q) - 6)")


_FOUND = "array<struct<kind: string, round: int, pos: int, value: string>>"


def decoded(text: str) -> str:
    """SQL struct of a text with its encoded literals replaced by their plain values (``src``), and these (``found``).

    A round reads the text once, from left to right; values are spliced back, quoted, between the gaps,
    and what that makes whole is decoded in the next round, until nothing changes.
    """
    pattern = rx(x.literal("++"))
    kinds = " ".join(f"WHEN {i} THEN {quote(k)}" for i, k in enumerate(x.LITERAL_KINDS))
    groups = {f"a{i}": f"regexp_extract_all(t, {pattern}, {i + 1})" for i in range(len(x.LITERAL_KINDS))}
    which = " ".join(f"WHEN get(a{i}, i) != '' THEN {i}" for i in range(len(x.LITERAL_KINDS)))
    value = " ".join(f"WHEN {i} THEN {let({'g': f'get(a{i}, i)'}, v)}" for i, v in enumerate(_values()))
    bound = {
        "t": "acc.src", "gaps": f"split(t, {pattern}, -1)", "m": f"regexp_extract_all(t, {pattern}, 0)", **groups,
        "k": f"transform(m, (x, i) -> CASE {which} END)",
        "v": f"transform(m, (x, i) -> CASE get(k, i) {value} END)",
        "steps": "slice(zip_with(gaps, concat(array(0), transform(m, x -> length(x))), (gap, prior) -> length(gap) + prior), 1, size(m))",
        "runs": running_sum_runs("steps"), "places": join_runs("runs"),
    }
    spliced = f"array_join(zip_with(gaps, concat(transform(m, (x, i) -> coalesce({quoted('get(v, i)')}, x)), array('')), (gap, x) -> concat(gap, x)), '')"
    rows = f"filter(transform(m, (x, i) -> struct(CASE get(k, i) {kinds} END AS kind, round, get(places, i) AS pos, get(v, i) AS value)), f -> f.value IS NOT NULL)"
    step = let(bound, f"named_struct('src', {spliced}, 'found', cast(concat(acc.found, {rows}) AS {_FOUND}), 'more', exists(v, x -> x IS NOT NULL))")
    signs = " OR ".join([*(f"contains(acc.src, {quote(g)})" for g in x.LITERAL_SIGNS), f"acc.src RLIKE {rx(x.JOINED_SIGN)}"])
    return (
        f"aggregate(sequence(0, {x.LITERAL_ROUNDS - 1}), named_struct('src', {text}, 'found', cast(array() AS {_FOUND}), 'more', true), "
        f"(acc, round) -> CASE WHEN acc.more AND ({signs}) AND acc.src RLIKE {pattern} THEN {step} "
        "ELSE named_struct('src', acc.src, 'found', acc.found, 'more', false) END)"
    )


def decode_literals(df: DataFrame, text: str = "src") -> DataFrame:
    """Encoded literals and their plain values: char codes, base64, hex arrays, joined strings.

    A literal inside another has a later ``round``; ``pos`` counts in the text as its round found it, which is
    the text itself in round 0.
    """
    rows = df.selectExpr("artifact_id", "path", f"{decoded(text)} AS d")
    return rows.selectExpr("artifact_id", "path", "inline(d.found)")


def decode_text(df: DataFrame, text: str = "src") -> DataFrame:
    """The text with its encoded literals replaced by their plain values."""
    return _rewrite(df, f"({decoded(text)}).src", text)


def literals_as_artifacts(literals: DataFrame) -> DataFrame:
    """Decoded values as texts of their own, so that any rule pack can scan them."""
    at = "concat(path, '#', kind, '@', CASE WHEN round > 0 THEN concat(round, ':') ELSE '' END, pos)"
    return literals.selectExpr("artifact_id", f"{at} AS path", "value AS src")


def module_names(spark: SparkSession) -> DataFrame:
    """The module-id dictionary (a fixed few dozen rows)."""
    rows = [(str(k), v) for k, v in x.MODULE_NAMES.items()]
    return local_table(spark, rows, "module_id string, name string")


def symbols(spark: SparkSession) -> DataFrame:
    """The default short-name table; any table with these columns can take its place."""
    rows = [(f, s, full) for f, names in x.SYMBOLS.items() for s, full in names.items()]
    return local_table(spark, rows, "framework string, short string, full_name string")


def read_symbols(spark: SparkSession, path: str) -> DataFrame:
    """A short-name table of ones own (JSON lines or Parquet: framework, short, full_name), beside the default one.

    Its rows come before the defaults of the same framework and short name. Any store that Spark reads will do.
    """
    own = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.json(path, "framework string, short string, full_name string")
    own = own.select("framework", "short", "full_name").dropDuplicates(["framework", "short"])
    return own.unionByName(symbols(spark).join(own, ["framework", "short"], "left_anti").select("framework", "short", "full_name"))


def resolve_module_aliases(df: DataFrame, names: DataFrame, text: str = "src") -> DataFrame:
    """Variables bound to a module id, with the package name; the last binding of a name wins."""
    hits = explode_matches(df, x.ALIAS, text=text)
    last = hits.groupBy("artifact_id", "path", F.col("g1").alias("alias")).agg(
        F.max(F.struct("pos", F.col("g2").alias("module_id"))).alias("last")
    )
    out = last.select("artifact_id", "path", "alias", "last.module_id")
    return out.join(names, "module_id").select(
        "artifact_id", "path", "alias", "module_id", "name"
    )


def symbol_usage(df: DataFrame, names: DataFrame, text: str = "src") -> DataFrame:
    """Calls of known short names, with the full name, where the text shows the framework."""
    gates = ", ".join(
        f"CASE WHEN {text} RLIKE {rx(p)} THEN '{f}' END" for f, p in x.SYMBOL_GATES.items()
    )
    gated = df.selectExpr(
        "artifact_id", "path", text,
        f"array_join(array_compact(array('angular', 'rxjs', {gates})), ',') AS shown",
    )
    hits = explode_matches(gated, x.CALL_NAMES, ids=("artifact_id", "path", "shown"), text=text)
    hits = hits.groupBy("artifact_id", "path", "shown", F.col("g1").alias("short")).agg(
        F.count_if(F.col("rule_id") == "call").alias("calls"),
        F.count_if(F.col("rule_id") == "member").alias("members"),
    )
    used = hits.join(names, "short").filter(
        "array_contains(split(shown, ','), framework)"
    )
    return used.selectExpr(
        "artifact_id", "path", "framework", "full_name",
        "CASE WHEN framework = 'rxjs' THEN members ELSE calls END AS uses",
    ).filter("uses > 0").groupBy("artifact_id", "path", "framework", "full_name").agg(
        F.sum("uses").alias("uses")
    )


def strip_suppressions(df: DataFrame, marker: str = "scan-ignore", text: str = "src") -> DataFrame:
    pairs = [
        (rf"(?i)//\s*{marker}:\s*[\w\-, ]+(?:\s+next-line)?.*\n?", ""),
        (rf"(?i)/\*\s*{marker}:\s*[\w\-, ]+\s*\*/", ""),
    ]
    return replace_all(df, text, pairs)
