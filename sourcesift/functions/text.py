"""SQL snippets for offsets, windows and line numbers over long texts.

Offsets are 0-based code points. A text is cut once into fixed-size blocks; a window or a line
number then touches two blocks instead of walking the text from its start, so the work per
artifact stays linear in its length plus its number of matches.

The snippets are Spark SQL text: one expression string per column keeps plan building cheap for
packs of many rules, where a call per node would dominate small jobs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcesift.functions.dialect import SPACE_CHARS, java_regex

BLOCK = 4096
_RUN = 256


def quote(value: str) -> str:
    """A Spark SQL string literal.

    ``${`` is written with an escaped dollar, or the parser would take it for a variable.
    """
    escaped = value.replace("\\", "\\\\").replace("'", "\\'").replace("${", "\\u0024{")
    return f"'{escaped}'"


def rx(pattern: str) -> str:
    """The rule pattern as a Spark SQL string literal in Java spelling."""
    return quote(java_regex(pattern))


def let(bound: dict[str, str], body: str) -> str:
    """``body`` with each expression evaluated once, in order, under its name."""
    for name, expression in reversed(bound.items()):
        body = f"element_at(transform(array({expression}), {name} -> {body}), 1)"
    return body


def _running_sum(array: str) -> str:
    """Inclusive running sum of a short integer array."""
    return (
        f"aggregate({array}, cast(array() AS array<int>), (acc, x) -> "
        "concat(acc, array(cast(coalesce(get(acc, size(acc) - 1), 0) + x AS int))))"
    )


def running_sum_runs(column: str) -> str:
    """Running sums inside runs of 256 elements; ``join_runs`` links them.

    ``column`` must be a plain column: it is read once per run.
    """
    return (
        f"transform(CASE WHEN size({column}) > 0 THEN sequence(0, size({column}) - 1, {_RUN}) END, "
        f"s -> {_running_sum(f'slice({column}, s + 1, {_RUN})')})"
    )


def join_runs(column: str) -> str:
    """Inclusive running sum over the whole array, from ``running_sum_runs`` output."""
    ends = _running_sum(f"transform({column}, r -> get(r, size(r) - 1))")
    return (
        f"flatten(zip_with({column}, {ends}, "
        "(run, end) -> transform(run, x -> x + end - get(run, size(run) - 1))))"
    )


def newline_count(text: str) -> str:
    # bytes, whose number is known, rather than characters, which would have to be counted
    return f"(octet_length({text}) - octet_length(replace({text}, '\\n', '')))"


# Characters of source code and prose, about the rarest first.
_RARE = "^?`ZXYQVFBPWG+[]JK|#MR8UDCN7H6L9_3O%$!&*SITz{}E-q4A5@jkxywvbhgfmupd"


def has(text: str, literal: str) -> str:
    """SQL test for a literal. ``contains`` compares wherever the first character occurs, so the part that begins with
    the literal's rarest character, if that is a rare one, is looked for before the whole of it."""
    places = [(_RARE.index(c), i) for i, c in enumerate(literal[:-2]) if c in _RARE]
    start = min(places, default=(0, 0))[1]
    whole = f"contains({text}, {quote(literal)})"
    return f"(contains({text}, {quote(literal[start:])}) AND {whole})" if start else whole


def text_runs(df: DataFrame, text: str) -> tuple[DataFrame, str]:
    """Add ``_blocks`` and ``_runs``; the second result is the SQL for ``_lines`` over them."""
    keep = df.columns
    cut = f"regexp_extract_all({text}, '(?s).{{1,{BLOCK}}}', 0)"
    blocks = f"CASE WHEN length({text}) <= {BLOCK} THEN array({text}) ELSE {cut} END AS _blocks"
    df = df.selectExpr(*keep, blocks)
    df = df.selectExpr(*keep, "_blocks", f"transform(_blocks, b -> {newline_count('b')}) AS _nl")
    df = df.selectExpr(*keep, "_blocks", "_nl", f"{running_sum_runs('_nl')} AS _runs")
    before = (
        "CASE WHEN size(_blocks) = 1 THEN array(0) "
        f"ELSE concat(array(0), {join_runs('_runs')}) END AS _lines"
    )
    return df, before


def with_text_index(df: DataFrame, text: str) -> DataFrame:
    """Add ``_blocks`` (the text in 4096-character pieces) and ``_lines`` (newlines before each)."""
    keep = df.columns
    df, lines = text_runs(df, text)
    return df.selectExpr(*keep, "_blocks", lines)


def window(pos: str, before: int, after: int) -> str:
    """Characters ``[pos-before, pos+after)`` of the indexed text, cut at its ends."""
    assert before + after <= BLOCK
    start = f"greatest({pos} - {before}, 0)"
    block = f"({start} div {BLOCK})"
    two = f"concat(coalesce(get(_blocks, cast({block} AS int)), ''), coalesce(get(_blocks, cast({block} + 1 AS int)), ''))"
    text = f"CASE WHEN size(_blocks) = 1 AND {pos} < {BLOCK} THEN get(_blocks, 0) ELSE {two} END"
    return f"substring({text}, cast({start} % {BLOCK} + 1 AS int), {pos} + {after} - {start})"


def line_of(pos: str) -> str:
    """1-based line of an offset in the indexed text."""
    block = f"cast({pos} div {BLOCK} AS int)"
    head = f"substring(get(_blocks, {block}), 1, cast({pos} % {BLOCK} AS int))"
    return f"cast(get(_lines, {block}) + {newline_count(head)} + 1 AS int)"


def trim_all(text: str) -> str:
    """Strip every kind of white space, not only blanks. Most texts have none at their ends, which is cheap to see."""
    spaces = quote(SPACE_CHARS)
    ends = f"contains({spaces}, left(whole, 1)) OR contains({spaces}, right(whole, 1))"
    return let({"whole": text}, f"CASE WHEN {ends} THEN btrim(whole, {spaces}) ELSE whole END")


def one_line(text: str) -> str:
    return f"replace({text}, '\\n', ' ')"


def matches(column: str, pattern: str) -> Column:
    """``rlike`` with a rule pattern."""
    return F.col(column).rlike(java_regex(pattern))


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small fixed table as literal rows of the plan, without a Python worker."""

    def cell(v) -> str:
        return "NULL" if v is None else quote(v) if isinstance(v, str) else str(v)

    columns = [c.strip().split() for c in schema.split(",")]
    structs = ", ".join(
        "struct(" + ", ".join(f"cast({cell(v)} AS {t}) AS {n}" for v, (n, t) in zip(row, columns)) + ")" for row in rows
    )
    if not rows:
        return spark.range(0).selectExpr(*[f"cast(NULL AS {t}) AS {n}" for n, t in columns])
    return spark.range(1).selectExpr(f"inline(array({structs}))")
