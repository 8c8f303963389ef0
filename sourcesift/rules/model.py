"""The rule record and the severity scale."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession

from sourcesift.functions.text import local_table

# Severity -> (rank, score weight).
SEVERITIES = {
    "critical": (0, 10),
    "high": (1, 5),
    "medium": (2, 2),
    "low": (3, 1),
    "info": (4, 0),
}


#: What ``.`` does not match.
LINE_END = r"[\n\r\x{2028}\x{2029}]"
#: Group of a linear pattern that holds a character where the match only skips what can't match.
_SKIPPED = r"(?<=([\s\S]))"


class Linear(str):
    """A pattern (the text) and a spelling of it, ``linear``, that reads no stretch of text twice.

    Plain patterns such as ``exec\\([^)]*\\+`` try anew from every head and run to the same end each time when
    the tail is missing: quadratic on one long line. The linear spelling has a second branch that matches
    the stretch in which no later head can succeed either, and marks it: its last group, one after those of the
    pattern, is not empty there. A scan drops marked matches, so what is left are the matches of the pattern.

    With ``leads``, what can't match is skipped in front instead: the first group of the spelling holds it, the second
    the match, and those of the pattern follow. The end of the text counts as an empty match, so that the rest is
    read once. Patterns that fail at nearly every word take this form, which sets no mark where they fail.
    """

    linear: str
    leads: bool

    def __new__(cls, plain: str, linear: str, leads: bool = False) -> Linear:
        made = super().__new__(cls, plain)
        made.linear, made.leads = linear, leads
        return made


def _bare(pattern: str) -> str:
    """The pattern without groups of its own (it has no escaped parentheses in classes)."""
    return re.sub(r"(\\.|\[[^\]]*\])|\((?!\?)", lambda m: m.group(1) or "(?:", pattern)


def _led(first: str, more: str, then: str, pattern: str, skip: str = "") -> Linear:
    """``pattern``, a name and ``then``, after the names that ``then`` doesn't follow and whatever stands between names."""
    other = f"[^{first[1:]}" if first.startswith("[") else first.upper()
    names = f"{first}{more}*+(?!{_bare(then)})" + (f"(?:{skip})?+" if skip else "")
    return Linear(pattern, f"((?:{other}++|{names})*+)(?:({pattern})|\\z)", leads=True)


def span(head: str, char: str, tail: str, least: int = 0, lazy: bool = False, group: bool = False, stop: str = "") -> Linear:
    """``head``, any number of ``char``, ``tail``. Where a head finds no tail before the characters end, none of the
    heads among them does. ``stop`` matches where skipping must end: at a head that runs past them, or at
    another branch of the pattern; ``head`` may start with such branches, each followed by ``|``."""
    gap = char + ("+" if least else "*") + ("?" if lazy else "")
    gap = f"({gap})" if group else gap
    rest = f"(?:(?!{stop}){char})*+" if stop else f"{char}*+"
    return Linear(head + gap + tail, f"{head}(?:{gap}{tail}|{rest}{_SKIPPED})")


def name_then(first: str, more: str, then: str, skip: str = "") -> Linear:
    """A name (one ``first`` character, then ``more``) as group 1, then ``then``, which can't begin with such a character.

    Names end at the same place wherever they are entered, so a name that fails is skipped whole, with
    ``skip`` behind it if that matches."""
    return _led(first, more, then, f"({first}{more}*){then}", skip)


def member_then(first: str, more: str, then: str) -> Linear:
    """Two names with a dot between them as group 1, then ``then``, which can't begin with a character of a name."""
    member = rf"\.{first}{more}*"
    return _led(first, more, member + then, f"({first}{more}*{member}){then}")


def skip_names(pattern: str, name: str, unless: str = "") -> Linear:
    """A pattern that begins with a name (``name`` matches it whole, without its last ``*``); a name at which it fails
    is skipped whole, ``unless`` that follows, so that shorter ends of the name get their turn."""
    follows = f"(?!{unless})" if unless else ""
    return Linear(pattern, f"{pattern}|{name}*+{follows}{_SKIPPED}")


@dataclass(frozen=True)
class Guard:
    """Keep or drop a match by a regex on its value, a group, the match or a window around it."""

    on: str  # "value", "match", "g2" or "window"
    regex: str | Callable[[str], str]  # pattern, or a function from target SQL to predicate SQL
    keep: bool
    before: int = 0
    after: int = 0
    last: int = 0  # only the last n characters of the window


@dataclass(frozen=True)
class Rule:
    rule_id: str
    severity: str
    category: str
    pattern: str
    gate: tuple[str, ...] = ()  # literals, one of which every match contains
    groups: int = 0
    value: str = "match"  # "match" or "g1"
    value_len: int = 100
    min_len: int = 0
    guards: tuple[Guard, ...] = ()
    context: tuple[int, int] = (100, 100)
    context_from: str = "window"  # "window" or "match"
    trim: bool = False
    dedupe: str = "none"  # "none", "full", "value", "context60", "artifact"
    extract: tuple[int, str] | None = None  # value := group 1 of a regex on the next n characters
    fmt: str = "{v}"  # {v} value, {g2} group 2 (60 characters), {n} matches in the artifact
    downgrade: tuple[str, str] | None = None  # (context regex, severity)
    description: str = ""
    cwe: str = ""

    @property
    def ignore_case(self) -> bool:
        return self.pattern.startswith("(?i)")


def keep(regex: str, before: int, after: int, last: int = 0) -> Guard:
    return Guard("window", regex, True, before, after, last)


def drop(regex: str, before: int, after: int, last: int = 0) -> Guard:
    return Guard("window", regex, False, before, after, last)


def rules_table(spark: SparkSession, pack: str, rules: list[Rule]) -> DataFrame:
    """The pack as rows (pattern, gates and guards as text), for inspection or export."""
    names = [f.name for f in fields(Rule)]
    rows = [(pack, *[str(getattr(r, n)) for n in names]) for r in rules]
    return local_table(spark, rows, ", ".join(f"`{n}` string" for n in ["pack", *names]))
