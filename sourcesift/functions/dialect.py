"""One regular-expression text, spelled for Spark (Java) and for DuckDB (RE2).

Rules are written in the JavaScript flavour the rule authors use: ``\\s`` covers the Unicode
spaces, ``.`` stops at line ends, ``\\b`` and ``\\w`` are ASCII and ``$`` is the end of the text.
Java and RE2 read those tokens differently, so each is spelled out for the engine at hand.
Lookaround is not portable and is expressed as match + post-filter. The one rule with a backreference is
stated without it where RE2 is asked.
"""

from __future__ import annotations

import re
from functools import lru_cache

_SPACES = (
    r"\t\n\x0b\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
)
# the same set as characters, for trimming
SPACE_CHARS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
# for Java, which asks each part of a class in turn: other characters fail the first two questions
_JAVA_SPACE = (
    r"[\t\n\x0b\f\r \x{a0}[\x{1680}-\x{feff}&&[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]]]"
)
# ranges in classes: Java looks single characters up in one table, but asks range by range
_RANGE = re.compile("[0-9]-[0-9]|[A-Z]-[A-Z]|[a-z]-[a-z]")
_NOT_LINE_END = r"[^\n\r\x{2028}\x{2029}]"
_WORD = r"\w"  # ASCII in Java, and one question where the class spelled out is four
_CODE = re.compile(r"\\(?:x[0-9A-Fa-f]{2}|x\{[0-9A-Fa-f]+\}|u[0-9A-Fa-f]{4})")


_EDGE = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
_OPENS_WORD = re.compile(r"\w|\\[dw]|\[A-Z|\(\?:[\w(]")


def _java_word_edge(before: str, after: str) -> str:
    """ASCII ``\\b``: one cheap lookbehind where it plainly opens a word, else the exact test."""
    opens = not before or before.endswith(("|", "(", "(?:", "(?i)"))
    return f"(?<!{_WORD})" if opens and _OPENS_WORD.match(after) else _EDGE


def _respell(pattern: str, java: bool) -> str:
    out, in_class, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            code = _CODE.match(pattern, i)
            token = code.group() if code else pattern[i : i + 2]
            i += len(token)
            if token == "\\s":
                out.append(_SPACES if in_class else _JAVA_SPACE if java else f"[{_SPACES}]")
            elif token == "\\S" and not in_class:
                out.append(f"[^{_SPACES}]")
            elif token == "\\b" and not in_class:
                edge = _java_word_edge(pattern[: i - 2], pattern[i:])
                out.append(edge if java else "\\b")
            else:
                out.append(token)
            continue
        if in_class:
            if c == "]":
                in_class = False
            elif java and _RANGE.match(pattern, i) and pattern[i] < pattern[i + 2]:
                out.append("".join(map(chr, range(ord(c), ord(pattern[i + 2]) + 1))))
                i += 3
                continue
            out.append("\\[" if c == "[" else "\\&" if c == "&" else c)
        elif c == "[":
            in_class = True
            out.append(c)
        elif c == ".":
            out.append(_NOT_LINE_END)
        elif c == "$":
            out.append("\\z")
        else:
            out.append(c)
        i += 1
    return "".join(out)


@lru_cache(maxsize=None)
def java_regex(pattern: str) -> str:
    """The pattern as Spark's regexp functions read it."""
    out = _respell(pattern, java=True)
    # a repeated group at the very end may as well be possessive: same matches, no stack use
    return out + "+" if out.endswith(")*") else out[:-1] + "+)" if out.endswith(")+)") else out


@lru_cache(maxsize=None)
def re2_regex(pattern: str) -> str:
    """The pattern as DuckDB's regexp functions read it."""
    return _respell(pattern, java=False)


def sql_text(value: str) -> str:
    """A single-quoted SQL literal (standard quoting, no backslash escapes)."""
    return "'" + value.replace("'", "''") + "'"
