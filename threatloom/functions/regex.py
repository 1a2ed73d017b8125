"""Translates patterns in Python's syntax to the engines that run them.

Spark uses Java's syntax, DuckDB (the test oracle) uses RE2's.  Character classes
are spelled out, so ``\\w``, ``\\s``, ``\\d`` and ``\\b`` know Unicode in both as they
do in Python.
"""

from __future__ import annotations

import functools
import re
import warnings
from dataclasses import dataclass

#: Bodies of the classes, to stand inside brackets.
JAVA = {"w": r"\p{L}\p{N}_", "s": r"\p{IsWhite_Space}\x1c-\x1f", "d": r"\p{Nd}"}
RE2 = {"w": r"\p{L}\p{N}_", "s": r"\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x1c-\x1f", "d": r"\p{Nd}"}
_JAVA_BOUNDARY = r"(?:(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_])|(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_]))"


@dataclass(frozen=True)
class Pattern:
    """A pattern in Python's syntax and its flags."""

    source: str
    ignore_case: bool = True
    dot_all: bool = False
    multi_line: bool = False

    def java(self) -> str:
        # d: only \n ends a line; u: case folding knows Unicode
        flags = "d" + "iu" * self.ignore_case + "s" * self.dot_all + "m" * self.multi_line
        return f"(?{flags})" + _translated(self.source, JAVA, java=True)

    def needs(self) -> tuple[str, ...]:
        """Small ASCII strings of which any match holds one, or none if that can't be told."""
        return _needs(self.source)

    def needs_each(self) -> tuple[tuple[str, ...], ...]:
        """As :meth:`needs`, all that can be told: any match holds a string of each tuple."""
        return _needs_each(self.source)

    def re2(self) -> str:
        on = "i" * self.ignore_case + "s" * self.dot_all + "m" * self.multi_line
        off = "" if self.dot_all else "-s"
        return f"(?{on}{off})" * bool(on or off) + _translated(self.source, RE2, java=False)


#: Shortest string that is worth to be looked for, and most of them.
SHORTEST_NEED, MOST_NEEDS = 3, 8


@functools.lru_cache(maxsize=None)
def _needs_each(source: str) -> tuple[tuple[str, ...], ...]:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            options = _options(re._parser.parse(source))
        except re.error:
            return ()
    return tuple(tuple(sorted(o)) for o in sorted(set(options), key=_worth, reverse=True))


def _needs(source: str) -> tuple[str, ...]:
    return next(iter(_needs_each(source)), ())


def _worth(option: frozenset[str]) -> tuple:
    return min(map(len, option)) / len(option) ** 0.5, sorted(option)


def _options(items) -> list[frozenset[str]]:
    """What a sequence of parsed items needs: runs of literals, and what items that
    must occur need themselves."""
    options: list[frozenset[str]] = []
    run = ""

    def closed() -> None:
        nonlocal run
        if len(run) >= SHORTEST_NEED:
            options.append(frozenset((run,)))
        run = ""

    for name, value in items:
        name = str(name)
        if name == "LITERAL" and 32 < value < 127:
            run += chr(value).lower()
            continue
        closed()
        if name == "SUBPATTERN":
            options += _options(value[3])
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and value[0] > 0:
            options += _options(value[2])
        elif name == "BRANCH":
            each = [max(_options(b), key=_worth, default=frozenset()) for b in value[1]]
            if all(each) and len(both := frozenset().union(*each)) <= MOST_NEEDS:
                options.append(both)
    closed()
    return options


def _quantifier(source: str, at: int) -> bool:
    """Whether the brace at ``at`` opens a repetition such as ``{2}`` or ``{1,}``."""
    end = source.find("}", at)
    body = source[at + 1 : end] if end > 0 else ""
    low, _, high = body.partition(",")
    return low.isdigit() and (high == "" or high.isdigit())


def _escape(source: str, at: int, classes: dict[str, str], java: bool, inside: bool) -> tuple[str, int]:
    """What the escape that begins at ``at`` becomes, and how long it was."""
    c = source[at + 1]
    low = c.lower()
    if low in classes:
        if c == low:
            return (classes[low] if inside else f"[{classes[low]}]"), 2
        if not inside:
            return f"[^{classes[low]}]", 2
        return {"W": r"[^\p{L}\p{N}_]", "S": r"\P{IsWhite_Space}" if java else r"\S", "D": r"\P{Nd}"}[c], 2
    if c == "b" and not inside:
        return (_JAVA_BOUNDARY if java else r"\b"), 2
    if c == "U":
        return f"\\x{{{source[at + 2 : at + 10].lstrip('0')}}}", 10
    if c == "u":
        return f"\\x{{{source[at + 2 : at + 6]}}}", 6
    return source[at : at + 2], 2


def _translated(source: str, classes: dict[str, str], java: bool) -> str:
    out, at, inside = [], 0, False
    quantified = 0
    while at < len(source):
        c = source[at]
        if c == "\\":
            piece, length = _escape(source, at, classes, java, inside)
            out.append(piece)
            at += length
            continue
        if inside:
            if c == "]":
                inside = False
            elif java and (c == "[" or source.startswith("&&", at)):
                out.append("\\")
        elif c == "[":
            inside = True
            # a bracket right after the opening is an ordinary character
            start = at + 2 if source.startswith("[^", at) else at + 1
            if source[start : start + 1] == "]":
                out.append(source[at:start] + "\\]")
                at = start + 1
                continue
        elif c == "{":
            if _quantifier(source, at):
                quantified += 1
            else:
                out.append("\\")
        elif c == "}":
            if quantified:
                quantified -= 1
            else:
                out.append("\\")
        elif java and source.startswith("(?P<", at):
            out.append("(?<")
            at += 4
            continue
        out.append(c)
        at += 1
    return "".join(out)
