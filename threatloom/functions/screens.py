"""Screens: cheap tests of a text that tell which rules may match it.

Java's patterns cost far more on a text than plain searches do, and few texts hold
what a rule needs.  A screen runs its tests in one Arrow function; the rules stay
columns, which only see texts that passed.  A test may pass too often, never too
rarely: results are those of the rules.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatloom.functions.columns import UNUSUAL
from threatloom.functions.regex import Pattern

#: Letters that are such for every version of Unicode, for classes.
LATIN = "a-zA-Z0-9À-ÖØ-öø-ɏ"


class Text:
    """A text, and what several tests ask of it."""

    def __init__(self, text: str) -> None:
        self.text = text

    @cached_property
    def low(self) -> str:
        """As :func:`threatloom.functions.columns.small`."""
        low = self.text.lower()
        if not low.isascii():
            for unusual, letter in UNUSUAL.items():
                low = low.replace(unusual, letter)
        return low

    @cached_property
    def words(self) -> list[str]:
        return self.text.split()

    @cached_property
    def lengths(self) -> list[int]:
        return list(map(len, self.words))

    @cached_property
    def longest(self) -> int:
        return max(self.lengths, default=0)

    @cached_property
    def foreign(self) -> set[str]:
        """The different characters, if any is not ASCII."""
        return set() if self.text.isascii() else set(self.text)


Test = Callable[[Text], bool]


@dataclass(frozen=True)
class MayMatch:
    """Whether any of the patterns may match, by the strings that their matches hold
    and the longest word that these are in."""

    needs: tuple[tuple[int, tuple[tuple[str, ...], ...]], ...]

    @staticmethod
    def of(patterns: Iterable[Pattern]) -> MayMatch:
        return MayMatch(tuple((_run(p.source), p.needs_each()) for p in patterns))

    def __call__(self, t: Text) -> bool:
        low = t.low
        for run, each in self.needs:
            if run and t.longest < run:
                continue
            for strings in each:
                for s in strings:
                    if s in low:
                        break
                else:
                    break
            else:
                return True
        return False


def _run(source: str) -> int:
    """Fewest characters, none of them white space, of a repeated class in each match."""
    try:
        items = re._parser.parse(source)
    except re.error:
        return 0
    least = 0
    for name, value in items:
        if str(name) == "MAX_REPEAT" and len(value[2]) == 1 and str(value[2][0][0]) == "IN":
            parts = value[2][0][1]
            ends = [v if str(n) == "RANGE" else (v, v) for n, v in parts if str(n) in ("RANGE", "LITERAL")]
            if len(ends) == len(parts) and all(32 < a and b < 127 for a, b in ends):
                least = max(least, value[0])
    return least


def most_equal(items: Iterable[str]) -> int:
    return max(Counter(items).values(), default=0)


def all_of(pattern: Pattern) -> frozenset[str]:
    """The characters of a class."""
    [(_, items)] = re._parser.parse(pattern.source)
    spans = [value if str(name) == "RANGE" else (value, value) for name, value in items]
    return frozenset(chr(c) for first, last in spans for c in range(first, last + 1))


Seen = Callable[[str], Column]


def unscreened(name: str) -> Column:
    """What detectors take for a screen's tests where there is none: all may match."""
    return F.lit(True)


class Screen:
    """Named tests, run together.  Arrow functions can't stand within higher-order
    ones, so what the tests say is a column of the table first."""

    COLUMN = "_screen"

    def __init__(self, **tests: Test) -> None:
        self.names = list(tests)
        run = list(enumerate(tests.values()))

        def flags(texts: pa.Array) -> pa.Array:
            found = []
            for text in texts.to_pylist():
                t = Text(text or "")
                found.append(sum(1 << k for k, test in run if test(t)))
            return pa.array(found, pa.int64())

        self._flags = F.arrow_udf(flags, T.LongType())

    def over(self, df: DataFrame, text: Column) -> DataFrame:
        """``df`` with the screen's column; drop it in the end."""
        return df.withColumn(self.COLUMN, self._flags(text))

    def seen(self, name: str) -> Column:
        """Whether the text of a row of :meth:`over` may have what the test looks for."""
        return F.col(self.COLUMN).bitwiseAND(F.lit(1 << self.names.index(name))) != 0
