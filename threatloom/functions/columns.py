"""Column functions shared by the detectors."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from threatloom.functions.regex import JAVA, Pattern

#: Python's white space, for ``split()`` without arguments.
SPACES = f"[{JAVA['s']}]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


#: Letters that patterns without case take for i, s, but that do not become these in
#: small letters (the first is what \u0130 becomes).
UNUSUAL = {"i\u0307": "i", "\u017f": "s", "\u0130": "i", "\u0131": "i"}


def beyond_ascii(text: Column) -> Column:
    """Whether a text has a character that is not ASCII; the others need no look at characters."""
    return F.length(text) < F.octet_length(text)


def foreign(text: Column) -> Column:
    """The characters beyond ASCII."""
    return F.regexp_replace(text, "[\\x00-\\x7F]+", "")


def small(text: Column) -> Column:
    """The text in small letters, for :func:`may_match`."""
    plain = F.lower(text)
    for unusual, letter in UNUSUAL.items():
        plain = F.replace(plain, F.lit(unusual), F.lit(letter))
    return F.when(beyond_ascii(text), plain).otherwise(F.lower(text))


def may_match(low: Column, pattern: Pattern) -> Column | None:
    """A cheap condition that holds wherever the pattern matches the text that
    :func:`small` made ``low`` of: searches for strings that a match must have, which
    cost a fraction of a pattern's.  None if the pattern has no such strings."""
    needs = [low.contains(s) for s in pattern.needs()]
    return functools.reduce(operator.or_, needs) if needs else None


def match(text: Column, pattern: Pattern, group: int = 0) -> Column:
    """The first match, or null."""
    return F.nullif(F.regexp_extract(text, pattern.java(), group), F.lit(""))


def matches(text: Column, pattern: Pattern) -> Column:
    return text.rlike(pattern.java())


def match_count(text: Column, pattern: Pattern) -> Column:
    return F.regexp_count(text, F.lit(pattern.java()))


def all_matches(text: Column, pattern: Pattern, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern.java()), F.lit(group))


def words(text: Column) -> Column:
    """As Python's ``split()``: words between white space, none empty."""
    return F.array_remove(F.split(text, SPACES), "")


def non_ascii(text: Column) -> Column:
    """Number of characters beyond ASCII."""
    return F.length(foreign(text))


def entropy(text: Column) -> Column:
    """Shannon entropy in bits for each character."""
    chars = F.split(text, "")
    size = F.size(chars)

    def share(c: Column) -> Column:
        n = F.size(F.filter(chars, lambda x: x == c)) / size
        return -n * F.log2(n)

    total = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc + share(c))
    return F.when(F.length(text) > 0, total).otherwise(0.0)


def safe_text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))
