"""Detections, severity and verdicts.

A detection is a struct; detectors give an array of them for each row, in the
order of their rules.  ``Rule`` and its helpers compile pattern rules to columns
that stay in the JVM, and to DuckDB SQL for the tests.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from threatloom.functions.columns import let, match, may_match, small
from threatloom.functions.regex import Pattern

#: Severity from low to high, and its usual verdict.
LEVELS = ("none", "low", "medium", "high", "critical")
ALLOW, SANITIZE, CHALLENGE, QUARANTINE, BLOCK = "allow", "sanitize", "challenge", "quarantine", "block"
USUAL = {"none": ALLOW, "low": SANITIZE, "medium": CHALLENGE, "high": QUARANTINE, "critical": BLOCK}

DETECTION = (
    "struct<signature_id:string,category:string,level:string,verdict:string,description:string,"
    "evidence:string,layer:string,confidence:double,metadata:map<string,string>>"
)
DETECTIONS = f"array<{DETECTION}>"
#: Longest evidence that is kept.
EVIDENCE = 200


def detection(signature: str, category: str, level: str | Column, verdict: str | Column, description: str | Column, evidence: Column, layer: str, confidence: float | Column, metadata: Column | None = None) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        F.lit(signature).alias("signature_id"),
        F.lit(category).alias("category"),
        as_col(level).alias("level"),
        as_col(verdict).alias("verdict"),
        as_col(description).alias("description"),
        F.substring(evidence.cast("string"), 1, EVIDENCE).alias("evidence"),
        F.lit(layer).alias("layer"),
        as_col(confidence).cast("double").alias("confidence"),
        (metadata if metadata is not None else F.lit(None)).cast("map<string,string>").alias("metadata"),
    )


@dataclass(frozen=True)
class Rule:
    """A pattern that, where it matches, gives a detection with the match as evidence."""

    signature: str
    pattern: Pattern
    description: str
    level: str
    category: str
    layer: str
    confidence: float
    verdict: str | None = None

    def column(self, text: Column, low: Column | None = None) -> Column:
        """The detection, or null; with ``low``, the text in small letters, the
        pattern is only run where it may match."""
        found = lambda m: F.when(m.isNotNull(), detection(self.signature, self.category, self.level, self.verdict or USUAL[self.level], self.description, m, self.layer, self.confidence))
        return gated(let(match(text, self.pattern), found), low, self.pattern)

    def sql(self, text: str) -> str:
        """DuckDB: whether the rule matches."""
        return f"regexp_matches({text}, {quoted(self.pattern.re2())})"


def gated(found: Column, low: Column | None, pattern: Pattern) -> Column:
    """``found`` where the pattern may match, else null."""
    gate = may_match(low, pattern) if low is not None else None
    return found if gate is None else F.when(gate, found)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def present(columns: Iterable[Column]) -> Column:
    """The detections among ``columns`` that are not null, in order."""
    columns = list(columns)
    if not columns:
        return F.array().cast(DETECTIONS)
    return F.filter(F.array(*columns), lambda d: d.isNotNull()).cast(DETECTIONS)


def where(condition: Column, detections: Column) -> Column:
    """``detections`` where the condition holds, else none."""
    return F.when(condition, detections).otherwise(F.array().cast(DETECTIONS))


def all_hits(text: Column, rules: Iterable[Rule]) -> Column:
    """A detection for each rule that matches."""
    rules = list(rules)
    return let(small(text), lambda low: present(r.column(text, low) for r in rules))


def first_hit(text: Column, rules: Iterable[Rule]) -> Column:
    """The detection of the first rule that matches, or null; later rules are not run."""
    rules = list(rules)
    return let(small(text), lambda low: F.coalesce(*[r.column(text, low) for r in rules]))


def first_of_each(text: Column, rules: Iterable[Rule]) -> Column:
    """The first hit of each signature, in order."""
    by_signature: dict[str, list[Rule]] = {}
    for r in rules:
        by_signature.setdefault(r.signature, []).append(r)
    return let(small(text), lambda low: present(F.coalesce(*[r.column(text, low) for r in group]) for group in by_signature.values()))


def rank(level: Column) -> Column:
    """0 for none up to 4 for critical."""
    return F.array_position(F.array(*map(F.lit, LEVELS)), level) - 1


def worst_rank(detections: Column) -> Column:
    """Rank of the worst level, 0 if there is no detection."""
    return F.coalesce(F.array_max(F.transform(detections, lambda d: rank(d["level"]))), F.lit(0))


def worst_level(detections: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, LEVELS)), (worst_rank(detections) + 1).cast("int"))


def verdict_by_level(detections: Column, by_level: dict[str, str], default: str) -> Column:
    """The verdict for the worst level; allow if there is no detection."""
    out = F.when(F.size(detections) == 0, F.lit(ALLOW))
    level = worst_level(detections)
    for name, verdict in by_level.items():
        out = out.when(level == name, F.lit(verdict))
    return out.otherwise(F.lit(default))


def is_blocked(verdict: Column) -> Column:
    return verdict.isin(BLOCK, QUARANTINE)


def once_each(detections: Column) -> Column:
    """The first detection of each signature."""
    seen = F.transform(detections, lambda d: d["signature_id"])
    return F.filter(detections, lambda d, k: F.array_position(seen, d["signature_id"]) == k + 1)


def worst_of_each(detections: Column) -> Column:
    """The worst detection of each signature, the first among equals, in order of first occurrence."""

    def best(first: Column) -> Column:
        same = F.filter(detections, lambda d: d["signature_id"] == first["signature_id"])
        return let(same, lambda s: F.filter(s, lambda d: rank(d["level"]) == worst_rank(s))[0])

    return F.transform(once_each(detections), best)


def signatures(detections: Column) -> Column:
    """The signature ids, joined by commas."""
    return F.array_join(F.transform(detections, lambda d: d["signature_id"]), ",")


def decided(detections: Column, verdict: Column, sanitized: Column | None = None) -> list[Column]:
    """The columns of a decision."""
    return [
        detections.alias("detections"),
        verdict.alias("verdict"),
        F.size(detections).alias("threat_count"),
        worst_level(detections).alias("max_threat_level"),
        is_blocked(verdict).alias("is_blocked"),
        (sanitized if sanitized is not None else F.lit(None).cast("string")).alias("sanitized"),
    ]


# --- DuckDB ---------------------------------------------------------------


def sql_list(parts: Iterable[tuple[str, str]]) -> str:
    """DuckDB: comma-joined names of those (condition, name) whose condition holds."""
    cases = ", ".join(f"CASE WHEN {cond} THEN {quoted(name)} END" for cond, name in parts)
    return f"array_to_string(list_filter([{cases}], lambda x: x IS NOT NULL), ',')"


def sql_first(rules: Iterable[Rule], text: str) -> str:
    """DuckDB: whether any of the rules matches."""
    return "(" + " OR ".join(r.sql(text) for r in rules) + ")"
