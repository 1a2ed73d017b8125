"""Quality rules: statistics of each text and a learned decision list, in
DataFrame functions only.

The list is learned by sequential covering.  A rule is a conjunction of
threshold conditions on the statistics; it grows by the condition with the best
information gain on the growing part of the labelled rows, is pruned to the
prefix that does best on the pruning part, and is kept if it is precise enough
there; the rows it covers are then set aside.  What is needed for each step is a
histogram (statistic, bin, label, part), counted by Spark over all labelled rows
and of fixed size, so neither rows nor anything that grows comes to the driver.
The learned list becomes an ordered ``CASE WHEN`` expression.

Defined cases: null text counts as empty; a document that no rule covers is kept
unless the base rule fails it; with no labels the list is empty; labels that are
null, or differ for one id, are left out, repeated ones count once; a null id
has no label; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom.llm.common import WORD_RX, cut, let

#: Words in a window of the repetition count.
WINDOW = 8
#: Quantiles of each statistic that serve as thresholds.
QUANTILES = [0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.95, 0.98, 0.99]
#: Bounds of the list, by default: conditions of a rule, and rules.  Learning ends there.
MOST_CONDITIONS, MOST_RULES = 4, 12
#: A rule is kept if so many of the pruning rows it covers are bad, and it covers so many of them.
LEAST_PRECISION, LEAST_COVERED = 0.9, 5


def repeated_words(words: Column, n: int = WINDOW) -> Column:
    """Number of words that lie in an ``n``-word window found twice or more."""

    def covered(windows: Column) -> Column:
        def repeats(s: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
            twice = F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1))
            starts = F.sort_array(F.transform(twice, lambda x: x["at"]))
            first = F.struct(F.lit(-n).alias("last"), F.lit(0).alias("total"))
            step = lambda acc, at: F.struct(at.alias("last"), (acc["total"] + F.least(F.lit(n), at - acc["last"])).alias("total"))
            return F.aggregate(starts, first, step, lambda acc: acc["total"])

        by_hash = F.sort_array(F.transform(windows, lambda h, at: F.struct(h.alias("h"), at.alias("at"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(by_hash, repeats))

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.xxhash64(F.slice(words, i, n)))
    return F.when(F.size(words) < n, F.lit(0)).otherwise(let(hashes, covered))


def statistics(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Counts for each row of ``df``, under ``_id`` and their names."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    one = df.select(F.col(id_col).alias("_id"), text.alias("_text"), F.regexp_extract_all(text, F.lit(WORD_RX), F.lit(0)).alias("_words"))
    one = one.withColumn("_lines", F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(WORD_RX)))
    count = lambda rx: F.regexp_count("_text", F.lit(rx)).cast("long")
    return one.select(
        "_id",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        count("[#*$%&|<>]").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("_words")).cast("long").alias("n_distinct"),
        count("[A-Z]").alias("n_upper"),
        count("[0-9]").alias("n_digits"),
        count("[.,;:!?]").alias("n_marks"),
        count("[!?]").alias("n_cries"),
    )


def _per(a: str, b: str) -> Column:
    return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))


#: The statistics that conditions may test, from the counts.
FEATURES: dict[str, Callable[[], Column]] = {
    "words": lambda: F.col("n_words").cast("double"),
    "chars_per_word": lambda: _per("word_chars", "n_words"),
    "symbols_per_word": lambda: _per("n_symbols", "n_words"),
    "dup_line_share": lambda: _per("n_dup_lines", "n_lines"),
    "repeat_share": lambda: _per("n_repeat_words", "n_words"),
    "words_per_line": lambda: _per("n_words", "n_lines"),
    "distinct_share": lambda: _per("n_distinct", "n_words"),
    "upper_share": lambda: _per("n_upper", "word_chars"),
    "digit_share": lambda: _per("n_digits", "word_chars"),
    "marks_per_word": lambda: _per("n_marks", "n_words"),
    "cries_per_word": lambda: _per("n_cries", "n_words"),
}


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def column(self) -> Column:
        value = FEATURES[self.feature]()
        return value >= self.threshold if self.at_least else value < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:g}"


Rule = tuple[Condition, ...]


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


def verdict(rules: list[Rule]) -> Column:
    """The list as an ordered conditional expression: the first rule that holds decides."""
    out = F.lit(True) if not rules else None
    for rule in rules:
        holds = reduce(Column.__and__, [c.column() for c in rule])
        out = F.when(holds, F.lit(False)) if out is None else out.when(holds, F.lit(False))
    return out.otherwise(F.lit(True)) if rules else out


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def learn(stats: DataFrame, labels: DataFrame, most_rules: int = MOST_RULES, most_conditions: int = MOST_CONDITIONS) -> list[Rule]:
    """Rules for bad rows: ``most_rules`` of ``most_conditions`` conditions each at
    most.  ``labels`` has ``_id`` and ``_bad`` (0 or 1)."""
    one = labels.where("_id IS NOT NULL AND _bad IS NOT NULL").groupBy("_id").agg(F.min("_bad").alias("_bad"), F.max("_bad").alias("_other")).where("_bad = _other")
    rows = stats.where(~base_failed()).join(one, "_id").select("_id", "_bad", *[f().alias(k) for k, f in FEATURES.items()])
    rows = cut(rows)
    names = list(FEATURES)
    got = rows.agg(*[F.percentile_approx(k, QUANTILES, 10_000).alias(k) for k in names]).first()
    cuts = {k: sorted(set(got[k] or [])) for k in names}

    def bin_of(k: str) -> Column:
        value = F.col(k)
        return F.size(F.filter(F.array(*[F.lit(float(t)) for t in cuts[k]]), lambda t: value >= t)) if cuts[k] else F.lit(0)

    bins = F.array(*map(bin_of, names))
    part = F.pmod(F.xxhash64("_id", F.lit(5)), F.lit(3)) == 0
    data = cut(rows.select(F.col("_bad").cast("int").alias("bad"), part.alias("prune"), bins.alias("bins")))

    def test(c: tuple[int, int, bool]) -> Column:
        feature, bin_, above = c
        return (F.col("bins")[feature] > bin_) if above else (F.col("bins")[feature] <= bin_)

    def histogram(active: Column) -> dict[tuple[int, int, int, bool], int]:
        seen = data.where(active).select("bad", "prune", F.posexplode("bins").alias("f", "b")).groupBy("f", "b", "bad", "prune").count()
        return {(r["f"], r["b"], r["bad"], r["prune"]): r["count"] for r in seen.collect()}

    def counts(h: dict, c: tuple[int, int, bool] | None, prune: bool) -> tuple[int, int]:
        feature, bin_, above = c or (0, -1, True)
        return tuple(sum(n for (f, b, bad, part), n in h.items() if f == feature and part == prune and bad == want and (b > bin_ if above else b <= bin_)) for want in (1, 0))

    rules: list[Rule] = []
    active = F.lit(True)
    while len(rules) < most_rules:
        h = histogram(active)
        chosen: list[tuple[int, int, bool]] = []
        scores: list[tuple[float, int, float]] = []  # of each prefix on the pruning part
        inside = active
        while len(chosen) < most_conditions:
            p0, n0 = counts(h, None, False)
            if not p0 or not n0:
                break
            options = [(f, b, above) for f, k in enumerate(names) for b in range(len(cuts[k])) for above in (True, False)]
            best = max(options, key=lambda c: (_gain(*counts(h, c, False), p0, n0), c), default=None)
            if best is None or _gain(*counts(h, best, False), p0, n0) <= 1e-9:
                break
            p, n = counts(h, best, True)
            chosen.append(best)
            scores.append(((p - n) / (p + n) if p + n else -1.0, p, p / (p + n) if p + n else 0.0))
            inside = inside & test(best)
            h = histogram(inside)
        if not chosen:
            break
        size = max(range(len(chosen)), key=lambda k: (scores[k][0], -k)) + 1
        if scores[size - 1][2] < LEAST_PRECISION or scores[size - 1][1] < LEAST_COVERED:
            break
        rule = chosen[:size]
        rules.append(tuple(Condition(names[f], above, float(cuts[names[f]][b])) for f, b, above in rule))
        active = active & ~reduce(Column.__and__, [test(c) for c in rule])
    return rules


def apply_rules(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_rules: int = MOST_RULES, most_conditions: int = MOST_CONDITIONS) -> DataFrame:
    """``<id_col>, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept`` for each row; the list is learned from ``labels``."""
    stats = cut(statistics(df, id_col, text_col))
    rules = learn(stats, labels, most_rules, most_conditions)
    return stats.select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept"),
    )
