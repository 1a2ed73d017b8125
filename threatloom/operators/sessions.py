"""State folds over the rows of a session: escalation and anomaly scores.

Each fold depends on the order of its session's rows.  Rows are brought to their
session's partition, sorted, and folded in batches by one pass that holds the
state of one session: memory does not grow with a session.  The scores of single
rows are column expressions.

Null sessions count as one session named by null; null texts score 0; rows with
equal times follow their id.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatloom.functions.columns import matches, safe_text
from threatloom.functions.regex import Pattern
from threatloom.operators.detection import BLOCK, CHALLENGE, QUARANTINE, decided, detection, present, worst_level
from threatloom.operators.settings import DEFAULT, Settings

# Topics and their weights.
TOPICS = {
    "hack": 3.0, "exploit": 3.0, "bypass": 3.0, "override": 3.0, "jailbreak": 4.0, "inject": 3.0, "injection": 3.0, "vulnerability": 2.5, "attack": 2.5, "malicious": 3.0,
    "reverse shell": 4.0, "privilege escalation": 3.5, "password": 1.5, "credential": 2.0, "private key": 3.0, "mnemonic": 2.5, "seed phrase": 3.0, "wallet drain": 4.0,
    "security": 0.5, "encryption": 0.5, "token": 0.8, "permission": 0.8, "access control": 1.0, "authentication": 0.8, "obfuscate": 1.5, "encode": 0.8, "decode": 0.8,
    "disable": 1.5, "unrestricted": 2.5, "no filter": 2.5, "no restriction": 2.5, "safety off": 3.0,
}
TRANSITION = Pattern(
    r"(?:now\s+(?:that|since)|building\s+on\s+(?:that|this)|great[,!]?\s+(?:so|now)|perfect[,!]?\s+(?:so|now)|okay\s+(?:so|now)|good[,!]?\s+(?:so|now)|"
    r"thanks?[,!]?\s+(?:so|now|can)|(?:moving|let'?s?\s+move)\s+(?:on|forward)|next\s+step|step\s+\d+)"
)
POINTS = {"none": 0, "low": 5, "medium": 15, "high": 30, "critical": 50}
#: Pairs of categories that make a chain within ``CHAIN_SECONDS``, and its level.
CHAINS = [
    (("prompt_injection", "tool_exploitation"), "injection and tools", "critical"),
    (("data_exfiltration", "tool_exploitation"), "data and tools", "critical"),
    (("memory_poisoning", "prompt_injection"), "memory and injection", "high"),
    (("unicode_smuggling", "prompt_injection"), "smuggled characters and injection", "high"),
]
CHAIN_SECONDS = 300


def topic_score(text: Column) -> Column:
    """Weights of the topics that a text names."""
    low = F.lower(safe_text(text))
    parts = [F.when(low.contains(k), w).otherwise(0.0) for k, w in TOPICS.items()]
    return F.aggregate(F.array(*parts), F.lit(0.0), lambda a, b: a + b)


def is_transition(text: Column) -> Column:
    return matches(safe_text(text), TRANSITION)


@dataclass
class Escalation:
    """State of a conversation."""

    scores: deque = field(default_factory=lambda: deque(maxlen=20))
    cumulative: float = 0.0
    seen: float | None = None
    transitions: int = 0

    def step(self, at: float, score: float, transition: bool) -> str | None:
        """Takes a message (``at`` in seconds) and gives the level of what it shows."""
        if transition:
            self.transitions += 1
            score *= 1.5
        if self.seen is not None:
            self.cumulative *= max(0.5, 1.0 - (at - self.seen) / 60.0 * 0.05)
        self.cumulative += score
        self.scores.append(score)
        self.seen = at
        if len(self.scores) >= 3 and self.cumulative >= 12.0:
            a, b, c = list(self.scores)[-3:]
            if c >= b >= a and self.transitions >= 2:
                return "high" if self.cumulative >= 20.0 else "medium"
        return None


@dataclass
class Risk:
    """State of a session's anomaly score."""

    score: float = 0.0
    floor: float = 0.0
    events: deque = field(default_factory=lambda: deque(maxlen=500))

    def record(self, at: float, category: str, level: str, confidence: float) -> None:
        self.score = min(100.0, self.score + POINTS.get(level, 0) * confidence)
        self.floor = max(self.floor, self.score * 0.2)
        self.events.append((at, category, level))

    def check(self, at: float, decay: float, threshold: float) -> list[str]:
        """Decays the score and gives what is seen: ``AD-CHAIN:<name>``, ``AD-ALT``, ``AD-SCORE``."""
        self.score = max(self.score * decay, self.floor)
        out = []
        if len(self.events) >= 2:
            recent = {c for t, c, _ in self.events if at - t < CHAIN_SECONDS}
            out += [f"AD-CHAIN:{name}" for pair, name, _ in CHAINS if set(pair) <= recent]
        if len(self.events) >= 6:
            sides = [{"high": 1, "critical": 1, "none": -1, "low": -1}.get(x, 0) for _, _, x in list(self.events)[-10:]]
            if sum(a * b == -1 for a, b in zip(sides, sides[1:], strict=False)) >= 3:
                out.append("AD-ALT")
        if self.score > threshold:
            out.append("AD-SCORE")
        return out


def risk_level(score: float) -> str:
    return "critical" if score > 80 else "high" if score > 60 else "medium" if score > 40 else "low" if score > 20 else "none"


def folded(rows: DataFrame, session_col: str, order: list[str], new_state: Callable, step: Callable, out: T.StructType) -> DataFrame:
    """``rows`` with the columns ``out`` that ``step(state, row)`` gives, in each
    session's order.  One pass over sorted partitions; at the end of a session its
    state is let go."""
    sorted_rows = rows.repartition(session_col).sortWithinPartitions(session_col, *order)
    schema = T.StructType([*sorted_rows.schema.fields, *out.fields])
    names = [f.name for f in out.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, state = object(), None
        for batch in batches:
            found = []
            for row in batch.itertuples(index=False):
                key = getattr(row, session_col)
                key = None if pd.isna(key) else key
                if state is None or key != session:
                    session, state = key, new_state()
                found.append(step(state, row))
            yield batch.assign(**{n: [f[k] for f in found] for k, n in enumerate(names)})

    return sorted_rows.mapInPandas(run, schema)


def escalation(messages: DataFrame, session_col: str = "session_id", ts_col: str = "ts", text_col: str = "text", id_col: str = "prompt_id") -> DataFrame:
    """``session_col, id_col, message_score, cumulative, transitions, level`` for
    each message; a level is null where nothing is seen."""
    scored = messages.select(F.col(session_col), F.col(id_col), (F.unix_micros(F.col(ts_col).cast("timestamp")) / 1e6).alias("at"), topic_score(F.col(text_col)).alias("message_score"), is_transition(F.col(text_col)).alias("moves"))
    out = T.StructType([T.StructField("cumulative", T.DoubleType()), T.StructField("transitions", T.IntegerType()), T.StructField("level", T.StringType())])

    def step(state: Escalation, row) -> tuple:
        level = state.step(row.at, row.message_score, row.moves)
        return state.cumulative, state.transitions, level

    return folded(scored, session_col, ["at", id_col], Escalation, step, out).drop("at", "moves")


def anomaly(events: DataFrame, session_col: str = "session_id", ts_col: str = "ts", id_col: str = "event_id", settings: Settings = DEFAULT) -> DataFrame:
    """``events`` have ``kind`` (``record`` or ``check``), and records ``category,
    level, confidence``.  Gives ``session_col, id_col, kind, score, risk, found``."""
    rows = events.select(F.col(session_col), F.col(id_col), (F.unix_micros(F.col(ts_col).cast("timestamp")) / 1e6).alias("at"), "kind", F.coalesce("category", F.lit("")).alias("category"), F.coalesce("level", F.lit("none")).alias("level"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    out = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("risk", T.StringType()), T.StructField("found", T.StringType())])
    decay, threshold = settings.anomaly_decay, settings.anomaly_threshold

    def step(state: Risk, row) -> tuple:
        found: list[str] = []
        if row.kind == "check":
            found = state.check(row.at, decay, threshold)
        else:
            state.record(row.at, row.category, row.level, row.confidence)
        return state.score, risk_level(state.score), ",".join(found)

    return folded(rows, session_col, ["at", id_col], Risk, step, out).drop("category", "level", "confidence")


def latest_risk(folded_events: DataFrame, session_col: str = "session_id", id_col: str = "event_id") -> DataFrame:
    """The last state of each session."""
    last = F.struct("at", id_col)
    return folded_events.groupBy(session_col).agg(F.max_by("score", last).alias("score"), F.max_by("risk", last).alias("risk"), F.count(F.lit(1)).alias("n_events"))


LAYER = "anomaly_detector"


def anomaly_detections(score: Column, risk: Column, found: Column, settings: Settings = DEFAULT) -> Column:
    """What a check of :func:`anomaly` saw, as detections."""
    seen = F.split(F.coalesce(found, F.lit("")), ",")

    def chain(name: str, level: str) -> Column:
        call = BLOCK if not settings.ordinal or level == "critical" else QUARANTINE
        return F.when(F.array_contains(seen, f"AD-CHAIN:{name}"), detection("AD-CHAIN", "chain_attack", level, call, f"events make a chain: {name}", found, LAYER, 0.80))

    mild = risk != "critical" if settings.ordinal else risk <= "high"
    return present([
        *[chain(name, level) for _, name, level in CHAINS],
        F.when(F.array_contains(seen, "AD-ALT"), detection("AD-ALT", "behavioral_anomaly", "high", QUARANTINE, "mild and grave events in turns", found, LAYER, 0.70)),
        F.when(F.array_contains(seen, "AD-SCORE"), detection("AD-SCORE", "behavioral_anomaly", risk, F.when(mild, CHALLENGE).otherwise(BLOCK), "score of the session above the threshold", F.format_string("%.1f", score), LAYER, 0.75)),
    ])


def check_anomaly(events: DataFrame, session_col: str = "session_id", ts_col: str = "ts", id_col: str = "event_id", settings: Settings = DEFAULT) -> DataFrame:
    """The rows of :func:`anomaly` (or of its streaming form) with the columns of a
    decision; records, and checks that see nothing, are allowed."""
    return decided_anomaly(anomaly(events, session_col, ts_col, id_col, settings), settings)


def decided_anomaly(folded_events: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    rows = folded_events.withColumn("detections", anomaly_detections(F.col("score"), F.col("risk"), F.col("found"), settings))
    level = worst_level(F.col("detections"))
    grave = level == "critical" if settings.ordinal else level >= "critical"
    call = F.when(F.size("detections") == 0, "allow").when(grave, BLOCK).otherwise(CHALLENGE)
    return rows.select(*folded_events.columns, *decided(F.col("detections"), call))


def crescendo_detections(level: Column, cumulative: Column) -> Column:
    """The escalation fold's level as a detection of its message."""
    call = F.when(level == "high", QUARANTINE).otherwise(CHALLENGE)
    return present([F.when(level.isNotNull(), detection("PA-CRESCENDO", "prompt_injection", level, call, "conversation works its way up to a topic", F.format_string("%.1f", cumulative), "prompt_armor", F.when(level == "high", 0.82).otherwise(0.70)))])
