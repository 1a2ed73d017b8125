"""The same checks over streams.

Row-wise checks need no state, so batch functions apply to streaming frames as
they are.  Here are what does need state: escalation of conversations and risk of
sessions, whose state (bounded for each session) is kept for ever, rates, windowed counts with a watermark, and callbacks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from threatloom.operators.detection import LEVELS, is_blocked, rank
from threatloom.operators.sessions import Escalation, Risk, is_transition, risk_level, topic_score
from threatloom.operators.settings import DEFAULT, Settings

#: Late rows beyond this are dropped.
LATENESS = "10 minutes"

ESCALATION = T.StructType([
    T.StructField("session_id", T.StringType()), T.StructField("prompt_id", T.LongType()), T.StructField("cumulative", T.DoubleType()),
    T.StructField("transitions", T.IntegerType()), T.StructField("level", T.StringType()),
])


class EscalationProcessor(StatefulProcessor):
    """The escalation fold with its state in the state store."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = T.StructType([T.StructField("scores", T.ArrayType(T.DoubleType())), T.StructField("cumulative", T.DoubleType()), T.StructField("seen", T.DoubleType()), T.StructField("transitions", T.IntegerType())])
        self.kept = handle.getValueState("escalation", schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = Escalation()
        if self.kept.exists():
            scores, state.cumulative, state.seen, state.transitions = self.kept.get()
            state.scores.extend(scores)
        found = []
        batch = pd.concat(list(rows)).sort_values(["at", "prompt_id"])  # one session's rows of one micro-batch
        for row in batch.itertuples(index=False):
            level = state.step(row.at, row.message_score, row.moves)
            found.append((key[0], row.prompt_id, state.cumulative, state.transitions, level))
        self.kept.update((list(state.scores), state.cumulative, state.seen, state.transitions))
        yield pd.DataFrame(found, columns=ESCALATION.names)

    def close(self) -> None:
        pass


RISK = T.StructType([
    T.StructField("session_id", T.StringType()), T.StructField("event_id", T.LongType()), T.StructField("at", T.DoubleType()), T.StructField("kind", T.StringType()),
    T.StructField("score", T.DoubleType()), T.StructField("risk", T.StringType()), T.StructField("found", T.StringType()),
])


class RiskProcessor(StatefulProcessor):
    """The anomaly fold with its state in the state store."""

    def __init__(self, decay: float, threshold: float):
        self.decay, self.threshold = decay, threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        event = T.StructType([T.StructField("at", T.DoubleType()), T.StructField("category", T.StringType()), T.StructField("level", T.StringType())])
        self.kept = handle.getValueState("risk", T.StructType([T.StructField("score", T.DoubleType()), T.StructField("floor", T.DoubleType()), T.StructField("events", T.ArrayType(event))]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = Risk()
        if self.kept.exists():
            state.score, state.floor, events = self.kept.get()
            state.events.extend(tuple(e) for e in events)
        found = []
        batch = pd.concat(list(rows)).sort_values(["at", "event_id"])  # one session's rows of one micro-batch
        for row in batch.itertuples(index=False):
            seen: list[str] = []
            if row.kind == "check":
                seen = state.check(row.at, self.decay, self.threshold)
            else:
                state.record(row.at, row.category, row.level, row.confidence)
            found.append((key[0], row.event_id, row.at, row.kind, state.score, risk_level(state.score), ",".join(seen)))
        self.kept.update((state.score, state.floor, list(state.events)))
        yield pd.DataFrame(found, columns=RISK.names)

    def close(self) -> None:
        pass


def anomaly(events: DataFrame, session_col: str = "session_id", ts_col: str = "ts", id_col: str = "event_id", settings: Settings = DEFAULT) -> DataFrame:
    """Streaming form of :func:`threatloom.operators.sessions.anomaly`;
    ``sessions.decided_anomaly`` makes decisions of its rows.  Needs the RocksDB
    state store."""
    rows = events.select(F.col(session_col).cast("string").alias("session_id"), F.col(id_col).alias("event_id"), (F.unix_micros(F.col(ts_col).cast("timestamp")) / 1e6).alias("at"), "kind", F.coalesce("category", F.lit("")).alias("category"), F.coalesce("level", F.lit("none")).alias("level"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    return rows.groupBy("session_id").transformWithStateInPandas(RiskProcessor(settings.anomaly_decay, settings.anomaly_threshold), RISK, "append", "None")


def rates(rows: DataFrame, ts_col: str, keys: list[str], length: str = "60 seconds", slide: str = "10 seconds") -> DataFrame:
    """Rows of each key in sliding windows: the streaming form of the rate rules,
    to the precision of ``slide``."""
    seen = rows.withWatermark(ts_col, LATENESS) if rows.isStreaming else rows
    return seen.groupBy(F.window(ts_col, length, slide).alias("w"), *keys).agg(F.count(F.lit(1)).alias("recent")).select(F.col("w.end").alias("end"), *keys, "recent")


def escalation(messages: DataFrame, session_col: str = "session_id", ts_col: str = "ts", text_col: str = "text", id_col: str = "prompt_id") -> DataFrame:
    """Streaming form of :func:`threatloom.operators.sessions.escalation`.  Needs
    the RocksDB state store."""
    scored = messages.select(F.col(session_col).cast("string").alias("session_id"), F.col(id_col).alias("prompt_id"), (F.unix_micros(F.col(ts_col).cast("timestamp")) / 1e6).alias("at"), topic_score(F.col(text_col)).alias("message_score"), is_transition(F.col(text_col)).alias("moves"))
    return scored.groupBy("session_id").transformWithStateInPandas(EscalationProcessor(), ESCALATION, "append", "None")


def windowed(decisions: DataFrame, ts_col: str, by: str = "verdict", length: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Counts of decisions in time windows, closed by the watermark."""
    frame = F.window(ts_col, length, slide) if slide else F.window(ts_col, length)
    seen = decisions.withWatermark(ts_col, LATENESS) if decisions.isStreaming else decisions
    return seen.groupBy(frame.alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def sessions(events: DataFrame, ts_col: str, key: str, gap: str = "10 minutes") -> DataFrame:
    """Events grouped into sessions that a gap ends."""
    seen = events.withWatermark(ts_col, LATENESS) if events.isStreaming else events
    return seen.groupBy(key, F.session_window(ts_col, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once_each(detections: DataFrame, ts_col: str, keys: list[str]) -> DataFrame:
    """The first of equal detections within the watermark."""
    return detections.withWatermark(ts_col, LATENESS).dropDuplicatesWithinWatermark(keys) if detections.isStreaming else detections.dropDuplicates(keys)


def on_block(decisions: DataFrame, call: Callable[[DataFrame, int], None], checkpoint: str):
    """As :func:`on_threat`, for decisions that block or quarantine."""
    return on_threat(decisions.where(is_blocked(F.col("verdict"))), "none", call, checkpoint)


def on_threat(decisions: DataFrame, least: str, call: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a query that hands the decisions from level ``least`` up to ``call``,
    one frame for each micro-batch; a failing call doesn't stop the stream."""
    seen = decisions.where(rank(F.col("max_threat_level")) >= LEVELS.index(least))

    def guarded(batch: DataFrame, number: int) -> None:
        try:
            call(batch, number)
        except Exception as e:  # noqa: BLE001  a hook's failure must not stop checks
            print(f"hook failed on batch {number}: {e}")

    return seen.writeStream.foreachBatch(guarded).option("checkpointLocation", checkpoint).start()
