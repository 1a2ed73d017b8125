"""What callers can add: detectors of their own, and approvals."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom.operators.detection import ALLOW, CHALLENGE, DETECTIONS, LEVELS, decided, is_blocked, rank, verdict_by_level


class Detector(Protocol):
    """A check of a text: a name, and a column of detections (``array<struct>``)
    of the text's column.  A pandas UDF of that type is one, too."""

    name: str

    def __call__(self, text: Column) -> Column: ...


def with_detectors(decisions: DataFrame, text_col: str, detectors: Iterable[Detector], usual: dict[str, str], default: str) -> DataFrame:
    """Decisions with the detections of further detectors; the verdict is the stricter one
    of the given verdict and that of the added detections (by ``usual``)."""
    added = F.concat(F.array().cast(DETECTIONS), *[F.coalesce(d(F.col(text_col)).cast(DETECTIONS), F.array().cast(DETECTIONS)) for d in detectors])
    strict = F.array(*map(F.lit, ("allow", "sanitize", "challenge", "quarantine", "block")))
    rows = decisions.withColumn("_added", added)
    call = verdict_by_level(F.col("_added"), usual, default)
    worse = F.array_position(strict, call) > F.array_position(strict, F.col("verdict"))
    rows = rows.withColumn("_all", F.concat("detections", "_added")).withColumn("_call", F.when(worse, call).otherwise(F.col("verdict")))
    own = {"detections", "verdict", "threat_count", "max_threat_level", "is_blocked", "sanitized"}
    kept = [c for c in decisions.columns if c not in own]
    return rows.select(*kept, *decided(F.col("_all"), F.col("_call"), F.col("sanitized") if "sanitized" in decisions.columns else None))


def approved(decisions: DataFrame, approvals: DataFrame, id_col: str) -> DataFrame:
    """Decisions that ask (``challenge``) after the answers in ``approvals``
    (``<id_col>, approved``): allowed if approved, else as they are; what is blocked
    stays blocked.  Of several answers a refusal counts."""
    answers = approvals.groupBy(F.col(id_col).alias("_answer_id")).agg(F.min("approved").alias("_approved"))
    both = decisions.join(answers, F.col(id_col) == F.col("_answer_id"), "left")
    yes = (F.col("verdict") == CHALLENGE) & F.coalesce("_approved", F.lit(False))
    out = both.withColumn("verdict", F.when(yes, F.lit(ALLOW)).otherwise(F.col("verdict"))).drop("_answer_id", "_approved")
    return out.withColumn("is_blocked", is_blocked(F.col("verdict"))) if "is_blocked" in decisions.columns else out


def reported(decisions: DataFrame, least: str = "low") -> DataFrame:
    """The decisions that threat hooks get: from level ``least`` up, by rank."""
    return decisions.where(rank(F.col("max_threat_level")) >= LEVELS.index(least))
