"""Labelled texts for the trained tier: sources, pseudo-labels, and stored models
with the sums that their files must have.

Texts that are null or not longer than a source's ``longer_than`` are left out,
and so are rows whose level can't be read where a least level is asked for.
Repeated rows stay.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INTEGRITY = "integrity.json"


@dataclass(frozen=True)
class Source:
    """A table of texts.  ``label`` is a number, or an SQL expression over the
    table; ``most`` a bound on its rows (None for none), a feature of the mixture;
    ``least_level`` keeps rows whose ``level_col`` ends in such a number or more."""

    path: str
    text_col: str = "text"
    label: int | str = "label"
    format: str = "parquet"
    longer_than: int = 0
    most: int | None = None
    level_col: str | None = None
    least_level: int = 4


def level_number(level: Column) -> Column:
    """The number that a level such as ``Severity level: 4`` ends in, or null."""
    return F.regexp_extract(level, r"(\d+)$", 1).try_cast("int")


def rows_of(spark: SparkSession, source: Source) -> DataFrame:
    df = spark.read.format(source.format).load(source.path)
    label = F.lit(source.label) if isinstance(source.label, int) else F.expr(source.label)
    if source.level_col:
        df = df.where(level_number(F.col(source.level_col)) >= source.least_level)
    df = df.where(F.length(source.text_col) > source.longer_than)
    df = df.select(F.col(source.text_col).alias("text"), label.cast("int").alias("label"))
    return df if source.most is None else df.limit(source.most)


def labelled(spark: SparkSession, sources: list[Source]) -> DataFrame:
    """``text, label, source`` of all sources; ``source`` is the number in the list."""
    out = spark.createDataFrame([], "text string, label int, source int")
    for k, s in enumerate(sources):
        out = out.unionByName(rows_of(spark, s).withColumn("source", F.lit(k)))
    return out


def write_pseudo_labels(distilled: DataFrame, path: str) -> None:
    """Rows of ``models.distilled`` as JSON lines: ``text, label, confidence, source``."""
    sure = F.when(F.col("label") == 1, F.col("confidence")).otherwise(1 - F.col("confidence"))
    distilled.select("text", "label", F.round(sure, 4).alias("confidence"), F.lit("distillation").alias("source")).write.json(path)


class Refused(ValueError):
    """A stored model that must not be used."""


def _sums(folder: Path) -> dict[str, str]:
    """Sums of a model's files, without checksum files beside them."""
    files = sorted(f for f in folder.rglob("*") if f.is_file() and f.name != INTEGRITY and not f.name.endswith(".crc"))
    return {str(f.relative_to(folder)): hashlib.sha256(f.read_bytes()).hexdigest() for f in files}


def save_model(model: PipelineModel, folder: str, version: str) -> None:
    """Stores the model with its version and the sums of its files beside them.
    The folder is one that the driver sees as a path."""
    model.save(folder)
    top = Path(folder)
    (top / INTEGRITY).write_text(json.dumps({"version": version, "files": _sums(top)}, sort_keys=True))


def load_model(folder: str, version: str | None = None, canaries_hold: Callable[[PipelineModel], bool] | None = None) -> PipelineModel:
    """A stored model whose files have their sums, of the asked version (None for
    any), and that judges its canaries as it should; refused otherwise.  Without a
    file of sums the files are taken as they are, but then no version can be asked."""
    top = Path(folder)
    known = json.loads((top / INTEGRITY).read_text()) if (top / INTEGRITY).exists() else {}
    if version is not None and known.get("version") != version:
        raise Refused(f"version {known.get('version')} instead of {version}")
    if known and _sums(top) != known["files"]:
        raise Refused("the files of the model differ")
    model = PipelineModel.load(folder)
    if canaries_hold is not None and not canaries_hold(model):
        raise Refused("the model misjudges its canaries")
    return model
