"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom.sources.tables import table

#: ASCII white space that separates words: space and \t \n \v \f \r.
WORD_RX = "[^\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of
    the session.  Only where that is unset (as in tests) a folder under the
    warehouse is chosen."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if named and not current:
        context.setCheckpointDir(named)
    elif not named and not current:
        context.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-scratch")
    return (named or context.getCheckpointDir()).rstrip("/")


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries run inside drop their shuffle files when they end.  Used where
    the result is written to the shared folder, so nobody reads them again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back: later
    steps neither recompute it nor depend on one executor."""
    shared_dir(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """As :func:`cut`, but as a Parquet table, for wide rows of which later
    steps read some columns."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def removed(df: DataFrame) -> None:
    """Deletes the tables that :func:`written` made and ``df`` reads; only for
    those from which all that is needed has been derived and written."""
    spark, top = df.sparkSession, shared_dir(df.sparkSession)
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.split(":", 1)[-1].lstrip("/").startswith(top.split(":", 1)[-1].lstrip("/")):
            deleted(spark, folder)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only.  ``lower`` does just that on pure ASCII, and fast."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_count(text: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RX)), F.lit(0)).cast("long")


def fresh(taken: list[str], *names: str) -> list[str]:
    """Column names like ``names`` that clash with none of ``taken``."""
    seen, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in seen:
            name = f"_{name}"
        seen.add(name.lower())
        out.append(name)
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


#: Rows of a batch that goes to a Python worker.  Texts can be long, and both
#: sides hold a few batches.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's batch size to ``BATCH_ROWS``; a lower one stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def slices(batches, rows: int = 512):
    """The batches in parts of few rows, so a worker holds few texts at once."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def strings(column) -> list[str | None]:
    """A batch's strings (an Arrow array); bytes that are not UTF-8 are replaced."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        raw = column.view("binary").to_pylist() if hasattr(column, "view") else [x.as_buffer().to_pybytes() for x in column]
        return [None if x is None else x.decode("utf-8", "replace") for x in raw]
