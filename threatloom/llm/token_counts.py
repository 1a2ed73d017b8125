"""Token counts of documents in flat token files, by a separator scan.

A token file is nothing but 16-bit token ids, documents ended by one reserved
id; there is no index.  The files are cut into blocks of fixed size; each task
reads its blocks, views them as numbers and finds all separators in one
vectorised comparison.  Documents run across blocks, so a summary of each block
(how many separators, the last one's position) goes through a prefix scan over the
blocks of a file: a running count numbers the documents, and a running maximum tells
where the one that a block begins within has started.  The separators themselves
stay where they are and get their block's numbers by a join.

:func:`write_token_files` writes such files from texts in one pass, and beside each
a table of its documents' ids.  Both names hold a number drawn by the attempt that
wrote them, and the list of files is written by Spark when a task has succeeded, so
files of lost executors are never read.

Defined cases: null and empty texts are documents of no tokens; null ids are kept;
repeated rows are documents of their own; ties do not arise, as each document has its
place; a long text may fill many blocks; empty files have no documents; tokens after
the last separator are a document that is not closed; a separator's string inside a
text is ordinary text, so texts can't break the format; an empty table gives no files
and no rows; other columns are not read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threatloom.llm.bpe import read_file, tokenizer
from threatloom.llm.common import slices, small_batches, strings, written

#: Tokens in a block.
BLOCK = 1 << 20


def opened(name: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path in it of a name as Spark gives it."""
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", name))


def write_token_files(df: DataFrame, tokenizer_path: str, separator: int, path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Writes the texts of ``df`` as token files under ``path/tokens``, one for each
    of its partitions, and the ids of their documents under ``path/ids`` (``file,
    doc_index, <id_col>``).  Gives the files: ``path, length``."""
    file = df.sparkSession.sparkContext.broadcast(read_file(tokenizer_path))
    ends = separator.to_bytes(2, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(file.value)
        if max(len(t.offsets) - 2, separator) > 0xFFFF:
            raise ValueError("ids must fit 16 bits")
        fs, where = opened(path)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
        tokens = table = None
        index = size = 0
        for batch in slices(batches):
            if tokens is None:
                fs.create_dir(f"{where}/tokens")
                fs.create_dir(f"{where}/ids")
                tokens = fs.open_output_stream(f"{where}/tokens/{name}.bin")
                table = pa.parquet.ParquetWriter(f"{where}/ids/{name}.parquet", pa.schema([("file", pa.string()), ("doc_index", pa.int64()), (id_col, batch.schema.field(1).type)]), filesystem=fs)
            for text in strings(batch.column(0)):
                row = np.array(t.encode(text, special=False), "<u2").tobytes()
                tokens.write(row + ends)
                size += len(row) + 2
            count = batch.num_rows
            table.write_table(pa.table([pa.array([f"{name}.bin"] * count), pa.array(range(index, index + count), pa.int64()), batch.column(1)], names=["file", "doc_index", id_col]))
            index += count
        if tokens is not None:
            tokens.close()
            table.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{path}/tokens/{name}.bin"]), pa.array([size], pa.int64())], names=["path", "length"])

    small_batches(df.sparkSession)
    return written(df.select(text_col, id_col).mapInArrow(run, "path string, length long"), "token-files")


def scan_token_files(spark: SparkSession, path: str, separator: int, block: int = BLOCK, files: DataFrame | None = None) -> DataFrame:
    """``file, doc_index, start, n_tokens, closed``: one row for each document of the
    ``files`` (``path, length``), or of all in the folder ``path``."""
    if files is None:  # without `content` only names and lengths are read
        files = spark.read.format("binaryFile").load(path).select("path", "length")
    size = 2 * block
    blocks = files.where("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(length - 1) div {size}"))).alias("block"))
    blocks = blocks.select("path", F.col("block"), F.least(F.lit(size), F.col("length") - F.col("block") * size).alias("bytes")).repartition("path", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, k, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, where = opened(name)
                with fs.open_input_file(where) as f:
                    ids = np.frombuffer(f.read_at(n, k * size), "<u2", count=n // 2)
                ends = np.flatnonzero(ids == separator)
                ends = pa.ListArray.from_arrays(pa.array([0, len(ends)], pa.int32()), pa.array(ends + k * block, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([k], pa.int64()), pa.array([k * block + n // 2], pa.int64()), ends], names=["path", "block", "upto", "ends"])

    seen = written(blocks.mapInArrow(run, "path string, block long, upto long, ends array<long>"), "token-ends")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    summary = seen.select("path", "block", F.size("ends").alias("n"), F.when(F.size("ends") > 0, F.element_at("ends", -1)).alias("last"))
    scanned = summary.select(
        "path",
        "block",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"),
        F.coalesce(F.max("last").over(before) + 1, F.lit(0).cast("long")).alias("begun"),
        (F.col("block") == F.max("block").over(Window.partitionBy("path"))).alias("final"),
    )
    placed = seen.hint("merge").join(scanned, ["path", "block"])
    # tokens after the last separator of a file
    open_from = F.coalesce(F.when(F.size("ends") > 0, F.element_at("ends", -1) + 1), F.col("begun"))
    stops = F.when(F.col("final") & (open_from < F.col("upto")), F.concat("ends", F.array("upto"))).otherwise(F.col("ends"))
    each = placed.withColumn("stops", stops).select("path", "first", "begun", F.size("ends").alias("whole"), "stops", F.posexplode("stops").alias("k", "stop"))
    start = F.when(F.col("k") == 0, F.col("begun")).otherwise(F.get("stops", F.col("k") - 1) + 1)
    return each.select(F.element_at(F.split("path", "/"), -1).alias("file"), (F.col("first") + F.col("k")).alias("doc_index"), start.alias("start"), (F.col("stop") - start).alias("n_tokens"), (F.col("k") < F.col("whole")).alias("closed"))


def document_counts(df: DataFrame, tokenizer_path: str, separator: int, path: str, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Writes ``df`` as token files under ``path``, scans them, and names each
    document: ``<id_col>, part, doc_index, start, n_tokens``, by the ids beside the files."""
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    files = write_token_files(df, tokenizer_path, separator, path, text_col, id_col)
    if files.isEmpty():
        return spark.createDataFrame([], f"`{id_col}` {kind}, part int, doc_index long, start long, n_tokens long")
    counts = scan_token_files(spark, path, separator, block, files)
    ids = spark.read.schema(f"file string, doc_index long, `{id_col}` {kind}").parquet(f"{path}/ids")
    named = counts.hint("merge").join(ids, ["file", "doc_index"])
    return named.select(id_col, F.regexp_extract("file", r"^part-(\d+)", 1).cast("int").alias("part"), "doc_index", "start", "n_tokens")
