"""Exact deduplication with a heavy-hitter split, in DataFrame functions only.

1. Every text becomes a SHA-256 digest of its normalised form.
2. A Misra-Gries summary (Spark's ``approx_top_k``: bounded counters per task,
   merged at the end) names the frequent digests.  With ``CAPACITY`` counters
   every digest with more than ``3.5 / CAPACITY`` of the rows is among them.
3. The candidates are verified by an exact count; the winners, at most ``TOP``
   rows, are broadcast and their copies are resolved map-side.
4. The remaining digests, of which none is frequent, use an ordinary shuffle.

Defined cases: null text counts as empty; a null ``doc_id`` sorts below all
others, so its row stays only if no copy has an id; of rows that repeat both
``doc_id`` and text just one stays; an empty table gives an empty result;
other columns, whatever their names, are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatloom.llm.common import ascii_lower, cut, fresh

#: Counters of the Misra-Gries summary.
CAPACITY = 8192
#: Bound of the broadcast: more digests than can pass 3.5 / CAPACITY (2341).
TOP = 4096


def text_digest(text: Column) -> Column:
    """Lower-case hex SHA-256 of the text with A-Z lower-cased, in UTF-8."""
    return F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256)


def frequent(digests: DataFrame, digest: str, capacity: int = CAPACITY, top: int = TOP) -> DataFrame:
    """Candidates for frequent digests: at most ``top`` 64-bit fingerprints ``_h``."""
    found = digests.agg(F.expr(f"approx_top_k(xxhash64(`{digest}`), {top}, {capacity})").alias("_t"))
    return found.select(F.explode("_t").alias("_e")).select(F.col("_e.item").alias("_h")).limit(top)


def winners(digests: DataFrame, digest: str, order: Column) -> DataFrame:
    """Exact count and greatest ``order`` of each candidate digest that has copies."""
    return (
        digests.withColumn("_h", F.xxhash64(digest))
        .join(F.broadcast(frequent(digests, digest)), "_h")
        .groupBy(digest)
        .agg(F.count(F.lit(1)).alias("_n"), F.max(order).alias("_best"))
        .where("_n > 1")
    )


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: ``<id_col>, keep_id, group_size, kept, text_sha256``."""
    rows = cut(
        df.select(F.col(id_col).alias("_id"), F.unhex(text_digest(F.col(text_col))).alias("_d")).withColumn(
            "_row", F.monotonically_increasing_id()
        )
    )
    order = F.struct(F.col("_id"), F.col("_row"))
    hot = cut(winners(rows, "_d", order))
    joined = rows.join(F.broadcast(hot), "_d", "left")
    heavy = joined.where(F.col("_n").isNotNull())
    light = joined.where(F.col("_n").isNull()).drop("_n", "_best")
    group = Window.partitionBy("_d")
    light = light.withColumn("_n", F.count(F.lit(1)).over(group)).withColumn("_best", F.max(order).over(group))
    return heavy.unionByName(light).select(
        F.col("_id").alias(id_col),
        F.col("_best._id").alias("keep_id"),
        F.col("_n").alias("group_size"),
        (F.col("_row") == F.col("_best._row")).alias("kept"),
        F.lower(F.hex("_d")).alias("text_sha256"),
    )


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns."""
    digest, rank, best = fresh(df.columns, "_d", "_rank", "_keep")
    keyed = df.withColumn(digest, F.unhex(text_digest(F.col(text_col))))
    hot = cut(winners(keyed.select(F.col(id_col).alias("_id"), F.col(digest).alias("_d")), "_d", F.col("_id")))
    hot = hot.select(F.col("_d").alias(digest), F.struct(F.col("_best").alias("id")).alias(best))
    joined = keyed.join(F.broadcast(hot), digest, "left")
    # A winner's rows are few once all others are gone map-side; one of them stays.
    heavy = joined.where(F.col(best).isNotNull() & F.col(id_col).eqNullSafe(F.col(f"{best}.id")))
    heavy = heavy.dropDuplicates([digest])
    light = joined.where(F.col(best).isNull())
    ordered = Window.partitionBy(digest).orderBy(F.col(id_col).desc_nulls_last())
    light = light.withColumn(rank, F.row_number().over(ordered)).where(F.col(rank) == 1).drop(rank)
    return heavy.unionByName(light).select(*[F.col(f"`{c}`") for c in df.columns])


ORACLE_SQL = """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.text_sha256 FROM t JOIN g USING (text_sha256)
"""
