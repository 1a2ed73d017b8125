"""Mixing sources to target weights, in DataFrame functions only.

The tokens of each source are summed (pre-aggregated in every task, so a hot
source costs nothing extra), targets follow from the weights, each source gets
a repetition rate ``target / size``, and every document is emitted
``floor(rate)`` times plus one hash-seeded Bernoulli copy with the fraction as
probability.  All arithmetic up to the rate is on whole numbers, so reruns and
other engines agree.

Defined cases: null text has no words; null sources form one source of their
own, last in order; a source without words gets target 0; a null ``doc_id``
draws by its text; repeated rows draw alike; an empty table gives an empty
result; further columns are kept by :func:`mix` under any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatloom.llm.common import cut, fresh, word_count

#: Up to so many sources the plan is broadcast (about 100 bytes each).
BROADCAST_SOURCES = 50_000
SEED = "mix-1"


def ranked(sources: DataFrame, key: str) -> DataFrame:
    """``sources`` with ``_rank`` from 0 by ``key`` in code-point order, nulls
    last.  Range partitions are ranked side by side and shifted by the sizes of
    those before them, so no task sees all sources."""
    by = [F.col(key).isNull(), F.col(key)]
    spread = cut(sources.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    sizes = spread.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    shift = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*by))
    return spread.withColumn("_own", own).join(F.broadcast(shift), "_part").withColumn("_rank", F.col("_own") - 1 + F.col("_shift")).drop("_part", "_own", "_shift")


def plan(sized: DataFrame, weights: list[int], share: tuple[int, int], cap: int) -> DataFrame:
    """``_source, source_size, _num, _den``: the target of a source is
    ``_num / _den``.  ``sized`` has ``_source`` and ``_size``.  The targets share
    ``share[0] / share[1]`` of all sizes by weight and stop at ``cap`` times the
    source's size; what is over goes to the others until none is above."""
    big = "decimal(38,0)"
    sources = ranked(sized.groupBy("_source").agg(F.sum("_size").alias("source_size")), "_source")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    sources = cut(sources.withColumn("_w", weight.cast(big)))
    total, num, den = int(sources.agg(F.sum("source_size")).first()[0] or 0), 0, 1
    full, before = F.lit(False), None
    limit = (F.col("source_size") * cap).cast(big)
    while True:  # each pass reads one row per source and brings two sums to the driver
        row = sources.agg(F.sum(F.when(full, limit)).alias("c"), F.sum(F.when(~full, F.col("_w"))).alias("w"), F.count(F.when(full, 1)).alias("n")).first()
        if row["n"] == before or not row["w"]:
            break
        before = row["n"]
        # the level is num / den words for each unit of weight
        num, den = share[0] * total - share[1] * int(row["c"] or 0), share[1] * int(row["w"])
        full = F.col("_w") * F.lit(num).cast(big) >= limit * F.lit(den).cast(big)
    return sources.select(
        "_source",
        "source_size",
        F.when(full, limit).otherwise(F.col("_w") * F.lit(num).cast(big)).cast("long").alias("_num"),
        F.when(full, F.lit(1)).otherwise(F.lit(den)).cast("long").alias("_den"),
    )


def with_plan(df: DataFrame, sources: DataFrame) -> DataFrame:
    """``df`` (with ``_source``) joined to its source's row; null joins null.
    Broadcast only where the number of sources was found to be small; else the
    join is left to Spark, which splits a hot source's partition."""
    if sources.count() <= BROADCAST_SOURCES:
        sources = F.broadcast(sources)
    named = sources.withColumnRenamed("_source", "_named")
    return df.join(named, F.col("_source").eqNullSafe(F.col("_named")), "left").drop("_named")


def target() -> Column:
    return F.col("_num").cast("double") / F.col("_den").cast("double")


def copies(key: Column, seed: str) -> Column:
    """How often a document is taken: ``floor(rate)`` plus a Bernoulli copy."""
    rate = F.when(F.col("source_size") > 0, target() / F.col("source_size")).otherwise(F.lit(0.0))
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))
    return F.floor(rate) + F.when(drawn < rate - F.floor(rate), 1).otherwise(0)


def draw_key(id_col: str, text_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("t"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))


def mix_report(df: DataFrame, weights: list[int], share: tuple[int, int] = (3, 2), cap: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """One row per row of ``df``: ``<id_col>, size, source_size, target, taken, copies``."""
    sized = cut(df.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), word_count(F.col(text_col)).alias("_size"), draw_key(id_col, text_col).alias("_key")))
    out = with_plan(sized, plan(sized, weights, share, cap)).withColumn("_copies", copies(F.col("_key"), seed))
    return out.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), "source_size", target().alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"), F.col("_copies").alias("copies"))


def mix(df: DataFrame, weights: list[int], share: tuple[int, int] = (3, 2), cap: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """The mixture: each row of ``df``, with its columns, as often as it is taken."""
    names = fresh(["_source", "_size", "_num", "_den", "source_size", "_copies", "_key"], *df.columns)
    # the columns step aside under new names, so none can clash
    inner = df.select(*[F.col(f"`{a}`").alias(b) for a, b in zip(df.columns, names, strict=True)])
    at = dict(zip(df.columns, names, strict=True))
    inner = inner.withColumn("_source", F.col(at[source_col])).withColumn("_key", draw_key(at[id_col], at[text_col]))
    sized = inner.select("_source", word_count(F.col(at[text_col])).alias("_size"))
    out = with_plan(inner, plan(sized, weights, share, cap)).withColumn("_copies", copies(F.col("_key"), seed).cast("int"))
    out = out.where("_copies > 0").withColumn("_copies", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return out.select(*[F.col(b).alias(a) for a, b in at.items()])


#: The weights of the query and of the pipeline's stage: first, second and third source, repeating.
WEIGHTS = [3, 1, 2]

ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT source, source_size, ([3, 1, 2])[(rank % 3 + 1)::INT] AS w FROM s),
-- sources by the level (words for a unit of weight) at which they are full; 12 / w is whole
o AS (SELECT *, source_size * (12 // w) AS lvl FROM w),
p AS (SELECT *, 2 * (SELECT sum(source_size) FROM o) * 3 // 2 AS t2,
      coalesce(sum(2 * source_size) OVER (ORDER BY lvl, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
      sum(w) OVER (ORDER BY lvl, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM o),
-- the first source that is not full when the level is as if it and all after it were not
f AS (SELECT min_by((t2 - 2 * caps, 2 * rest), lvl) AS x FROM p WHERE w * (t2 - 2 * caps) < 2 * source_size * 2 * rest),
g AS (SELECT source, source_size, w, (SELECT x FROM f) AS x FROM p),
h AS (SELECT source, source_size, CASE WHEN x IS NULL OR w * x[1] >= 2 * source_size * x[2] THEN CAST(2 * source_size AS BIGINT) ELSE CAST(w * x[1] AS BIGINT) END AS num,
      CASE WHEN x IS NULL OR w * x[1] >= 2 * source_size * x[2] THEN 1 ELSE CAST(x[2] AS BIGINT) END AS den FROM g),
r AS (SELECT *, CAST(num AS DOUBLE) / CAST(den AS DOUBLE) AS target, CASE WHEN source_size > 0 THEN CAST(num AS DOUBLE) / CAST(den AS DOUBLE) / source_size ELSE 0.0 END AS rate FROM h),
c AS (SELECT d.doc_id, d.size, r.source_size, r.target,
      CAST(floor(rate) AS BIGINT) + CASE WHEN ('0x' || substr(md5('mix-1:' || d.doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END AS copies
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies FROM c
"""
