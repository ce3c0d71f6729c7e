"""Mixing sources to target weights.

A document's size is its number of words; a source's target is its weighted
share of all sizes, but no more than ``limit`` times what it has.  What a source
can't take is shared again by weight among those below their limits; the result
is the water level: target = min(limit * size, level * weight).  A source's
repetition rate is target / size: each document is emitted floor(rate) times,
and once more if a hash of seed and id falls below the fraction, so runs agree.

All of it is DataFrame operations: one aggregate by source that combines before
its shuffle, a window over one row per source, and a join with that table: a
broadcast up to MOST_BROADCAST sources, a shuffle beyond.

Nulls: a null text has size 0; a null source is a source of its own, ordered
last; a null id hashes as ''.  Rows that repeat are each counted and mixed.
A source of size 0 has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .shared import materialize

WEIGHTS = (5, 2, 1)
SEED = 20
#: Sources whose targets are broadcast, at most.
MOST_BROADCAST = 100_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, limit: int = 3) -> DataFrame:
    """(source, source_size) -> those and weight, target."""
    by_code = W.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    place = (F.row_number().over(by_code) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), place + 1).cast("long")
    x = sizes.withColumn("weight", w)
    everything = W.partitionBy()
    x = x.withColumn("total", F.sum("source_size").over(everything)).withColumn("all_weight", F.sum("weight").over(everything))
    # in order of size / weight: those at their limits come first
    x = x.withColumn("fill", F.col("source_size") / F.col("weight"))
    before = W.orderBy("fill").rangeBetween(W.unboundedPreceding, W.currentRow)
    x = x.withColumn("full", limit * F.sum("source_size").over(before)).withColumn("left", F.col("all_weight") - F.sum("weight").over(before))
    # all up to this one at their limits: the level of the others is then (total - full) / left
    x = x.withColumn("level", (F.col("total") - F.col("full")) / F.nullif("left", F.lit(0)))
    at_limit = (F.col("left") > 0) & (F.col("full") <= F.col("total"))
    here = at_limit & (F.lit(limit) * F.col("fill") <= F.col("level"))
    x = x.withColumn("capped_full", F.max(F.when(here, F.col("full"))).over(everything)).withColumn("capped_left", F.min(F.when(here, F.col("left"))).over(everything))
    level = (F.col("total") - F.coalesce("capped_full", F.lit(0))) / F.coalesce("capped_left", "all_weight")
    target = F.least((limit * F.col("source_size")).cast("double"), level * F.col("weight"))
    return x.select("source", "source_size", "weight", target.alias("target"))


def mixed(
    documents: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    limit: int = 3,
    seed: int = SEED,
) -> DataFrame:
    """All columns of ``documents`` in the struct ``row``, with source, size, source_size, target, copies."""
    docs = documents.select(F.struct(*[F.col(f"`{c}`") for c in dict.fromkeys(documents.columns)]).alias("row"), F.col(id_col).cast("string").alias("key"), F.col(source_col).cast("string").alias("source"), size_of(F.col(text_col).cast("string")).alias("size"))
    plan = targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")), weights, limit)
    # one row a source: few are broadcast, so that no source's rows meet in one task; very many are joined by a shuffle
    plan = materialize(plan.withColumnRenamed("source", "its_source"), "mixing_targets")
    plan = F.broadcast(plan) if plan.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else plan
    x = docs.join(plan, F.col("source").eqNullSafe(F.col("its_source"))).drop("its_source")
    # a source without words is taken as it is
    rate = F.coalesce(F.col("target") / F.nullif("source_size", F.lit(0)), F.lit(1.0))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("key", F.lit(""))).cast("binary"))
    share = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    return x.select("row", "source", "size", "source_size", "target", (F.floor(rate) + (share < rate - F.floor(rate)).cast("int")).cast("long").alias("copies"))


def mix_report(documents: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    return mixed(documents, id_col=id_col, **options).select(F.col(f"row.{id_col}").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix_documents(documents: DataFrame, **options) -> DataFrame:
    """The rows of ``documents``, each as often as the mix takes it."""
    x = mixed(documents, **options).filter("copies > 0")
    return x.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1 AS INTEGER)] AS BIGINT) AS weight FROM s
), c AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total, CAST(sum(weight) OVER () AS BIGINT) AS all_weight,
    CAST(3 * sum(source_size) OVER f AS BIGINT) AS full_, CAST(sum(weight) OVER () - sum(weight) OVER f AS BIGINT) AS left_
  FROM w WINDOW f AS (ORDER BY source_size / weight RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), h AS (
  SELECT max(full_) AS f, min(left_) AS l FROM c
  WHERE left_ > 0 AND full_ <= total AND 3 * (source_size / weight) <= (total - full_) / left_
), t AS (
  SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), (total - coalesce(f, 0)) / coalesce(l, all_weight) * weight) AS target FROM c, h
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, coalesce(t.target / nullif(t.source_size, 0), 1.0) AS rate,
    CAST('0x' || substr(md5('20:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / 4503599627370496.0 AS share
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(rate) + CASE WHEN share < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""
