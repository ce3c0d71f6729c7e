"""Connected components of an edge table by alternating star contractions.

Each round is two aggregations that combine before their shuffle and two joins
of edges with one row per node.  Both sides of a join are shuffled for it alone
(its second key sees to that), so a node with very many edges can be split by
adaptive execution and is no single task's work.  Rounds end when the edges are
stars; their number grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, release


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): every node that has an edge to another, with the
    smallest node it is connected to.  Nulls and loops are ignored.  Raises if
    ``max_rounds`` rounds don't end it."""

    def meet(left: DataFrame, low: DataFrame) -> DataFrame:
        return left.withColumn("h", F.xxhash64("u")).join(low.withColumn("h", F.xxhash64("u")), ["u", "h"])

    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    e = materialize(e, "components")
    mark = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of u goes to u's smallest neighbour
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        new = meet(both.filter("v > u"), low).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u's smaller neighbours and u go to the smallest of them
        low = new.groupBy("u").agg(F.min("v").alias("m"))
        new = meet(new, low).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").filter("u <> v").distinct()
        new = materialize(new, "components")
        release(e)
        e = new
        n, total, check, tops = e.agg(F.count("*"), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")).first()
        if n == tops and (n, total, check) == mark:
            break
        mark = (n, total, check)
    else:
        raise RuntimeError(f"components not found in {max_rounds} rounds")
    tops = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(tops)
