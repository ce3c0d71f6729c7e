"""Attribute statistics: every column of a table in one aggregation.

Numbers and times: count, min, max, mean, population deviation, distinct, top values.
Text: count, lengths in code points, distinct, top values.  Others: as text.
Geometry: bounds, types, vertices.  Distinct counts come from mergeable sketches
(HyperLogLog, p = 12).  Top values are exact, kept if the 20 make up 80 % of the rows.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions import wkb

TOP, TOP_SHARE, SKETCH_BITS = 20, 0.8, 12


def role(field: T.StructField, geometry: str = "geometry") -> str:
    if field.name == geometry:
        return "geometry"
    if isinstance(field.dataType, (T.NumericType, T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "numeric"
    return "text" if isinstance(field.dataType, T.StringType) else "categorical"


def as_number(c: Column, kind: T.DataType) -> Column:
    """A double; times are seconds since 1970, NaN is null."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")) / 1e6
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double") * 86400
    d = c.cast("double")
    return F.when(~F.isnan(d), d)


def as_text(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BooleanType):
        return F.initcap(c.cast("string"))
    if isinstance(kind, T.BinaryType):
        return F.base64(c)
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c.cast("string"))
    return c.cast("string")


def aggregates(df: DataFrame, geometry: str = "geometry") -> dict[str, dict[str, Column]]:
    """Column name -> statistic -> aggregate expression."""
    out: dict[str, dict[str, Column]] = {}
    for f in df.schema:
        c, kind = F.col(f"`{f.name}`"), role(f, geometry)
        if kind == "geometry":
            continue
        text = as_text(c, f.dataType)
        stats = {"non_null_count": F.count(text), "approx_distinct": F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(text, F.lit(SKETCH_BITS))), F.lit(0))}
        if kind == "numeric":
            n = as_number(c, f.dataType)
            stats |= {"non_null_count": F.count(n), "min": F.min(n), "max": F.max(n), "mean": F.avg(n), "stddev": F.coalesce(F.stddev_pop(n), F.lit(0.0))}
        if kind == "text":
            size = F.length(c)
            stats |= {"avg_length": F.coalesce(F.avg(size), F.lit(0.0)), "min_length": F.min(size), "max_length": F.max(size)}
        out[f.name] = stats
    return out


def top_values_of(df: DataFrame, columns: list[str], k: int = TOP, share: float = TOP_SHARE) -> DataFrame:
    """(name, value, cnt) of each column's k most frequent values, ties by value; none of a column
    where they cover less than ``share``.  One aggregation and one window for all columns."""
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), as_text(F.col(f"`{c}`"), df.schema[c].dataType).alias("value")) for c in columns])
    counts = df.select(F.explode(pairs).alias("p")).select("p.*").filter("value is not null").groupBy("name", "value").agg(F.count("*").alias("cnt"))
    # the total of all values and the best of each task first, so that a column of distinct values isn't one task's
    place = F.row_number().over(W.partitionBy("name", "__part").orderBy(F.desc("cnt"), "value"))
    parted = counts.withColumn("__part", F.pmod(F.xxhash64("value"), F.lit(256))).withColumn("__n", place)
    rest = parted.withColumn("__keep", F.col("__n") <= k).groupBy("name", "__part").agg(F.sum("cnt").alias("total"), F.collect_list(F.when(F.col("__keep"), F.struct("value", "cnt"))).alias("best"))
    by_name = rest.groupBy("name").agg(F.sum("total").alias("total"), F.flatten(F.collect_list("best")).alias("best"))  # 256 times k
    order = F.array_sort("best", lambda a, b: F.when(a["cnt"] > b["cnt"], -1).when(a["cnt"] < b["cnt"], 1).when(a["value"] < b["value"], -1).when(a["value"] > b["value"], 1).otherwise(0))
    best = by_name.select("name", "total", F.slice(order, 1, k).alias("best"))
    best = best.filter(F.aggregate("best", F.lit(0).cast("long"), lambda s, v: s + v["cnt"]) >= share * F.col("total"))
    return best.select("name", F.explode("best").alias("b")).select("name", "b.value", "b.cnt")


def top_values(df: DataFrame, column: str, k: int = TOP, share: float = TOP_SHARE) -> DataFrame:
    """(value, cnt) of one column."""
    return top_values_of(df, [column], k, share).select("value", "cnt")


def geometry_statistics(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """(xmin, ymin, xmax, ymax, total_points, geom_types map); null, empty and undecodable geometries count nowhere."""
    g = df.select(wkb.st_geometry_type(geometry).alias("type"), wkb.st_bounds(geometry).alias("b"), wkb.st_n_points(geometry).alias("n")).filter("n > 0")
    by_type = g.groupBy("type").agg(F.count("*").alias("c"), F.sum("n").alias("n"), *[f(F.col(f"b.{x}")).alias(x) for x, f in (("xmin", F.min), ("ymin", F.min), ("xmax", F.max), ("ymax", F.max))])
    return by_type.agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_points"), F.map_from_entries(F.collect_list(F.struct("type", "c"))).alias("geom_types"))


def partial_numeric(df: DataFrame, column: str, by: Column) -> DataFrame:
    """Mergeable partial statistics of a numeric column by group: count, sum, squares about the mean, extremes, sketch."""
    n = as_number(F.col(column), df.schema[column].dataType)
    return df.groupBy(by.alias("part")).agg(F.count(n).alias("n"), F.avg(n).alias("mean"), (F.coalesce(F.var_pop(n), F.lit(0.0)) * F.count(n)).alias("m2"), F.min(n).alias("lo"), F.max(n).alias("hi"), F.hll_sketch_agg(F.col(column).cast("string"), F.lit(SKETCH_BITS)).alias("sketch"))


def merge_numeric(partials: DataFrame) -> DataFrame:
    """The statistics of the whole from those of its parts."""
    total = F.sum("n")
    mean = F.sum(F.col("n") * F.col("mean")) / total
    # squares about the whole's mean: those about the parts' means, and the parts' means about the whole's
    spread = F.sum(F.col("m2") + F.col("n") * F.col("mean") * F.col("mean")) - total * mean * mean
    return partials.agg(total.alias("non_null_count"), F.min("lo").alias("min"), F.max("hi").alias("max"), mean.alias("mean"), F.sqrt(F.greatest(spread / total, F.lit(0.0))).alias("stddev"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("approx_distinct"))


def profile(df: DataFrame, geometry: str = "geometry") -> dict:
    """{"attributes": [{"name", "stats"}]}: one pass for all statistics, one for all top values."""
    stats = aggregates(df, geometry)
    flat = [c.alias(f"{name}\x00{k}") for name, s in stats.items() for k, c in s.items()]
    got = df.agg(*flat).first().asDict() if flat else {}
    top: dict[str, list] = {name: [] for name in stats}
    if stats:
        for r in top_values_of(df, list(stats)).collect():  # TOP rows a column
            top[r["name"]].append({"value": r["value"], "count": r["cnt"]})
    out = []
    for f in df.schema:
        if f.name == geometry:
            g = geometry_statistics(df, geometry).first()
            box = None if g["xmin"] is None else [g["xmin"], g["ymin"], g["xmax"], g["ymax"]]
            out.append({"name": f.name, "stats": {"mbr": box, "geom_types": g["geom_types"] or {}, "total_points": g["total_points"]}})
            continue
        s = {k: got[f"{f.name}\x00{k}"] for k in stats[f.name]}
        s["top_k"] = sorted(top[f.name], key=lambda v: (-v["count"], v["value"]))
        out.append({"name": f.name, "stats": s})
    return {"attributes": out}


def write_profile(stats: dict, path: str) -> None:
    from ..sources import files

    files.write(path, json.dumps(stats, indent=2, default=str).encode())


def attribute_role(name: Column, kind: Column, distinct: Column, categories: int = 50) -> Column:
    """geometry, numeric, categorical_text (few distinct texts), text or categorical."""
    return F.when(name == "geometry", "geometry").when(kind == "numeric", "numeric").when((kind == "text") & (distinct <= categories), "categorical_text").when(kind == "text", "text").otherwise("categorical")


def runs(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Numbers consecutive rows of equal ``value`` within each ``by``."""
    w = W.partitionBy(by).orderBy(order)
    new = (~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int")
    return df.withColumn("__new", F.when(F.row_number().over(w) == 1, 1).otherwise(new)).withColumn("run", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))).drop("__new")
