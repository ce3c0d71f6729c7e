"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

``queries`` holds seconds; ``rates`` the figures that compare to published ones:
rows and vertices through the whole tiling phase a second; tiles, features and vertices through tile generation a second."""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from tesserae.functions import wkb
from tesserae.operators import density, tiles
from tesserae.plans import api, queries
from tesserae.session import configure

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "tile_density_z6 tile_pyramid_z0_z8 density_prefix_sum vertex_histogram geom_tile_range_join tile_semi_join tile_topk_priority "
    "morton_order kd_partition_assign partition_mbr_counts bbox_assign_smallest numeric_profile top_k_values profile_merge cosine_topk latest_upsert"
).split()


def timed(run) -> float:
    began = time.perf_counter()
    run()
    return time.perf_counter() - began


def main() -> None:
    spark = SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", CPUS).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    work = tempfile.mkdtemp(prefix="bench_")
    seconds: dict[str, float] = {}

    def noop(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    noop(queries.QUERIES["tile_density_z6"](spark, SF))  # warm
    for name in HEADLINE:
        seconds[name] = timed(lambda: noop(queries.QUERIES[name](spark, SF)))

    # the phases of a build, over the order boxes (five vertices each)
    boxes = queries.geo_orders(spark, SF).select("o_orderkey", "o_orderstatus", "o_totalprice", wkb.box_wkb("xmin", "ymin", "xmax", "ymax").alias("geometry"))
    boxes.write.parquet(f"{work}/in")
    rows = spark.read.parquet(f"{work}/in").count()
    seconds["tile_build"] = timed(lambda: api.tile(f"{work}/in", f"{work}/out", partition_size=1 << 18, histogram_zoom=9, spark=spark))
    read = spark.read.parquet(f"{work}/out/parquet_tiles")
    seconds["vertex_density_z12"] = timed(lambda: noop(density.histogram(density.vertices(read), 12)))
    built = tiles.build_tiles(read, 5)  # all features
    seconds["vector_tiles_z0_z5"] = timed(lambda: built.write.parquet(f"{work}/mvt"))
    made = spark.read.parquet(f"{work}/mvt").count()
    spark.stop()
    shutil.rmtree(work, ignore_errors=True)
    seconds = {k: round(v, 3) for k, v in seconds.items()}
    rates = {"tiling_rows_per_s": rows / seconds["tile_build"], "tiling_vertices_per_s": 5 * rows / seconds["tile_build"], "mvt_tiles_per_s": made / seconds["vector_tiles_z0_z5"], "mvt_features_per_s": rows / seconds["vector_tiles_z0_z5"], "mvt_vertices_per_s": 5 * rows / seconds["vector_tiles_z0_z5"]}
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "rates": {k: round(v, 1) for k, v in rates.items()}, "sf": SF.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    sys.exit(main())
