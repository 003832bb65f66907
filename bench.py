"""Times the headline queries; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = ["route_profile_stats", "route_zones", "route_peaks", "route_climbs", "steep_sections", "difficulty_rating", "segment_metrics", "edge_usage", "running_weight", "routing_weight", "connectivity", "nearest_nodes", "tile_lookup", "jaccard_pairs", "fitness_terms", "survivors", "shortest_distances", "near_paths", "k_shortest_paths", "raster_samples", "segment_properties", "fitness", "micro_scores", "novelty", "neutral_mutation", "detailed_path", "initial_routes", "route_search", "any_pair_distances", "traced_paths", "customer_nearest", "rebuilt_edges", "projected_samples", "block_samples", "clustered_box"]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    spark = builder.config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from tarnline.plans.registry import QUERIES

    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name in HEADLINE:
        if name in QUERIES:
            began = time.time()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
