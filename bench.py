"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set the data
and the cores. Each query runs to completion into a no-op sink, so results are fully
computed and never collected.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from arborstat import catalog  # noqa: E402
from arborstat.session import local_session  # noqa: E402

HEADLINES = [
    "i06_qc_batch", "c12_weighted_total_scorer", "c15_findings", "j04_integrated_dataset", "f02_rank_quartile", "f04_entity_slopes",
    "f07_value_at_target", "f09_decay_table", "e05_generation_stats", "e08_region_rollup", "e09_peripheral_stats", "e12_metric_vector",
    "f13_polyline_lengths", "f14_trimmed_profile", "e14_intensity_stats", "e16_histogram_entropy", "e22_image_pair_quality",
    "g10_neighbour_counts", "g03_connected_components", "g03_voxel_components", "g05_node_generations", "g06_path_distances",
    "j10_closest_pair", "h01_pearson_pairs", "h02_spearman_pairs", "h10_error_metrics", "h11_model_grid", "e27_tag_profile", "i01_change_rows",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.callables()
    queries["e08_region_rollup"](spark, sf).write.format("noop").mode("overwrite").save()  # start executors, load classes
    times = {}
    for name in HEADLINES:
        t0 = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    scale = float(Path(sf).name.removeprefix("sf") or 0) if Path(sf).name.startswith("sf") else None
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": scale}))


if __name__ == "__main__":
    main()
