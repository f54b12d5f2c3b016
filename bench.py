"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data (default sf0.1), BENCH_CPUS the local cores and
BENCH_RUNS the runs per query, of which the fastest counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from textloom.plans.catalog import QUERIES  # noqa: E402
from textloom.session import build_session  # noqa: E402

HEADLINE = [
    "a2_csv",
    "b2_mojibake",
    "c6_contains_regex",
    "d2_replace_first",
    "e4_sample_fraction",
    "e6_shuffle",
    "f1_inner",
    "f1_inner_hot_keys",
    "g6_distinct_elements",
    "h1_group",
    "h2_describe",
    "i1_row_index",
    "j3_text",
    "k1_tokenise",
    "k5_token_store",
    "k10_concordance",
    "k11_flat_hits",
    "k13_neighbour_freqs",
    "k15_token_concordance",
    "k23_dispersion",
    "k25_dispersion_detach",
    "k26_frequencies",
    "k28_keyness",
    "k33_weekly",
    "k35_numeric_bins",
    "k41_missing_buckets",
    "k45_cluster",
    "k48_topic_words",
    "k55_quotations",
    "k59_classify",
    "k61_save_edits",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        shuffle_partitions=int(cpus) if cpus.isdigit() else 8,
        **{
            "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
            "spark.textloom.inputPartitions": cpus if cpus.isdigit() else "8",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        best = float("inf")
        for _ in range(runs):
            begin = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - begin)
        times[name] = round(best, 3)
    report = {
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")),
        "cpus": cpus,
    }
    print(json.dumps(report))
    spark.stop()


if __name__ == "__main__":
    main()
