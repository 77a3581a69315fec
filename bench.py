"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ermine.plans import fixtures as FX  # noqa: E402
from ermine.plans.registry import QUERIES  # noqa: E402
from ermine.session import build_session  # noqa: E402

HEADLINE = [
    "t1_tokens", "t3_t4_t5_chunk_names", "r3_rule_hits", "r14_rule_hits", "r15_rule_hits", "r17_rule_hits",
    "r18_r19_selected_fragments", "a1_doc_model_rels", "a7_a10_part_model_rels", "e2_class_scores",
    "e5_rel_scores_exact", "e8_size_similarity",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    names = [q for q in (sys.argv[1:] or HEADLINE) if q in QUERIES]
    times = {}
    for name in names:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = sf_dir.rstrip("/").split("sf")[-1]
    print(json.dumps({"metric": "sum_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))
    FX._CACHE.clear()
    spark.stop()


if __name__ == "__main__":
    main()
