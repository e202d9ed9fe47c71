"""Time the headline queries: one JSON line with seconds per query.

Each query runs once to the end, in a session that has read a table before; results go to a
sink that discards rows, so every row is computed and none is collected. ``python bench.py --all``
takes every registered query of the library; names may be given instead. With ``BENCH_WARM=1`` each
query runs a second time, and ``warm`` holds these times.
"""

from __future__ import annotations

import json
import os
import sys
import time

from wayledger.plans.catalog import QUERIES
from wayledger.session import build_session

HEADLINE = [
    "plt1_canonical", "pse1_pseudonym", "plt6_legacy_assembly", "plt11_near_misses",
    "snk2_reads_layout", "snk5_content_addressed",
    "ing1_new_events", "ing4_chain_verdict", "ing7_arrival_gaps", "ing11_reads", "ing12_superseded", "ing14_15_sessions",
    "ing17_receipt", "scr1_hits", "scr1_hits_per_category", "scr4_hit_list", "ano3_impossible_movement", "ano5_all_anomalies",
    "qry1_sightings", "qry2_partial_plate", "qry5_convoy", "qry6_occupancy", "qry7_statistics", "qry8_hourly_rollup",
    "gov1_folded_log", "ret1_sweep_counts", "ret4_legal_hold", "ret5_erasure_kept",
    "fus2_pooled_posteriors", "fus6_7_8_fused_reads", "zon4_5_transitions", "zon6_7_sessions", "trk1_link_candidates",
    "trk2_passages", "crp1_crop_quality", "crp2_selected_crops", "evl1_2_strata", "evl5_edit_distance", "evl7_split",
    "evl13_track_shapes", "qry8_stream_rollup", "ing4_chain_breaks", "zon8_session_plates", "trk3_provisional_triggers",
    "trk4_read_payloads", "ret1_sweep_kept",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g",
        "spark.sql.shuffle.partitions": cpus,
    })
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    warm: dict[str, float] = {}
    for name in sorted(QUERIES) if sys.argv[1:] == ["--all"] else sys.argv[1:] or HEADLINE:
        for into in [times, warm] if os.environ.get("BENCH_WARM") == "1" else [times]:
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            into[name] = round(time.perf_counter() - start, 3)
            print(name, into[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        **({"warm": warm} if warm else {}),
        "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf") or 0),
    }))


if __name__ == "__main__":
    main()
