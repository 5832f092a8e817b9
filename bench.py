"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "a1_mesh", "a2_county_activity", "a3_vitals", "a4_judge_quality", "a5_final_quality", "a8_score_event", "a9_trust_record", "a13_leaderboard", "a14_activity_by_day",
    "a15_county_rollup", "a22_feed_problems", "a24_weekly_measures", "a29_graph_edges", "f9_filter_items", "g1_events", "g2_alert_threads", "g3_thread_lifecycle", "g5_stories_components",
    "j1_neighbor_pairs", "j7_county_of_point", "j10_subscribers_for", "j11_alert_audience", "j13_places_in_text", "j22_grid_as_of", "j23_grid_sample", "s1_normalize_alerts",
    "s5_normalize_stations", "s16_extract_readings_from_messages", "t4_reading_list", "w2_rise", "w8_sparkline", "x11_nearest_rank",
]


def main() -> None:
    from gossamer.catalog import QUERIES, load_all
    from gossamer.session import build_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 16g pyspark-shell")
    spark = build_session("bench", f"local[{cpus}]", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    load_all()
    spark.read.parquet(f"{sf}/events.parquet").count()
    QUERIES["a1_mesh"](spark, sf).write.format("noop").mode("overwrite").save()
    names = [n for n in sys.argv[1:]] or HEADLINE
    times = {}
    for n in names:
        t0 = time.time()
        QUERIES[n](spark, sf).write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t0, 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total wall-clock", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf.rsplit("sf", 1)[-1], "cpus": cpus}))


if __name__ == "__main__":
    main()
