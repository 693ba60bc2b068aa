"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from tidemark.plans import all_queries
from tidemark.session import build_session

HEADLINE = (
    "as_of_state", "effective_at_state", "as_of_every_deadline", "match_table", "trailing_mean", "minutes_training_table",
    "attacking_training_table", "defensive_training_table", "cards_training_table", "saves_training_table",
    "bonus_training_table", "serve_minutes_rows", "serve_bonus_rows", "resolve_players", "scoreline_summary",
    "count_mixture", "combine_fixture_distributions", "evaluate_each_class", "isotonic_knots", "walk_forward_predictions",
    "points_from_outcomes", "score_decisions_with_autosubs", "hold_lengths", "heartbeat_gaps",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
                          spark__ui__enabled="false", spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = all_queries()
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()  # start the JVM's readers outside the timings
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_wall_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
