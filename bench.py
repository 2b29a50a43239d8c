"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from postmatch.plans.registered import QUERIES
from postmatch.session import local_session

HEADLINE = (
    "refusals_by_reason funnel_row funnel_steps weekly_utility refusals_by_group visits_by_origin"
    " posting_scan_clean dedupe_exact_best dedupe_near_greedy drop_republications posting_rules"
    " discard_counts candidate_pairs match_score topk_per_profile full_ranking pack_digest globally_closed"
    " open_yesterday usage_budget judge_by_group upsert_winner retention_keep hourly_ceiling rate_limit_batch"
    " event_quality page_text json_source_records transition_events stream_ingest"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in os.environ.get("BENCH_QUERIES", " ".join(HEADLINE)).split():
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, wall time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
