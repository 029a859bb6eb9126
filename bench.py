"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and threads.
"""

from __future__ import annotations

import json
import os
import time

from queuemill.plans.catalog import QUERIES
from queuemill.runtime import build_session

HEADLINE = [
    "team_workload", "current_state", "apply_decisions", "queue_board",
    "clean_text", "screening_audit", "corpus_profile", "context_blocks",
    "decision_summary", "promote_new", "stratified_split",
    "tfidf", "lexical_topk", "semantic_topk", "hybrid_topk", "choose_blend", "rank_fixes", "merge_near_fixes", "retrieve_batch",
    "soft_vote", "clf_metrics", "significance_table", "bootstrap_ci", "learning_curve", "tune_k",
    "head_nb", "head_logreg", "head_rf", "stream_ticket_state", "stream_decision_summary",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", cpus)
    spark.range(1000).selectExpr("sum(id)").collect()   # the session itself is not measured
    times = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
