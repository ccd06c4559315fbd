"""Times the headline queries: warm seconds each, median of three runs. Prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [sys.path[0], os.environ.get("PYTHONPATH", "")]))

from claimforge.plans import registry  # noqa: E402
from claimforge.session import local_session  # noqa: E402

HEADLINE = (
    "resolve_prefer_weight", "resolve_max", "resolve_ladder", "conflict_report", "confidence_score", "stats_grouping_sets", "stats_by_open_risk", "exposure_weighted",
    "buyer_rollup", "blocking_risk", "block_accounting_pivot", "duplicate_groups", "track_standing", "digest_rank", "feed_verdicts", "publisher_policy", "clean_tiers",
    "implausible_figures", "contradictions", "keyword_filter", "first_seen_dedup", "daily_digest_window",
)


def main() -> None:
    directory, cores = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, int(cores))
    took: dict[str, float] = {}
    for name in HEADLINE:
        query, runs = registry.queries()[name], []
        for k in range(4):
            began = time.perf_counter()
            query(spark, directory).write.format("noop").mode("overwrite").save()
            if k:
                runs.append(time.perf_counter() - began)
        took[name] = round(statistics.median(runs), 3)
    print(json.dumps({"metric": "headline queries, warm", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": directory.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
