"""Time the headline queries: prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the number of local cores.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from codeq.plans import REGISTRY  # noqa: E402
from codeq.session import local_session  # noqa: E402

HEADLINE = (
    "rule_scan", "file_metrics", "all_findings", "halstead", "duplication_pct", "duplicate_lines",
    "review_metrics", "issues_ordered", "rolling_quality", "rolling_quality_exact", "badge_awards",
    "dashboard", "leaderboard", "user_profile", "repo_rollup", "streak_days",
)
OF_TEXT = ("rule_scan", "file_metrics", "all_findings", "duplication_pct", "review_metrics")


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    REGISTRY[name].job(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "codeq-bench")
    text = spark.read.parquet(f"{folder}/documents.parquet").selectExpr(
        "sum(octet_length(text)) / 1e6 as mb").first()["mb"]
    run(spark, "rule_scan", folder)  # start Python workers and compile once
    seconds = {name: round(min(run(spark, name, folder) for _ in range(2)), 3)
               for name in HEADLINE}
    scale = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(scale.group(1)) if scale else None,
        "mb_per_sec": {name: round(text / seconds[name], 1) for name in OF_TEXT},
    }))


if __name__ == "__main__":
    main()
