"""Headline queries, timed: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = [
    "teacher_workload", "teacher_clash", "clashing_rows", "adjacent_gap", "version_diff", "duty_sequence", "repeated_periods", "timetable_grid",
    "who_teaches_what", "resolve_names", "suggest_names", "period_rules", "build_lines", "html_lines", "cross_check", "plan_retention", "roster_candidates", "throttle",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from rollbook.session import local_session

    spark = local_session(cpus, shuffle_partitions=max(8, int(cpus)) if cpus.isdigit() else 8, name="bench")
    from rollbook.plans import load_all
    from rollbook.plans.registry import QUERIES

    load_all()
    QUERIES["teacher_workload"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm the JVM
    times: dict[str, float] = {}
    only = sys.argv[1:] or HEADLINES
    for name in only:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
