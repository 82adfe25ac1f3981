"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma separated names; default the headline list).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from topicpulse.plans.registry import catalogue  # noqa: E402
from topicpulse.session import local_session  # noqa: E402

HEADLINE = [
    "demand_weekly_pulse",
    "agg02_by_platform",
    "agg05_category_dist",
    "agg06_tag_counts",
    "joi01_article_demands",
    "joi02_demand_articles",
    "joi05_skip_known_urls",
    "sor01_page_articles",
    "sor04_search_top",
    "trd02_detect_trends",
    "trd06_all_period_changes",
    "win02_failure_streak",
    "ups01_upsert_articles",
    "ups05_merge_annotation",
    "snk04_weekly_report",
    "src01_normalize_kr36",
    "txt05_clean_text",
    "txt06_main_text",
    "cls01_classify",
    "ext05_validate_demands",
    "ent02_fuzzy_best_match",
    "ent04_tfidf_candidates",
    "ent06_dedup_cascade",
    "ent09_duplicate_clusters",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    known = catalogue()
    wanted = os.environ.get("BENCH_QUERIES")
    names = wanted.split(",") if wanted else [n for n in HEADLINE if n in known]
    if names == ["all"]:
        names = list(known)
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    # Warm the session up: class loading and the first Python worker are not the queries' cost.
    known["agg02_by_platform"](spark, folder).write.format("noop").mode("overwrite").save()
    known["txt06_main_text"](spark, folder).limit(1).count()
    seconds: dict[str, float] = {}
    for name in names:
        started = time.perf_counter()
        known[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "headline_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
