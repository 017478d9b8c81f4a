"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the cores. Every query runs to a
sink that consumes all rows and columns; one small run first warms the JVM.
"""

from __future__ import annotations

import json
import os
import sys
import time

from reviewops.plans.catalog import QUERIES
from reviewops.session import local_session

HEADLINE = [
    "clean_reviews", "topic_tags", "topic_stats", "hotel_summary", "impact_table", "trends", "ranked_issues", "topic_cooccurrence",
    "root_causes", "root_cause_evidence", "action_plans", "roi", "hotel_report", "monthly_complaint_rate", "topic_samples",
    "sentiment_score", "ensemble_score", "document_topics", "document_sentiment", "hotel_word_frequency", "collocations",
    "tfidf_weights", "tfidf_top_terms", "train_test_split", "classification_report", "evaluation_report",
    "text_analysis", "review_word_frequency", "recent_reviews", "filtered_reviews", "hotel_report_all", "text_root_cause_evidence", "text_text_analysis",
    "dictionary_matches", "numeric_describe", "written_report", "separable_topic",
]


def run(query, spark, folder: str) -> float:
    start = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, memory=os.environ.get("BENCH_MEMORY", "16g"))
    spark.sparkContext.setLogLevel("ERROR")
    run(QUERIES["ranked_issues"], spark, folder)
    names = sys.argv[1:] or HEADLINE
    times = {name: run(QUERIES[name], spark, folder) for name in names}
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": cpus}))


if __name__ == "__main__":
    main()
