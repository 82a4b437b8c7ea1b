"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from chartspark.harness import load_queries
from chartspark.harness.registry import Tables
from chartspark.harness.tables import candidate_items, chart_facts
from chartspark.session import local_session, tune

HEADLINE = (
    "guardrail_check", "split_sentences", "merge_groups", "merge_exact", "chart_code_index", "match_observation", "reconcile",
    "augmentation_summary", "lexical_search", "price_calls", "fact_stability", "span_overlap", "normalize_ingredient", "build_condition",
)
#: Timed as well, but not part of the total, which stays comparable from round to round.
OTHERS = ("map_facts", "backoff_search", "vector_search")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = tune(local_session(cpus, shuffle_partitions=int(cpus), memory=os.environ.get("BENCH_MEMORY", "12g")))
    spark.sparkContext.setLogLevel("ERROR")
    queries = load_queries()
    seconds: dict[str, float] = {}
    rows: dict[str, int] = {}
    tables = Tables(spark, folder)
    start = time.time()
    rows["candidates"], rows["chart"] = candidate_items(tables).count(), chart_facts(tables).count()
    seconds["stored_inputs"] = round(time.time() - start, 3)
    rows["documents"] = tables.documents.count()
    for name in HEADLINE:
        start = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    total = round(sum(seconds.values()), 3)
    for name in OTHERS:
        start = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    work = {
        "guardrail_and_split": rows["documents"] / (seconds["guardrail_check"] + seconds["split_sentences"]),
        "merge": rows["candidates"] / seconds["merge_exact"],
        "reconcile": rows["candidates"] / seconds["reconcile"],
    }
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
                "input_rows": rows,
                "rows_per_sec": {k: round(v, 1) for k, v in work.items()},
            }
        )
    )


if __name__ == "__main__":
    main()
