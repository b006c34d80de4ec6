"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from srclens.plans.queries import QUERIES
from srclens.session import drop_written, local_session

HEADLINE = [
    "package_statistics",
    "corpus_statistics",
    "class_declarations",
    "method_declarations",
    "class_requests",
    "decision_scores",
    "fixed_chunks",
    "separator_chunks",
    "numbered_documents",
    "commit_summaries",
    "first_match_lookup",
    "batch_nearest",
    "nearest_vectors",
    "corpus_documents",
    "knowledge_sections",
    "type_relations",
    "list_nearest",
]
WARM_DIR = "/root/testdata/sf0.001"


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "srclens-bench")
    # warm up: JVM, code generation and the Python workers, on the smallest tables
    for name in ("package_statistics", "batch_nearest"):
        QUERIES[name](spark, WARM_DIR if os.path.isdir(WARM_DIR) else sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count()
    n_files, n_docs, n_vectors = read("orders") + read("supplier"), read("documents"), read("embeddings")
    rate = lambda n, q: round(n / times[q], 1) if q in times else None
    print(
        json.dumps(
            {
                "metric": "total_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cores": cpus,
                "rates": {
                    "extraction_files_per_sec": rate(n_files, "package_statistics"),
                    "decision_score_docs_per_sec": rate(n_docs, "decision_scores"),
                    "chunking_docs_per_sec": rate(n_docs, "fixed_chunks"),
                    "exact_topk_queries_per_sec": rate(n_vectors, "batch_nearest"),
                },
            }
        )
    )
    drop_written(spark)


if __name__ == "__main__":
    main()
