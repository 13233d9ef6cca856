"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) select data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lexiloom.plans import QUERIES
from lexiloom.session import local_session

HEADLINE = (
    "retention_report", "two_stage_gate", "strip_list_marks", "funnel_first_hit", "corpus_stats", "audit_split",
    "union_dedup", "seeded_shuffle", "minhash_dedup", "pack_blocks", "bigram_pmi", "sft_masked_samples",
    "token_spans", "topk_next_token", "aligned_soft_labels", "bpe_train", "bpe_encode", "knn_exact", "codebook_assign",
    "mean_pool", "extract_links", "bfs_expand", "pagerank", "choice_loglik", "accuracy_extremes", "semantic_entropy",
    "watermark_z", "routing_health", "enrich_stub", "stream_clean",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=cpus)
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for name in names:
        started = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - started, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
