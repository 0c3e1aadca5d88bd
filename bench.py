"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from quirefold.plans.registry import REGISTRY
from quirefold.session import build_session

HEADLINE = [
    "L3_section_carry",
    "L8_chunk_with_overlap",
    "P5_mask",
    "P6_pii_counts",
    "R1_hash_embed",
    "R4_dense_topk",
    "R9_bm25_stats",
    "R10_bm25_topk",
    "R17_hybrid_retrieve",
    "Q5_route_intent",
    "A5_verify_claims",
    "A8_batch_qa",
    "E2_faithfulness",
    "T3_sm2_replay",
    "G3_rate_audit",
    "G6_activity_sessions",
    "S3_replace_document_chunks",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    for name in ("L7_estimate_tokens", "R7_embed_external"):  # start the JVM and Python workers
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
