"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores,
``BENCH_QUERIES`` (optional, comma separated) another choice of queries.
"""

from __future__ import annotations

import json
import os
import re
import time

from lexalia import build_session
from lexalia.plans import registry

HEADLINE = (
    "top_terms_tf top_terms_df doc_length_stats tail_date_parse author_match_before_after "
    "token_clean document_rebuild term_days dtm term_doc_freq tfidf cosine_pairs cluster_lift "
    "window_texts xml_ingest group_tfidf text_edges edge_cutoff closeness_z lda_topics"
).split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    spark = build_session("bench", cores, shuffle_partitions=max(int(cores), 8))
    registry.load_all()
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads
    seconds = {}
    for name in chosen.split(",") if chosen else HEADLINE:
        start = time.perf_counter()
        registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": float(scale.group(1)) if scale else None,
        "cores": int(cores), "spark": spark.version}))


if __name__ == "__main__":
    main()
