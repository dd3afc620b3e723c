"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from trajmill.plans.catalog import QUERIES
from trajmill.session import local_session

HEADLINE = (
    "win_cap_per_key",
    "win_mix_budget",
    "agg_mix_report",
    "samp_reservoir",
    "shard_floor",
    "win_row_index",
    "str_redact",
    "str_pretokenize",
    "tok_render_chat",
    "tok_completion_mask",
    "tok_completion_mask_rows",
    "tok_encode_ranks",
    "tok_verify",
    "tok_pack_bfd",
    "tok_pack_rows",
    "win_latest_valid",
    "join_work_status",
    "join_missing_as_failure",
    "agg_pass1_estimator",
    "agg_repo_breakdown",
    "project_published",
    "win_attempt_elapsed",
    "agg_centroid",
    "scan_jsonl",
    "stream_cycle_counts",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4)))
    only = os.environ.get("BENCH_QUERIES")
    spark = local_session(cores, "bench")
    spark.read.parquet(f"{sf_dir}/documents.parquet").count()  # start the executors
    seconds = {}
    for name in only.split(",") if only else HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_wall",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cores": cores,
            }
        )
    )


if __name__ == "__main__":
    main()
