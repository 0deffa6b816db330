"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and print one JSON line.

Each query's result is fully evaluated through Spark's ``noop`` sink (every column computed, nothing
first run in the session: plan, code generation, JIT) and warm (second run); ``value`` is the sum
of warm seconds and ``value_cold`` the sum of cold seconds. Row counts come from a separate count.
``build_1m_pairs`` times the whole dataset build on at least 1M pairs (rows/s).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from chatsift.session import local_session, release_scratch  # noqa: E402

HEADLINE = [
    "examples_multi_turn",
    "examples_context_3",
    "examples_unbounded_context",
    "examples_single_turn",
    "role_and_message_cleaning",
    "normalize_text",
    "length_gate_by_lang",
    "instruction_template",
    "dedup_keep_first_documents",
    "dedup_across_sources",
    "source_counts",
    "sample_exact_n",
    "split_assignment",
    "split_sizes",
    "jsonl_shape_dispatch",
    "csv_pairs_round_trip",
    "custom_directory_scan",
    "jsonl_round_trip",
    "build_report",
    "request_validation",
    "request_defaults",
    "request_assembly",
    "render_prompt",
    "apply_replies",
    "session_context_batch",
    "session_context_stream",
    "last_user_first_reply",
    "rejected_rows",
    "custom_directory_rejects",
    "six_source_counts",
    "examples_turn_pairs",
    "capped_build",
    "split_summary",
    "history_clip",
    "model_choice",
    "session_from_now",
]


def build_throughput(spark, sf_dir: str, target_pairs: int) -> dict:
    """Whole dataset build (clean, validate, dedup, exact split, JSONL + report) on at least
    ``target_pairs`` input pairs: the conversation pairs replicated by Spark with the replica index
    appended to both texts, so replicas are distinct examples. Returns rows/s over input pairs."""
    import math

    from pyspark.sql import functions as F

    from chatsift.config import BuildConfig
    from chatsift.plans.build import Sources, build_dataset
    from chatsift.plans.derive import adjacent_pairs
    from chatsift.session import scratch_path
    from chatsift.sources.tables import read_table

    pairs = adjacent_pairs(read_table(spark, sf_dir, "conversations"))
    base = pairs.count()
    reps = max(1, math.ceil(target_pairs / max(base, 1)))
    replicated = pairs.select(
        "conv_id", "turn", "input", "output", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep")
    ).select(
        F.concat_ws(":", "rep", "conv_id", "turn").alias("pair_key"),
        F.concat("input", F.lit(" #"), F.col("rep").cast("string")).alias("input"),
        F.concat("output", F.lit(" #"), F.col("rep").cast("string")).alias("output"),
    )
    n_in = base * reps
    cfg = BuildConfig(output_dir=scratch_path(spark, "bench-build"))
    t0 = time.perf_counter()
    res = build_dataset(spark, cfg, Sources(pairs=(replicated, "pair_key")))
    secs = time.perf_counter() - t0
    return {"input_pairs": n_in, "examples": res.total, "seconds": round(secs, 3),
            "rows_per_sec": round(n_in / secs, 1)}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")))
    from chatsift.plans.queries import QUERIES

    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    QUERIES["sample_exact_n"](spark, sf_dir).count()  # warm-up: JVM, parquet footers, codegen
    times: dict[str, float] = {}
    cold: dict[str, float] = {}
    rows: dict[str, int] = {}
    for name in names:
        for label in ("cold", "warm"):
            t0 = time.perf_counter()
            df = QUERIES[name](spark, sf_dir)
            df.write.format("noop").mode("overwrite").save()
            secs = round(time.perf_counter() - t0, 3)
            (cold if label == "cold" else times)[name] = secs
        rows[name] = df.count()
        release_scratch(spark)
    build = None
    target = int(os.environ.get("BENCH_BUILD_PAIRS", "1000000"))
    if target > 0:
        build = build_throughput(spark, sf_dir, target)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "sum_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "value_cold": round(sum(cold.values()), 3),
        "queries_cold": cold,
        "rows": rows,
        "build_1m_pairs": build,
        "sf": sf,
        "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
