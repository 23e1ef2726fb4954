"""Wall-clock of the headline jobs: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set data and cores. Every job writes to the noop
sink, so all columns are computed and nothing is collected."""

from __future__ import annotations

import json
import os
import time

import catalog
from glyphmill import build_session

HEADLINE = [
    "w1_training_table", "w2_merge_version", "w3_passage_pool", "w5_redact_corpus", "w9_mine_candidates", "w13_evaluation_report", "w14_prompt_pool",
    "c1_decontaminate_text", "c3_decontaminate_sentences_25", "d1b_dedup_norm", "d2a_conflicts_and_dedup", "e2_quota", "e8_split_exact", "h36_label_counts",
    "i7_insert_payloads", "n3_auc_by_lang", "n8_tune_thresholds", "l3_mine",
]


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    catalog.load_all()
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": str(2 * int(cpus)), "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g", "glyphmill.read.partitions": str(2 * int(cpus))})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{d}/documents.parquet").selectExpr("sum(length(text))").collect()  # start the executors
    times = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        catalog.QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    print(json.dumps({"metric": "headline_jobs_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(d.rstrip("/")).replace("sf", "")}))


if __name__ == "__main__":
    main()
