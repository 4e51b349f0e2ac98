"""Benchmark: headline queries on the driver tables at ``$BENCH_SF_DIR`` (default sf0.1) on
``local[$BENCH_CPUS]``; one warm-up, median of ``$BENCH_RUNS`` (default 3) timed runs, noop sink.
Prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpusrisk.plans.catalog import catalog  # noqa: E402
from corpusrisk.session import local_session  # noqa: E402

HEADLINE = [
    "vocab_class_counts",  # scan, join, regex tokenise, two-level aggregation, HAVING
    "ft_vocab_vectorise",  # first-seen vocabulary ids + vocabulary join + per-document regroup
    "ft_bow",  # alphabetical vocabulary + bag-of-words counts
    "fn_denoise",  # comment / string stripping + operator tokeniser
    "win_stream_pack",  # LM corpus: top-k vocabulary, next-token ids, stream packing
    "ev_roc_auc_avg_precision",  # curve points via skew-safe running sums
    "rep_alert_volume",  # PR curves -> volumes -> threshold means
    "rep_pr_at_ref",  # curve vs baseline reference point
    "syn_profile",  # statement positions, last frees, min distance
    "dif_changed_lines",  # set-form line diff over document version pairs
    "jn_blame",  # advisories -> fix commits -> blamed lines
    "agg_pool",  # vector pooling
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "8")), app="corpusrisk-bench")
    cat = catalog()
    times = {}
    for name in names:
        fn = cat[name][0]

        def once() -> float:
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - t0

        once()  # warm-up
        times[name] = round(statistics.median(once() for _ in range(runs)), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "sum_median_query_sec", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf, "cpus": cpus, "runs": runs}))


if __name__ == "__main__":
    main()
