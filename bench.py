"""Times of the headline queries: one JSON line. BENCH_SF_DIR is the data, BENCH_CPUS the cores."""

import json
import os
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
HEADLINE = ["rolling_stats", "local_mad_outliers", "linear_fill", "autocorrelation", "rr_rates", "hrv", "acwr_7_28", "ctl_atl_tsb", "ride_metrics", "asof_ftp_resolution", "session_match_pairs", "pairwise_distances", "knn_predict", "gaussian_nb", "roc_auc", "transfer_entropy", "recurrence_quantification", "sample_entropy"]


def main() -> None:
    import sys

    root = os.path.dirname(os.path.abspath(__file__))
    os.environ["PYTHONPATH"] = f"{root}:{os.environ.get('PYTHONPATH', '')}"
    sys.path.insert(0, root)
    from tidewave import registry
    from tidewave.session import session

    spark = session(os.environ.get("BENCH_CPUS", "8"))
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        began = time.time()
        registry.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/"))}))


if __name__ == "__main__":
    main()
