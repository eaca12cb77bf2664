"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR  tables (default /root/testdata/sf0.1)
BENCH_CPUS    local threads (default 8)
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from filingpanel import catalog  # noqa: E402
from filingpanel.plans.session import builder  # noqa: E402

HEADLINE = [
    "filing_scores", "sentence_table", "span_table", "stratified_sample_defaults", "readability", "sentiment",
    "novelty_proxy", "relevance_proxy", "surprisal_novelty", "ksparse_activations", "document_panel",
    "filing_representation", "event_outcomes_full_windows", "asof_latest", "rolling_volatility_60", "momentum",
    "assemble_controls", "winsorize", "moments", "ols_robust", "ols_clustered", "lasso_cv", "pricing_forward_cv",
    "decompose", "fdr_bh", "summary_stats", "high_examples", "validation_report",
]


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        builder("bench").master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.filingpanel.scanPartitions", cpus)  # the test tables are files of one row group
        .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{d}/lineitem.parquet").count()  # start the engine before timing
    queries, times = catalog.queries(), {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, d).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    sf = re.search(r"sf([0-9.]+)", d)
    print(json.dumps({
        "metric": "total time of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(sf.group(1)) if sf else None,
    }))


if __name__ == "__main__":
    main()
