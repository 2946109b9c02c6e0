"""Headline timings: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rowsight.fixtures import table, view  # noqa: E402
from rowsight.operators import cleanse, duplicates, inject, nulls, statistics  # noqa: E402
from rowsight.plans import assess, recommend  # noqa: E402
from rowsight.session import local_session  # noqa: E402
from suite import queries  # noqa: E402

HEADLINE = {
    "assess_lineitem": lambda s, d: recommend.recommendations(assess.assess(table(s, d, "lineitem"), "prod.sales.lineitem")),
    "null_profile": lambda s, d: nulls.check_nulls(table(s, d, "lineitem"), "lineitem"),
    "dup_check": lambda s, d: duplicates.check_duplicates(table(s, d, "lineitem"), "lineitem"),
    "numeric_profile": lambda s, d: statistics.numeric_profile(table(s, d, "lineitem"), "lineitem"),
    "categorical_profile": lambda s, d: statistics.categorical_profile(table(s, d, "orders"), "orders"),
    "cleanse_invoices": lambda s, d: cleanse.cleanse(view(s, d, "raw_invoices"), cleanse.invoice_rules()),
    "inject_nulls": lambda s, d: inject.inject_nulls(table(s, d, "orders"), {"o_totalprice": 0.15}, ["o_orderkey"]),
    "vector_topk": queries.vector_topk,
    "search_tables": queries.search_tables,
    "recommendations": queries.recommendations,
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    table(spark, sf_dir, "region").count()  # start-up is not part of any query
    seconds = {}
    for name, query in HEADLINE.items():
        start = time.time()
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
