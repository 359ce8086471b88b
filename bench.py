"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the cores.  Each query is run twice and the
better time counts.  ``--loops`` also times the one-job-per-column and one-job-per-pair formulation of four
operators, for comparison.
"""

from __future__ import annotations

import json
import os
import sys
import time
from itertools import combinations
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402

from colscope.session import build_session  # noqa: E402
from colscope.suite import QUERIES  # noqa: E402
from colscope.suite.modelling import _PATHS  # noqa: E402

HEADLINE = [
    "univariate_summary", "univariate_summary_sketched", "histogram_of_buckets", "histogram_of_categories",
    "distinct_counts", "grouped_quantiles", "infer_column_types_all_rows", "correlation_and_covariance",
    "contingency_tables", "clean_numbers", "update_columns", "formula_normalize", "formula_outliers",
    "formula_conditionals", "tree_node_report", "tree_node_report_regression", "label_metrics",
    "decision_tree_classifier", "isolation_forest_nodes", "anomaly_scores", "latest_per_name", "sql_join_revenue",
    "sql_group_by", "sql_window_ranking", "profile_summary",
]


def seconds(run, times: int = 2) -> float:
    best = float("inf")
    for _ in range(times):
        start = time.perf_counter()
        run()
        best = min(best, time.perf_counter() - start)
    return round(best, 3)


def loops(spark, folder: str) -> dict[str, float]:
    """The same results a job at a time."""
    df = spark.read.parquet(f"{folder}/lineitem.parquet")
    numbers = [f.name for f in df.schema.fields if f.dataType.typeName() in ("long", "integer", "double")]

    def summary():
        for c in df.columns:
            df.filter(F.col(c).isNull()).count()
            df.select(c).distinct().count()
            if c in numbers:
                df.select(F.col(c).cast("double")).describe(c).collect()
                df.select(F.percentile(F.col(c).cast("double"), F.lit(0.5))).collect()

    def pairs():
        for a, b in combinations(["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"], 2):
            kept = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
            kept.select(F.col(a).cast("double"), F.col(b).cast("double")).stat.corr(a, b)
            kept.select(F.col(a).cast("double"), F.col(b).cast("double")).stat.cov(a, b)

    def nodes():
        df.createOrReplaceTempView("rows")
        for path in _PATHS.values():
            spark.sql(f"SELECT l_returnflag, count(*) FROM rows WHERE {path} GROUP BY 1").collect()

    def quantiles():
        for flag in ("A", "N", "R"):
            kept = df.filter(F.col("l_returnflag") == flag)
            kept.select(F.percentile("l_extendedprice", F.array(*map(F.lit, (0.05, 0.5, 0.95))))).collect()

    return {"univariate_summary": seconds(summary, 1), "correlation_and_covariance": seconds(pairs, 1),
            "tree_node_report": seconds(nodes, 1), "grouped_quantiles": seconds(quantiles, 1)}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
                          spark__driver__memory="16g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        times[name] = seconds(lambda: QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save())
    line = {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
            "sf": Path(folder).name.removeprefix("sf")}
    if "--loops" in sys.argv:
        line["one_job_per_item"] = loops(spark, folder)
    print(json.dumps(line))


if __name__ == "__main__":
    main()
