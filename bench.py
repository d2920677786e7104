"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lodestone import queries as q  # noqa: E402
from lodestone.operators.indexes import CellTree, Forest, Graph, VectorIndex  # noqa: E402
from lodestone.operators.search import knn_join, mean_recall  # noqa: E402

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count()))


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    more: dict[str, float] = {}

    def timed(name: str, f):
        began = time.perf_counter()
        out = f()
        took[name] = round(time.perf_counter() - began, 3)
        return out

    def run(df):
        df.write.format("noop").mode("overwrite").save()

    run(q.QUERIES["knn_euclidean"](spark, SF))  # starts the workers' side
    run(q.QUERIES["knn_join_euclidean"](spark, SF))
    base, held = (df.cache() for df in q.held_out(spark, SF))
    n = held.count()
    base.count()
    truth = knn_join(base, held, 10).cache()
    timed("knn_exact_k10", lambda: truth.count())
    timed("knn_exact_k100", lambda: run(knn_join(base, held, 100)))
    timed("knn_lineitem", lambda: run(q.QUERIES["knn_lineitem"](spark, SF)))
    timed("kmeans_3_rounds", lambda: run(q.QUERIES["kmeans_3_rounds"](spark, SF)))
    timed("rp_split_depth2", lambda: run(q.QUERIES["rp_split_depth2"](spark, SF)))
    per_task = -(-base.count() // int(CPUS))
    for name, config in (("forest", Forest(50, 32)), ("voronoi", CellTree(10, 128)), ("hnsw", Graph(16, ef=100))):
        # One partition for each core: every partition's index is built and searched by a task of its own.
        index = VectorIndex.fit(base, config, 64, partition_rows=per_task).persist()
        timed(f"{name}_build", lambda index=index: index.rows.count())
        found = timed(f"{name}_search", lambda index=index: index.search(held, 10).cache())
        timed(f"{name}_search", lambda found=found: found.count())
        more[f"{name}_recall10"] = round(mean_recall(found, truth).first()[0], 4)
        more[f"{name}_scanned"] = round(found.agg(F.avg("scanned")).first()[0] / base.count(), 4)
        more[f"{name}_qps"] = round(n / took[f"{name}_search"], 1)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF, **more}))


if __name__ == "__main__":
    main()
