"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The stores are derived and written before the clock starts (their seconds are given apart as "stores"), as the operators
work on a store that is there. The first query runs once before, so that the session is warm."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
QUERIES = ["export", "posting_bytes", "term_dictionary_bytes", "shared_apportionment", "owner_cost", "folder_rollup", "treemap_rows", "path_trie_sums", "values_topk"]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", str(int(CPUS) * 2)).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tallyspark.plans import fixtures
    from tallyspark.plans.queries import QUERIES as known

    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(QUERIES)).split(",") if n in known]

    def seconds(run) -> float:
        start = time.time()
        run()
        return round(time.time() - start, 2)

    def query(name: str):
        return lambda: known[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()

    stores = {f.__name__: seconds(lambda f=f: f(spark, SF_DIR)) for f in (fixtures.orders_store, fixtures.texts_store)}
    query(names[0])()
    took = {n: seconds(query(n)) for n in names}
    print(json.dumps({"metric": "index accounting, total", "value": round(sum(took.values()), 2), "unit": "sec", "queries": took, "stores": stores, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
