"""Times headline queries over the whole tables and prints one JSON line.

BENCH_SF_DIR names the folder of tables, BENCH_CPUS the number of local cores. Every
query is run once, to a sink that takes all rows. Staging the ordered feed is timed on
its own, as ``stage_feed``, after one untimed staging that warms the JVM up; the queries
that follow read what it wrote.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from stockyard.registry import load
from stockyard.registry.core import Tables, forget_staged

HEADLINE = [
    "purchase_per_supplier",
    "purchase_order_copy",
    "purchase_per_batch",
    "purchase_category_flow",
    "transfer_per_batch",
    "purchase_report",
    "report_grand_total",
    "item_projection",
    "transfer_item_projection",
    "movement_fanout",
    "batch_accept",
    "upsert_last_in_first_batch",
    "register_products_priced",
    "register_products_category",
    "register_subcategories",
    "dedupe_keep_first",
    "compare_existing",
    "product_id_lookup",
    "supplier_or_default",
    "image_update",
    "discount_update",
    "price_update",
    "product_report",
    "import_counters",
    "category_vat",
    "line_totals",
    "standard_import",
    "supplier_import",
    "category_import",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("stock posting bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", os.environ.get("BENCH_SCRATCH") or tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()

    def timed(build) -> float:
        start = time.perf_counter()
        frame = build()
        if frame is not None:
            frame.write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    timed(lambda: Tables(spark, folder).ordered)
    forget_staged()
    seconds = {"stage_feed": timed(lambda: Tables(spark, folder).ordered)}
    for name in HEADLINE:
        seconds[name] = timed(lambda: queries[name](spark, folder))
    result = {
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
