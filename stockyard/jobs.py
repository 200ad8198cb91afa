"""Imports as spark-submit jobs.

    spark-submit stockyard/jobs.py standard --feed in/ --catalogue products/ \\
        --store store/ --run-id 42

The store holds one folder per table and one partition per run, read once the run is
committed. A run that is repeated takes the place of its earlier attempt; ids given to
other runs, finished or not, are never used again. ``--catalogue`` names a parquet table, the products
of a store, or a catalogue written by the image and discount jobs, whose latest version counts.
"""

from __future__ import annotations

import argparse
import os
import sys
from datetime import datetime

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

from stockyard.functions import numbers  # noqa: E402
from stockyard.operators.cleaning import without_numeric_key  # noqa: E402
from stockyard.plans import catalogue, category, standard, supplier  # noqa: E402
from stockyard.operators import updates  # noqa: E402
from stockyard.shipping import ship_package  # noqa: E402
from stockyard.sources import buckets, feeds, layouts, store  # noqa: E402
from stockyard.sources.delimited import drop_promoted_header  # noqa: E402
from stockyard.sources.manifest import Manifest, reserve_ids  # noqa: E402
from stockyard.streaming.file_drop import import_runs  # noqa: E402

_PRODUCTS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("code", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("cost", numbers.MONEY),
        T.StructField("price", numbers.MONEY),
    ]
)
_SUPPLIERS = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("name", T.StringType())]
)
_CATEGORIES = T.StructType([*_SUPPLIERS.fields, T.StructField("parent_id", T.LongType())])
_WATCH = "watch-"
_IDS = T.StructType([T.StructField("id", T.LongType())])


def read_feed(spark: SparkSession, path: str, layout: tuple[str, ...], multiline: bool = False) -> DataFrame:
    """A feed of CSV files and workbooks as text cells with ``ord``, staged for its readers."""
    return feeds.read_positional(spark, path, layout, multiline=multiline)


def stored(
    spark: SparkSession, root: str, name: str, schema: T.StructType, run_id: str
) -> DataFrame:
    """A stored table without the rows of this run; empty where it does not exist yet."""
    try:
        table = store.read_runs(spark, root, name)
    except store.NotStoredError:
        return spark.createDataFrame([], schema)
    return table.filter(F.col("run_id") != run_id).select(*schema.names)


def read_catalogue(spark: SparkSession, paths: list[str], run_id: str) -> DataFrame:
    """Products of one or several parquet tables, without those of this run; empty where
    none is named."""
    found = [store.read_table(spark, p) for p in paths] or [spark.createDataFrame([], _PRODUCTS)]
    whole = None
    for table in found:
        if "run_id" in table.columns:
            table = table.filter(F.col("run_id") != run_id).drop("run_id")
        whole = table if whole is None else whole.unionByName(table, allowMissingColumns=True)
    return whole


LAYOUTS = {
    "standard": layouts.STANDARD,
    "supplier": layouts.SUPPLIER,
    "category-metadata": layouts.CATEGORY,
    "category": layouts.CATEGORY,
    "barcode": layouts.BARCODE,
    "priced-products": layouts.SUPPLIER,
}
# Tables whose ids a job hands out, and how many it may need for a row of its feed.
ID_TABLES = {
    "standard": {"products": 1, "purchases": 1, "transfers": 1},
    "supplier": {"products": 1, "purchases": 1, "purchase_orders": 1},
    "category-metadata": {"suppliers": 1, "categories": 2},
    "category": {"products": 1, "purchases": 1, "transfers": 1},
    "barcode": {"products": 1, "purchases": 1, "transfers": 1},
    "priced-products": {"products": 1},
}
REPORTS = ("report", "counters", "comparison", "not-found", "left-out")


def post_feed(
    spark: SparkSession, args: argparse.Namespace, job: str, run_id: str, feed: DataFrame, products: DataFrame
) -> tuple[dict[str, DataFrame], dict[str, int]]:
    """The tables and reports of one flow over a feed of text cells with ``ord``, and the
    first ids that were reserved for the run before."""
    at = datetime.fromisoformat(args.at)
    ids = reserve(spark, args.store, job, run_id, feed, products)
    return _posted(spark, args, job, run_id, feed, products, at, ids), ids


def reserve(
    spark: SparkSession, root: str, job: str, run_id: str, feed: DataFrame, products: DataFrame
) -> dict[str, int]:
    """Reserves a range of ids in each table that the job adds to, so that runs that start
    from the same state post under ids of their own."""
    rows = feed.count()
    known = {}
    for name in ID_TABLES[job]:
        sources = [stored(spark, root, name, _IDS, run_id), *([products] if name == "products" else [])]
        known[name] = max(s.agg(F.max("id")).first()[0] or 0 for s in sources)
    wanted = {name: rows * many for name, many in ID_TABLES[job].items()}
    return reserve_ids(Manifest(spark, root), run_id, wanted, known)


def _posted(
    spark: SparkSession, args: argparse.Namespace, job: str, run_id: str, feed: DataFrame,
    products: DataFrame, at: datetime, ids: dict[str, int],
) -> dict[str, DataFrame]:

    def table(name: str, schema: T.StructType = _IDS) -> DataFrame:
        return stored(spark, args.store, name, schema, run_id)

    if job == "standard":
        return standard.standard_import(
            layouts.typed(feed), products, table("purchases"), table("transfers"), at, ids=ids
        )
    if job == "supplier":
        return supplier.supplier_import(
            layouts.typed(feed), products, table("purchases"), table("purchase_orders"), at,
            code_digits=args.code_digits, used_codes=args.used_codes, ids=ids,
        )
    if job == "category-metadata":
        return category.category_metadata(
            feed, table("suppliers", _SUPPLIERS), table("categories", _CATEGORIES), ids=ids
        )
    if job in ("category", "barcode"):
        feed = layouts.as_category(feed)
        return category.category_import(
            layouts.typed(feed, keep_text=category.GROUPED_NUMBERS), products,
            table("suppliers", _SUPPLIERS), table("categories", _CATEGORIES),
            table("purchases"), table("transfers"), at, ids=ids,
        )
    return catalogue.register_priced_products(
        layouts.typed(feed), products, list(layouts.SUPPLIER), at, ids=ids
    )


def watch(spark: SparkSession, args: argparse.Namespace, job: str) -> None:
    """One flow over the files that were dropped since the last time, a run per trigger.

    Products that earlier drops registered are known to later ones.
    """

    def post(feed: DataFrame, run_id: str) -> tuple[dict[str, DataFrame], dict[str, int]]:
        own = stored(spark, args.store, "products", T.StructType(_PRODUCTS.fields[:2]), run_id)
        known = read_catalogue(spark, args.catalogue, run_id).unionByName(own, allowMissingColumns=True)
        posted, ids = post_feed(spark, args, job, run_id, feed, known)
        for name in REPORTS:
            if name in posted:
                store.write_report(posted.pop(name), f"{args.store}/reports/{name}-{run_id}")
        return posted, ids

    import_runs(
        spark, args.feed, LAYOUTS[job], post, args.store, f"{args.store}/drops-{job}",
        job=f"{job}-drop", multiline=args.multiline,
    )


def write_catalogue(spark: SparkSession, args: argparse.Namespace, sheet: DataFrame, updated: DataFrame) -> None:
    """Writes the updated catalogue to the store, in buckets of the code.

    Where the catalogue of the store is what was updated, only the buckets that the sheet
    touches are written again.
    """
    own = f"{args.store}/catalogue"
    if [p.rstrip("/") for p in args.catalogue] != [own] or not buckets.is_bucketed(spark, own):
        buckets.write_buckets(updated, own, args.run_id, "code", args.buckets)
    elif args.job == "images":
        rows = updates.image_rows(sheet).withColumnRenamed("product_code", "code")
        buckets.update_buckets(
            spark, own, args.run_id, rows, "code", lambda part: updates.update_images(part, sheet)
        )
    else:
        rows = updates.discount_rows(sheet).filter(~F.col("in_error"))
        buckets.update_buckets(
            spark, own, args.run_id, rows, "id", lambda part: updates.update_discounts(part, sheet)
        )


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    """Run one job and write what it posts."""
    ship_package(spark)
    if args.job.startswith(_WATCH):
        return watch(spark, args, args.job.removeprefix(_WATCH))
    products = read_catalogue(spark, args.catalogue, args.run_id)
    ids = {}
    if args.job == "images":
        sheet = feeds.read_named(spark, args.feed)
        posted = catalogue.apply_images(products, sheet)
        posted["not-found"] = updates.images_not_found(products, sheet)
    elif args.job == "discounts":
        sheet = drop_promoted_header(read_feed(spark, args.feed, layouts.DISCOUNT, args.multiline))
        posted = catalogue.apply_discounts(products, sheet)
        posted["not-found"] = updates.discounts_not_found(products, sheet)
        posted["left-out"] = without_numeric_key(sheet, "item_no")
    else:
        feed = read_feed(spark, args.feed, LAYOUTS[args.job], args.multiline)
        posted, ids = post_feed(spark, args, args.job, args.run_id, feed, products)

    for name in REPORTS:
        if name in posted:
            store.write_report(posted.pop(name), f"{args.store}/reports/{name}-{args.run_id}")
    if args.job in ("images", "discounts"):
        write_catalogue(spark, args, sheet, posted["products"])
    else:
        store.append_run(posted, args.store, args.run_id, ids)


def parser() -> argparse.ArgumentParser:
    result = argparse.ArgumentParser(description=__doc__)
    result.add_argument(
        "job",
        choices=[
            "standard", "supplier", "category-metadata", "category", "barcode", "priced-products",
            "images", "discounts", "watch-standard", "watch-supplier", "watch-category",
        ],
    )
    result.add_argument("--feed", required=True)
    result.add_argument("--store", required=True)
    result.add_argument("--run-id", help="of every job that does not watch a folder")
    result.add_argument("--catalogue", action="append", default=[])
    result.add_argument("--at", default=datetime.now().isoformat(timespec="seconds"))
    result.add_argument("--code-digits", type=int, default=6)
    result.add_argument("--used-codes", type=int, default=0)
    result.add_argument("--buckets", type=int, default=buckets.BUCKETS, help="of a catalogue")
    result.add_argument("--multiline", action="store_true", help="quoted cells hold line breaks")
    return result


def parsed(words: list[str] | None = None) -> argparse.Namespace:
    args = parser().parse_args(words)
    if args.run_id is None and not args.job.startswith(_WATCH):
        parser().error("--run-id is missing")
    return args


if __name__ == "__main__":
    session = SparkSession.builder.appName("stock posting").getOrCreate()
    run(session, parsed())
    session.stop()
