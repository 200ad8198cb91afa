"""Purchases, transfers, their items and stock movements.

Headers are plain aggregates, combined on the map side, so a batch or supplier of
any size never has to sit in one task.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockyard.functions.numbers import CENTS, MONEY, money
from stockyard.operators.ordinals import next_id
from stockyard.settings import Posting
from stockyard.staging import stage

# Header and item columns that every flow posts as zero or empty, by type.
HEADER_ZEROS = {
    "old_total_net_purchase": MONEY,
    "product_discount": CENTS,
    "order_discount": MONEY,
    "total_discount": MONEY,
    "product_tax": MONEY,
    "order_tax_id": T.IntegerType(),
    "order_tax": MONEY,
    "shipping": CENTS,
    "paid": MONEY,
    "purchase_invoice": T.IntegerType(),
    "is_transfer": T.IntegerType(),
    "transfer_id": T.IntegerType(),
    "location_to": T.IntegerType(),
    "transfer_by": T.IntegerType(),
}
ITEM_ZEROS = {
    "item_discount": MONEY,
    "discount1": MONEY,
    "discount2": CENTS,
    "second_discount_value": MONEY,
    "bonus": CENTS,
}
ITEM_BLANKS = ("discount", "serial_number", "warehouse_shelf")

# Movement types, the sign of their quantity and the end they happen at.
PURCHASE_MOVE = ("purchase", 1, "source")
TRANSFER_MOVES = (("transfer_out", -1, "source"), ("transfer_in", 1, "destination"))

_SUMS = {
    "total": "item_total_cost_price",
    "total_sale": "item_total_sale_price",
    "total_after_vat": "item_total_after_vat",
    "total_items": "item_quantity",
    "total_tax": "item_total_vat",
    "transfer_tax": "total_sale_vat",
}


def _total(column: str) -> Column:
    return money(F.sum(column))


def _sums() -> list[Column]:
    """Header sums, and the transfer total, which is stored in two places."""
    totals = [_total(source).alias(name) for name, source in _SUMS.items()]
    return [*totals, F.sum("total_sale").cast(CENTS).alias("transfer_total")]


def _moment(run_time: datetime) -> Column:
    return F.lit(run_time)


def batch_totals(items: DataFrame, group: str = "batch_id") -> DataFrame:
    """The sums that purchase and transfer headers of a batch are made of.

    Items that are dropped later for a bad expiry still count in the sums; they are
    reported beside them.
    """
    counts = [
        F.count(F.lit(1)).alias("items_read"),
        F.count_if(~F.col("expiry_ok")).alias("items_dropped"),
    ]
    return items.groupBy(group).agg(*_sums(), *counts)


def _header_constants(headers: DataFrame, posting: Posting, run_time: datetime) -> DataFrame:
    return headers.withColumns(
        {
            "reference_no": F.lit(posting.reference_no),
            "date": _moment(run_time),
            "warehouse_id": F.lit(posting.source.id),
            "note": F.lit(posting.note),
            "total_net_purchase": F.col("total"),
            **{name: F.lit(0).cast(kind) for name, kind in HEADER_ZEROS.items()},
            "order_discount_id": F.lit(""),
            "status": F.lit("received"),
            "created_by": F.lit(posting.created_by),
            "invoice_number": F.lit(posting.invoice_number),
            "sequence_code": F.lit(posting.sequence_code),
        }
    )


def purchases_per_batch(totals: DataFrame, posting: Posting, run_time: datetime) -> DataFrame:
    """One purchase per batch; the grand total is the cost with VAT."""
    headers = totals.withColumns(
        {
            "grand_total": F.col("total_after_vat"),
            "supplier_id": F.lit(posting.supplier_id).cast("bigint"),
            "supplier": F.lit(posting.supplier_name),
        }
    )
    return _header_constants(headers, posting, run_time)


def category_totals(
    items: DataFrame, suppliers: DataFrame, posting: Posting, group: str = "batch_id"
) -> DataFrame:
    """Batch sums of the category flow, with the supplier of the batch's last row.

    Only the supplier's id goes through the aggregate, whose fixed-width buffer keeps it
    a hash aggregate; its name is joined to the headers afterwards.
    """
    known_id = F.when(F.col("supplier_known"), F.col("supplier_id"))
    totals = items.groupBy(group).agg(
        *_sums(),
        F.count(F.lit(1)).alias("items_read"),
        F.count_if(~F.col("expiry_ok")).alias("items_dropped"),
        F.max_by(known_id, "ord").alias("supplier_id"),
    )
    names = suppliers.select(F.col("id").alias("supplier_id"), F.col("name").alias("supplier"))
    default_id = F.lit(posting.supplier_id).cast("bigint")
    return totals.join(names, "supplier_id", "left").withColumns(
        {
            "supplier_id": F.coalesce("supplier_id", default_id),
            "supplier": F.coalesce("supplier", F.lit(posting.supplier_name)),
        }
    )


def purchases_category(totals: DataFrame, posting: Posting, run_time: datetime) -> DataFrame:
    """One purchase per batch of the category flow; the grand total is the sale total."""
    return _header_constants(
        totals.withColumn("grand_total", F.col("total_sale")), posting, run_time
    )


def purchases_per_supplier(
    items: DataFrame,
    posting: Posting,
    run_time: datetime,
    order: list[str],
    within: tuple[str, ...] = (),
) -> DataFrame:
    """One purchase per supplier id, named as in its first row; null ids post nothing.

    A sum of which every part is missing is 0.

    Rows are first summed per id and name. Over a numeric ``order`` column that is a hash
    aggregate; finding the first name among the few of a supplier then needs no sort of
    the feed.
    """
    position = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    sums = {
        "total": "item_total_cost_price",
        "total_sale": "item_total_sale_price",
        "total_tax": "item_total_vat",
        "grand_total": "item_total_after_vat",
    }
    per_name = (
        items.filter(F.col("supplier_id").isNotNull())
        .groupBy(*within, "supplier_id", "supplier_name")
        .agg(
            F.min(position).alias("_first"),
            *[F.coalesce(F.sum(source), F.lit(0)).alias(name) for name, source in sums.items()],
            F.sum(F.coalesce(F.col("total_sale"), F.lit(0))).alias("transfer_total"),
            F.count(F.lit(1)).alias("items_read"),
        )
    )
    headers = per_name.groupBy(*within, "supplier_id").agg(
        F.min_by("supplier_name", "_first").alias("supplier"),
        *[_total(name).alias(name) for name in sums],
        F.sum("transfer_total").cast(CENTS).alias("transfer_total"),
        F.sum("items_read").alias("items_read"),
    )
    return _header_constants(headers, posting, run_time)


def transfers(totals: DataFrame, posting: Posting, run_time: datetime) -> DataFrame:
    """One transfer per batch from the source to the destination warehouse."""
    return totals.select(
        "batch_id",
        F.lit(posting.reference_no).alias("transfer_no"),
        _moment(run_time).alias("date"),
        F.lit(posting.source.id).alias("from_warehouse_id"),
        F.lit(posting.source.code).alias("from_warehouse_code"),
        F.lit(posting.source.name).alias("from_warehouse_name"),
        F.lit(posting.destination.id).alias("to_warehouse_id"),
        F.lit(posting.destination.code).alias("to_warehouse_code"),
        F.lit(posting.destination.name).alias("to_warehouse_name"),
        F.lit(posting.note).alias("note"),
        F.lit("").alias("attachment"),
        F.col("total_sale").alias("total"),
        F.col("total").alias("total_cost"),
        F.col("transfer_tax").alias("total_tax"),
        F.col("transfer_total").alias("grand_total"),
        F.lit("purchase").alias("type"),
        F.lit("completed").alias("status"),
        F.lit(posting.transfer_sequence_code).alias("sequence_code"),
        F.lit(posting.created_by).alias("created_by"),
        F.lit(posting.transfer_invoice_number).alias("invoice_number"),
    )


def purchase_orders(
    purchases: DataFrame,
    stored_purchases: DataFrame,
    stored_orders: DataFrame,
    first_purchase: int | None = None,
    first_order: int | None = None,
) -> DataFrame:
    """A pending order for each purchase, with an id of its own and a link to it."""
    shift = next_id(stored_orders, first_order) - next_id(stored_purchases, first_purchase)
    return purchases.withColumns(
        {"purchase_id": F.col("id"), "id": F.col("id") + shift, "status": F.lit("pending")}
    )


def with_order_ids(items: DataFrame, orders: DataFrame) -> DataFrame:
    """Attaches purchase and order id to the rows of each supplier.

    The links, one per supplier, are staged, so that their size is known before the rows are
    moved: small ones are sent to the rows instead.
    """
    links = stage(orders.select("supplier_id", F.col("id").alias("order_id"), "purchase_id"), "order-links")
    return items.join(links, "supplier_id")


def item_sources(posting: Posting, *more: str | Column) -> list[str | Column]:
    """The columns of a row that its items and movements are made of, without ids.

    A row is reduced to them before it is looked up, so that no others are shuffled. ``more``
    has what a flow needs beside them to work out the other totals again.
    """
    columns = [
        "ord", "item_code", "item_name", "item_quantity", "item_cost_price", posting.real_cost_column,
        "item_sale_price", "expiry", "item_batch_number", "item_total_cost_price", "item_total_sale_price",
    ]
    return [*dict.fromkeys(columns), *more]


def _item_columns(posting: Posting, run_time: datetime) -> dict[str, Column]:
    quantity = money(F.col("item_quantity"))
    return {
        "product_id": F.col("product_id"),
        "product_code": F.col("item_code"),
        "product_name": F.col("item_name"),
        "net_unit_cost": money(F.col("item_cost_price")),
        "quantity": quantity,
        "actual_quantity": quantity,
        "expiry": F.col("expiry"),
        "unit_cost": money(F.col("item_cost_price")),
        "real_unit_cost": money(F.col(posting.real_cost_column)),
        "sale_price": money(F.col("item_sale_price")),
        "date": F.lit(run_time.date()),
        "unit_quantity": quantity,
        "quantity_balance": quantity,
        "quantity_received": quantity,
        "option_id": F.lit(None).cast("int"),
        "batchno": F.col("item_batch_number"),
        "avz_item_code": F.col("avz_item_code"),
        **{name: F.lit(0).cast(kind) for name, kind in ITEM_ZEROS.items()},
        **{name: F.lit("") for name in ITEM_BLANKS},
    }


def purchase_items(
    rows: DataFrame, posting: Posting, run_time: datetime, keep: tuple[str, ...] = ()
) -> DataFrame:
    """The purchase item of each feed row, at the source warehouse and at cost."""
    own = {
        "warehouse_id": F.lit(posting.source.id),
        "item_tax": money(F.col("item_total_vat")),
        "subtotal": money(F.col("item_total_cost_price")),
        "totalbeforevat": money(F.col("item_total_cost_price")),
        "main_net": money(F.col("item_total_after_vat")),
        "total_sale": money(F.col("total_sale")),
        "status": F.lit("received"),
    }
    columns = {**_item_columns(posting, run_time), **own}
    return rows.select(*keep, *[c.alias(name) for name, c in columns.items()])


def transfer_items(
    rows: DataFrame, posting: Posting, run_time: datetime, keep: tuple[str, ...] = ()
) -> DataFrame:
    """The transfer item of each feed row, at the destination and at sale price."""
    own = {
        "warehouse_id": F.lit(posting.destination.id),
        "item_tax": money(F.col("total_sale_vat")),
        "subtotal": money(F.col("total_sale")),
        "totalbeforevat": money(F.col("item_total_sale_price")),
        "main_net": money(F.col("total_sale")),
        "total_sale": money(F.col("total_sale")),
        "status": F.lit("completed"),
    }
    columns = {**_item_columns(posting, run_time), **own}
    return rows.select(*keep, *[c.alias(name) for name, c in columns.items()])


def movements(
    rows: DataFrame,
    posting: Posting,
    run_time: datetime,
    with_transfer: bool = True,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Stock movements of each posted row: one explode, not one scan per movement type.

    ``rows`` carries ``purchase_id`` and, where transfers are posted, ``transfer_id``.
    """
    places = {"source": posting.source.id, "destination": posting.destination.id}
    moves = [PURCHASE_MOVE, *(TRANSFER_MOVES if with_transfer else ())]

    def move(kind: str, sign: int, end: str) -> Column:
        owner = "purchase_id" if kind == "purchase" else "transfer_id"
        return F.struct(
            F.lit(kind).alias("type"),
            (money(F.col("item_quantity")) * F.lit(sign)).cast("decimal(25,5)").alias("quantity"),
            F.lit(places[end]).alias("location_id"),
            F.col(owner).alias("reference_id"),
        )

    fanned = rows.withColumn("_move", F.explode(F.array(*[move(*m) for m in moves])))
    return fanned.select(
        *keep,
        "product_id",
        F.col("item_batch_number").alias("batch_number"),
        _moment(run_time).alias("movement_date"),
        "_move.*",
        money(F.col("item_cost_price")).alias("net_unit_cost"),
        F.col("expiry").alias("expiry_date"),
        money(F.col("item_sale_price")).alias("net_unit_sale"),
        money(F.col(posting.real_cost_column)).alias("real_unit_cost"),
        money(F.col("item_sale_price")).alias("real_unit_sale"),
        "avz_item_code",
        F.lit(0).alias("bonus"),
        F.lit(0).alias("customer_id"),
    )


def discount_total(rows: DataFrame, group: str = "supplier_id") -> DataFrame:
    """Sum of the backed-out discounts of a purchase."""
    known = rows.filter(F.col(group).isNotNull())
    return known.groupBy(group).agg(
        money(F.sum(money(F.col("discount_value")))).alias("total_discount")
    )
