"""Whole imports over the feed as it stands, with their rules on, compared row by row."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockyard.functions.measures import with_line_totals
from stockyard.operators import cleaning
from stockyard.plans.category import GROUPED_NUMBERS, category_import
from stockyard.plans.discounted import discounted_import
from stockyard.plans.standard import standard_import
from stockyard.plans.supplier import supplier_import
from stockyard.registry.core import CATEGORIES, RUN_TIME, Tables, amount, query
from stockyard.registry.imports import _last_id
from stockyard.registry.scans import as_text, write_csv
from stockyard.settings import NO_IDS, STANDARD
from stockyard.sources import layouts
from stockyard.sources.delimited import scan_positional
from stockyard.sources.store import STEP_LOG, read_runs
from stockyard.staging import Scratch, inside, new_folder
from stockyard.streaming.file_drop import import_runs

# Small batches, so that the feed has both good and bad ones.
_ROWS = 20
_MONEY = "decimal(25,5)"


def _rows(table: DataFrame, kind: str, name, number, total, **more) -> DataFrame:
    """Rows of one posted table in the shape that all are compared in; amounts by name."""
    amounts = {"total": total, **more}
    return table.select(
        F.lit(kind).alias("kind"), name.cast("string").alias("name"), number.cast("bigint").alias("number"),
        *[(F.lit(None) if c is None else F.col(c)).cast(_MONEY).alias(n) for n, c in amounts.items()],
    )


def _posted(tables: dict[str, DataFrame], log_name: str = "status") -> DataFrame:
    items = _rows(tables["purchase_items"], "item", F.col("product_code"), F.col("ord"), "subtotal")
    out = _rows(tables["quarantine"], "left out", F.col("left_out_as"), F.col("ord"), None)
    log = _rows(tables["run_log"], "log", F.col(log_name), F.col("batch_id"), "rows_posted")
    return reduce(DataFrame.union, [items, out, log])


@query(
    "standard_import_rules",
    f"""WITH judged AS (
      SELECT *, ord // {_ROWS} AS b,
        BOOL_OR(item_code IS NULL OR item_sale_price IS NULL) OVER (PARTITION BY ord // {_ROWS}) AS refused
      FROM posted)
    SELECT 'item' AS kind, item_code AS name, ord AS number, {amount("item_total_cost_price", "total")}
      FROM judged WHERE NOT refused AND expiry_ok
    UNION ALL SELECT 'left out', CASE WHEN refused THEN 'batch refused' ELSE 'no date' END, ord, NULL
      FROM judged WHERE refused OR NOT expiry_ok
    UNION ALL SELECT 'log', CASE WHEN refused THEN 'failed' ELSE 'completed' END, b,
      {amount("CASE WHEN refused THEN 0 ELSE COUNT(*) END", "total")} FROM judged GROUP BY b, refused
    UNION ALL SELECT 'header', 'standard', 501 + b, {amount("SUM(item_total_after_vat)", "total")}
      FROM judged WHERE NOT refused GROUP BY b
    UNION ALL SELECT 'movement', item_code, ord, {amount("SUM(item_quantity * sign)", "total")}
      FROM judged, (VALUES (1), (-1), (1)) AS moves(sign) WHERE NOT refused AND expiry_ok
      GROUP BY item_code, ord""",
)
def standard_import_rules(t: Tables) -> DataFrame:
    """A batch with a missing code or price is refused; every row is posted or left out."""
    feed = with_line_totals(t.ordered).drop("total_sale", "total_sale_vat")
    tables = standard_import(
        feed.withColumn("item_ascon_code", F.col("item_batch_number")), t.view("catalogue"),
        _last_id(t, 500), _last_id(t, 500), RUN_TIME, replace(STANDARD, batch_rows=_ROWS),
    )
    headers = _rows(tables["purchases"], "header", F.lit("standard"), F.col("id"), "grand_total")
    codes = tables["purchase_items"].select("ord", "product_code")
    moves = tables["inventory_movements"].groupBy("ord").agg(F.sum("quantity").alias("moved"))
    moved = _rows(moves.join(codes, "ord"), "movement", F.col("product_code"), F.col("ord"), "moved")
    return reduce(DataFrame.union, [_posted(tables), headers, moved])


# Suppliers of every third id keep their missing prices, and are refused for them.
_PRICED = """priced AS (
      SELECT *, CASE WHEN supplier_id % 3 = 0 THEN item_sale_price ELSE COALESCE(item_sale_price, 0) END AS sale
      FROM posted),
    verdicts AS (
      SELECT supplier_id, COUNT(*) AS n, COUNT(*) - COUNT(sale) AS bad FROM priced
      WHERE item_code IS NOT NULL AND supplier_id IS NOT NULL GROUP BY supplier_id),
    judged AS (
      SELECT p.*, bad, CASE WHEN item_code IS NULL THEN 'no code' WHEN p.supplier_id IS NULL THEN 'no supplier'
        WHEN bad > 0 THEN 'supplier refused' END AS fault
      FROM priced p LEFT JOIN verdicts v ON p.supplier_id = v.supplier_id)"""


def _priced(t: Tables) -> DataFrame:
    whole = F.coalesce(F.col("item_sale_price"), F.lit(0).cast("decimal(14,4)"))
    sale = F.when(F.col("supplier_id") % 3 == 0, F.col("item_sale_price")).otherwise(whole)
    return t.ordered.withColumn("item_sale_price", sale)


@query(
    "supplier_import_rules",
    f"""WITH {_PRICED}
    SELECT 'item' AS kind, item_code AS name, ord AS number, {amount("item_total_cost_price", "total")}
      FROM judged WHERE fault IS NULL
    UNION ALL SELECT 'left out', fault, ord, NULL FROM judged WHERE fault IS NOT NULL
    UNION ALL SELECT 'log', CASE WHEN bad = 0 THEN 'completed' ELSE 'failed' END, supplier_id,
      {amount("CASE WHEN bad = 0 THEN n ELSE 0 END", "total")} FROM verdicts""",
)
def supplier_import_rules(t: Tables) -> DataFrame:
    """A supplier with an item without a price is refused; every row is posted or left out."""
    tables = supplier_import(
        _priced(t), t.view("catalogue"), _last_id(t, 1000), _last_id(t, 2000), RUN_TIME, code_digits=12
    )
    return _posted(tables)


_VALUE = """CASE WHEN item_discount > 0
        THEN CAST(item_cost_price AS DOUBLE) / (1 - CAST(item_discount AS DOUBLE))
             - CAST(item_cost_price AS DOUBLE) ELSE 0 END"""


@query(
    "discounted_import",
    f"""WITH {_PRICED},
    bought AS (SELECT *, CAST({_VALUE} AS DECIMAL(25,5)) AS value FROM judged WHERE fault IS NULL),
    last AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY item_code ORDER BY ord DESC) AS place
      FROM bought WHERE expiry_ok) x WHERE place = 1),
    known AS (SELECT code, cost, cost AS price FROM catalogue
      UNION ALL SELECT DISTINCT item_code, NULL, NULL FROM feed
      WHERE item_code IS NOT NULL AND item_code NOT IN (SELECT code FROM catalogue))
    SELECT 'item' AS kind, item_code AS name, ord AS number,
      {amount("item_cost_price * item_quantity * vat_value", "total")}, {amount("value", "discount")}
      FROM bought WHERE expiry_ok
    UNION ALL SELECT 'left out', COALESCE(fault, 'no date'), ord, NULL, NULL FROM judged
      WHERE fault IS NOT NULL OR NOT expiry_ok
    UNION ALL SELECT 'header', CAST(supplier_id AS VARCHAR), COUNT(*),
      {amount("SUM(item_total_cost_price + item_cost_price * vat_value * CAST(0.01 AS DECIMAL(3,2)))", "total")},
      {amount("SUM(value)", "discount")} FROM bought GROUP BY supplier_id
    UNION ALL SELECT 'price', code, NULL,
      {amount("CASE WHEN l.item_code IS NULL THEN k.cost ELSE l.item_cost_price END", "total")},
      {amount("CASE WHEN l.item_code IS NULL THEN k.price ELSE l.sale END", "discount")}
      FROM known k LEFT JOIN last l ON k.code = l.item_code""",
)
def discounted(t: Tables) -> DataFrame:
    """Unit VAT, discounts worked back, and the prices that the catalogue takes over."""
    prices = {c: F.col("cost").cast(_MONEY) for c in ("cost", "price")}
    tables = discounted_import(
        _priced(t), t.view("catalogue").withColumns(prices), _last_id(t, 1000), _last_id(t, 2000),
        RUN_TIME, code_digits=12,
    )
    return reduce(DataFrame.union, [
        _rows(tables["purchase_items"], "item", F.col("product_code"), F.col("ord"), "item_tax", discount="item_discount"),
        _rows(tables["quarantine"], "left out", F.col("left_out_as"), F.col("ord"), None, discount=None),
        _rows(tables["purchases"], "header", F.col("supplier_id"), F.col("items_read"), "grand_total", discount="total_discount"),
        _rows(tables["catalogue"], "price", F.col("code"), F.lit(None), "cost", discount="price"),
    ])


def _broken(name) -> F.Column:
    """A name over two lines, as workbooks and quoted cells hold them."""
    return F.concat(name, F.lit("\n(two lines)"))


_LAYOUTS = {"standard": layouts.STANDARD, "category": layouts.CATEGORY, "barcode": layouts.BARCODE}


@query(
    "scan_layouts",
    """SELECT layout, ord, item_code, item_name || CHR(10) || '(two lines)' AS item_name,
    item_batch_number, item_expiry_date, CAST(item_cost_price AS VARCHAR) AS item_cost_price
    FROM ordered, (VALUES ('standard'), ('category'), ('barcode')) AS l(layout)""",
)
def scan_layouts(t: Tables) -> DataFrame:
    """The feed as files of three layouts, with line breaks in cells, read back in order."""
    columns = ["item_code", "item_name", "item_batch_number", "item_expiry_date", "item_cost_price"]
    parts = []
    for name, layout in _LAYOUTS.items():
        rows = t.laid_out(lambda rows: rows.orderBy("ord")).withColumn("item_name", _broken(F.col("item_name")))
        cells = [F.col(c).cast("string") if c in columns else F.lit("x").alias(c) for c in layout]
        folder = write_csv(rows.select(cells), name, compression="gzip")
        read = scan_positional(t.spark, folder, layout, ordinal=True, multiline=True)
        parts.append(read.select(F.lit(name).alias("layout"), "ord", *columns))
    return reduce(DataFrame.unionByName, parts)


@query(
    "file_drop_imports",
    f"""SELECT 'items' AS kind, item_code AS name, COUNT(*) AS number, {amount("SUM(item_total_cost_price)", "total")}
      FROM posted WHERE item_code IS NOT NULL AND expiry_ok GROUP BY item_code
    UNION ALL SELECT 'movements', item_code, 3 * COUNT(*), {amount("SUM(item_quantity)", "total")}
      FROM posted WHERE item_code IS NOT NULL AND expiry_ok GROUP BY item_code
    UNION ALL SELECT 'product', item_code, 1, NULL FROM posted
      WHERE item_code IS NOT NULL AND item_code NOT IN (SELECT code FROM catalogue) GROUP BY item_code
    UNION ALL SELECT 'step', 'purchase_items', COUNT(*), NULL FROM posted
      WHERE item_code IS NOT NULL AND expiry_ok""",
)
def file_drop_imports(t: Tables) -> DataFrame:
    """The feed dropped as files of the standard layout, imported as whole flows.

    Several triggers are runs of one store. A code that two of them bring is registered by
    the first; items and movements are those of the whole feed, and so are the rows that
    the step log counted.
    """
    dealt = t.laid_out(lambda rows: rows.repartition(6, "ord"))
    rows = with_line_totals(cleaning.drop_null_key(cleaning.fill_price_zero(dealt)))
    rows = rows.withColumns({
        "item_ascon_code": F.col("item_batch_number"), "item_total_purchase_price": F.lit(None).cast("string"),
    })
    folder = write_csv(as_text(rows, layouts.STANDARD), "standard-drops")
    root, known = new_folder(t.spark, "store"), t.view("catalogue").select("id", "code")

    def stored(name: str, columns: list[str]) -> DataFrame:
        try:
            return read_runs(t.spark, root, name).select(columns)
        except LookupError:
            return known.limit(0).select(columns)

    def post(feed: DataFrame, run_id: str):
        products = known.unionByName(stored("products", ["id", "code"]))
        tables = standard_import(
            layouts.typed(feed), products, stored("purchases", ["id"]), stored("transfers", ["id"]), RUN_TIME
        )
        return {k: v for k, v in tables.items() if k != "report"}, NO_IDS

    import_runs(t.spark, folder, layouts.STANDARD, post, root, new_folder(t.spark, "stream"), files_per_trigger=3)
    items = read_runs(t.spark, root, "purchase_items").select("run_id", "ord", "product_code", "subtotal")
    counted = F.count(F.lit(1)).alias("number")
    moves = read_runs(t.spark, root, "inventory_movements").join(items, ["run_id", "ord"])
    return reduce(DataFrame.union, [
        items.groupBy(F.lit("items").alias("kind"), F.col("product_code").alias("name")).agg(
            counted, F.sum("subtotal").cast(_MONEY).alias("total")),
        moves.groupBy(F.lit("movements"), "product_code").agg(counted, F.sum("quantity").cast(_MONEY)),
        read_runs(t.spark, root, "products").groupBy(F.lit("product"), "code").agg(counted, F.lit(None).cast(_MONEY)),
        read_runs(t.spark, root, STEP_LOG).where("step = 'purchase_items'").groupBy(F.lit("step"), "step").agg(
            F.sum("rows"), F.lit(None).cast(_MONEY)),
    ])


_BARCODE_COLUMNS = {"supplier": "supplier_name", "item_total_cost_price": "item_total_cost_text"}


@query(
    "barcode_import",
    f"""SELECT 1 + batch_id AS id, ARG_MAX(found_id, ord) AS supplier_id, COUNT(*) AS items_read,
    {amount("SUM(item_total_cost_price)", "total")}, {amount("SUM(item_total_vat)", "total_tax")},
    {amount("SUM(item_total_sale_price)", "grand_total")}
    FROM category_lines GROUP BY batch_id""",
)
def barcode_import(t: Tables) -> DataFrame:
    """The feed as a file of the eighteen-column layout, posted by the category flow.

    The file and its cells go once they are parsed.
    """
    rows = t.laid_out(lambda rows: rows.orderBy("ord"))
    rows = cleaning.fill_price_zero(rows, ["item_sale_price"])
    sale = F.col("item_sale_price") * F.col("item_quantity")
    rows = rows.withColumns({"item_total_sale_price": sale, "item_code": F.col("raw_code")})
    given = {c: F.col(_BARCODE_COLUMNS.get(c, c)) for c in layouts.BARCODE if _BARCODE_COLUMNS.get(c, c) in rows.columns}
    cells = [given.get(c, F.lit(None)).cast("string").alias(c) for c in layouts.BARCODE]
    scratch = Scratch(t.spark, "barcode")
    with inside(scratch):
        folder = write_csv(rows.select(cells), "barcode", compression="gzip")
        read = scan_positional(t.spark, folder, layouts.BARCODE, ordinal=True)
    none = t.table("region").select(F.lit(0).cast("bigint").alias("id"))
    feed = layouts.typed(layouts.as_category(read), keep_text=GROUPED_NUMBERS)
    tables = category_import(
        feed, t.view("catalogue"), t.view("known_suppliers"), t.view("known_groups"), none, none,
        RUN_TIME, rule=CATEGORIES, parsed=scratch.release,
    )
    return tables["purchases"].select("id", "supplier_id", "items_read", "total", "total_tax", "grand_total")
