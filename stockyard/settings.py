"""Parameters of the import flows. Every flow takes one of these objects."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from decimal import Decimal
from types import MappingProxyType

# Rows per batch, and the item code range of the supplier flow.
BATCH_ROWS = 1000
ITEM_CODE_DIGITS = 6

# Categories whose items carry VAT in the category flow.
VAT_CATEGORIES = (
    "BABY TOOLS VAT",
    "COSMETICS BEAUTY CARE VAT",
    "COSMOTHERAPEUTICS VAT",
    "DEVICES WITH VAT",
    "MECICAL USE ITEMS VAT",
    "SUPPLEMENTS AND HERBALS VAT",
    "TOOLS WITH VAT",
)
VAT_RATE = Decimal("0.15")

# Defaults written over missing cells.
DEFAULT_BATCH_NUMBER = "AAA"
DEFAULT_ITEM_NAME = "empty product"

# No ids reserved: every table goes on after its largest stored id.
NO_IDS: Mapping[str, int] = MappingProxyType({})

# Tax codes given to newly registered products.
STANDARD_TAX_RATE = 1
PRICED_TAX_RATE = 5


@dataclass(frozen=True)
class Warehouse:
    id: int
    code: str
    name: str


@dataclass(frozen=True)
class Posting:
    """Who buys, where the stock lands and where it is moved to."""

    source: Warehouse
    destination: Warehouse
    supplier_id: int = 686
    supplier_name: str = "Internal Supplier"
    reference_no: str = "123456"
    invoice_number: str = "PR-123456"
    sequence_code: str = "INV-123456"
    transfer_sequence_code: str = "TR-123456"
    transfer_invoice_number: str = "TR-INV-123456"
    note: str = "import from excel"
    created_by: int = 9
    batch_rows: int = BATCH_ROWS
    # Column that becomes an item's real unit cost.
    real_cost_column: str = "item_purchase_price"


STANDARD = Posting(
    source=Warehouse(32, "2000", "Source warehouse"),
    destination=Warehouse(42, "2009", "Destination pharmacy"),
)
SUPPLIER = Posting(
    source=Warehouse(32, "2000", "Source warehouse"),
    destination=Warehouse(32, "2000", "Source warehouse"),
)
CATEGORY = Posting(
    source=Warehouse(32, "2000", "Source warehouse"),
    destination=Warehouse(38, "2005", "Destination pharmacy"),
    supplier_id=786,
    supplier_name="Internal supplier",
    real_cost_column="item_cost_price",
)


@dataclass(frozen=True)
class SupplierDefaults:
    """Constants of a newly registered supplier; its level is left open."""

    group_id: int = 4
    group_name: str = "supplier"
    company: str = "Main company"
    level: int | None = None


@dataclass(frozen=True)
class CategoryRule:
    """Which categories carry VAT, and at what rate."""

    categories: tuple[str, ...] = VAT_CATEGORIES
    rate: Decimal = field(default=VAT_RATE)
