"""Golden values of the column functions."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from stockyard.functions import dates, measures, numbers, text
from stockyard.operators.ordinals import with_item_code
from stockyard.settings import CategoryRule


def evaluate(spark, function, values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(function(F.col("x"))).collect()]


@pytest.mark.parametrize(
    "cell, expected",
    [
        (None, None),
        ("2027-03-01", date(2027, 3, 1)),
        ("2027-3-1", date(2027, 3, 1)),
        ("2027-03-01 00:00:00", date(2027, 3, 1)),
        ("2999-12-31", date(2999, 12, 31)),
        ("2999-12-31 00:00:00", None),
        ("2262-04-12 00:00:00", None),
        ("12/31/2027", date(2027, 12, 31)),
        ("31/12/2027", date(2027, 12, 31)),
        ("5 Mar 2027", date(2027, 3, 5)),
        ("2027-02-30", None),
        ("n/a", None),
        ("soon", None),
    ],
)
def test_strict_expiry(spark, cell, expected):
    assert evaluate(spark, dates.strict_expiry, [cell]) == [expected]


@pytest.mark.parametrize(
    "cell, expected",
    [
        (None, None),
        ("2027-03-01", date(2027, 3, 1)),
        ("2999-12-31", date(2262, 12, 31)),
        ("2999-12-31 00:00:00", date(2262, 12, 31)),
        ("2262-12-31", date(2262, 12, 31)),
        ("2400-02-29", None),
        ("n/a", None),
    ],
)
def test_clamped_expiry(spark, cell, expected):
    assert evaluate(spark, dates.clamped_expiry, [cell]) == [expected]


FORMS = {
    "3/31/2024": (2024, 3, 31), "31/3/2024": (2024, 3, 31), "4/3/2024": (2024, 4, 3), "3-31-2024": (2024, 3, 31),
    "31-3-2024": (2024, 3, 31), "2024/3/31": (2024, 3, 31), "31 Mar 2024": (2024, 3, 31), "31-mar-2024": (2024, 3, 31),
    "MAR 31, 2024": (2024, 3, 31), "31 March 2024": (2024, 3, 31), "March 31, 2024": (2024, 3, 31),
    "Mar 2024": (2024, 3, 1), "March 2024": (2024, 3, 1), "Mar-2024": (2024, 3, 1), "3/2024": (2024, 3, 1),
    "03-2024": (2024, 3, 1), "20240331": (2024, 3, 31), "31.3.2024": (2024, 3, 31), "2024.03.31": (2024, 3, 31),
    "31/Mar/2024": (2024, 3, 31), "Mar 31 2024": (2024, 3, 31), "March 31 2024": (2024, 3, 31), "May 2024": (2024, 5, 1),
    "3/31/24": (2024, 3, 31), "31/3/24": (2024, 3, 31), "3-31-68": (2068, 3, 31), "31-3-69": (1969, 3, 31),
    "31.3.99": (1999, 3, 31), "31-Mar-24": (2024, 3, 31), "31 Mar 24": (2024, 3, 31),
    "13/13/2024": None, "30/2/2024": None, "2/30/2024": None, "31-March-2024": None, "Sept 2024": None, "1/2/3": None,
    "2024": (2024, 1, 1), "202403": None, "x 31 Mar 2024": None, " 3/31/2024": None, "": None, "31/31": None,
}


def test_every_form_of_a_date(spark):
    expected = [None if d is None else date(*d) for d in FORMS.values()]
    assert evaluate(spark, dates.lenient_date, list(FORMS)) == expected


def test_shuffled_codes_are_all_codes(spark):
    rows = spark.range(900_000).withColumnRenamed("id", "ord")
    code = F.col("avz_item_code").cast("int")
    found = with_item_code(rows, digits=6, secret=77).agg(
        F.count_distinct(code), F.min(code), F.max(code), F.corr("ord", code)
    ).first()
    assert tuple(found)[:3] == (900_000, 100_000, 999_999) and abs(found[3]) < 0.01
    few = with_item_code(rows.limit(100), digits=6, secret=77, used=899_950)
    with pytest.raises(Exception, match="all item codes"):
        few.collect()
    first, again, other = (
        [r.avz_item_code for r in with_item_code(rows.limit(50), digits=18, secret=s).orderBy("ord").collect()]
        for s in (5, 5, 6)
    )
    assert first == again != other and all(len(c) == 18 for c in first) and sorted(first) != first


def test_integer_text(spark):
    cells = ["100.0", "7.9", "-7.9", "6291041500213", "12345678901234567890", "1e3", "abc", "", None]
    expected = ["100", "7", "-7", "6291041500213", "12345678901234567890", "1000", None, None, None]
    assert evaluate(spark, text.integer_text, cells) == expected


def test_first_token_and_slug(spark):
    assert evaluate(spark, text.first_token, [" 12 ,34", "5", "\t6\n", None]) == ["12", "5", "6", None]
    assert evaluate(spark, text.slug, ["Hair Care  Oil", None]) == ["hair-care--oil", None]


def test_grouped_numbers(spark):
    cells = ["1,234.50", "1,234,567", "9", " 3 ", "n/a", None]
    found = evaluate(spark, numbers.parse_grouped, cells)
    assert found == [Decimal("1234.5"), Decimal(1234567), Decimal(9), Decimal(3), None, None]


def test_bad_grouped_number_refuses_the_file(spark):
    with pytest.raises(Exception, match="not a number: n/a"):
        evaluate(spark, numbers.parse_grouped_or_fail, ["1", "n/a"])


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(1.5,), (float("nan"),), (None,)], "x double")
    assert [r[0] for r in numbers.nan_to_null(df).collect()] == [1.5, None, None]


def test_discount_of_one_has_no_price_before(spark):
    df = spark.createDataFrame(
        [(90.0, 0.1), (50.0, 0.0), (50.0, 1.0)], "item_cost_price double, item_discount double"
    )
    found = measures.with_discount_backout(df).collect()
    assert found[0].price_before_discount == pytest.approx(100.0)
    assert found[0].discount_percentage == pytest.approx(10.0)
    assert (found[1].price_before_discount, found[1].discount_value) == (50.0, 0.0)
    assert found[1].discount_percentage is None
    assert found[2].price_before_discount is None and found[2].discount_value is None


def test_category_vat_with_the_default_list(spark):
    df = spark.createDataFrame(
        [("TOOLS WITH VAT", Decimal(100), Decimal(200)), (None, Decimal(100), Decimal(200))],
        "category string, item_total_cost_price decimal(18,6), item_total_sale_price decimal(18,6)",
    )
    taxed, plain = measures.with_category_vat(df, CategoryRule()).collect()
    assert (taxed.item_total_vat, taxed.item_total_after_vat) == (15, 115)
    assert (taxed.total_sale_vat, taxed.total_sale) == (30, 230)
    assert (plain.item_total_vat, plain.item_total_after_vat) == (0, 100)
    assert (plain.total_sale_vat, plain.total_sale) == (0, 200)
