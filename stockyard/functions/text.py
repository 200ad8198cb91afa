"""Text and key expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the blanks that are cut off both ends of a key.
BLANKS = " \t\n\r\x0b\x0c"


def strip(text: Column) -> Column:
    """Text without blanks at either end."""
    return F.btrim(text, F.lit(BLANKS))


def first_token(code: Column) -> Column:
    """The code before the first comma of a cell that may hold several."""
    return strip(F.split_part(code, F.lit(","), F.lit(1)))


def integer_text(code: Column) -> Column:
    """A numeric code as integer text: 100.0 becomes 100. Bad text gives null.

    Works in DECIMAL, so that codes longer than 15 digits keep every digit.
    """
    number = code.cast("string").try_cast("decimal(38,6)")
    whole = F.when(number < 0, F.ceil(number)).otherwise(F.floor(number))
    return whole.cast("decimal(38,0)").cast("string")


def slug(name: Column) -> Column:
    """Lower-case name with blanks turned into hyphens."""
    return F.lower(F.replace(name, F.lit(" "), F.lit("-")))
