"""Expiry dates.

Cells hold ISO dates as a rule. Other cells are reduced to a shape, in which a run of
letters is ``a``, four digits are ``Y`` and one or two digits ``9``; a table says for each
shape which of its numbers are year, month and day. So a row is parsed once, whatever
the number of forms. A date with slashes or hyphens is read month first, and day first only
where the first number is no month. A month without a day is its first day; of two-digit
years, those from 69 on belong to the century before.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks of a month that is a name: three letters, or these and whole names as well.
SHORT_NAME, NAME = "short", "name"


@dataclass(frozen=True)
class Form:
    """Which number of a cell, from 0, is what.

    ``month`` may be a name, ``day`` none for the first. ``either`` takes month and day the
    other way round where the first is no month.
    """

    year: int
    month: int | str
    day: int | None
    either: bool = False


# Accepted forms beside ISO, the names of months, and the range of
# nanosecond timestamps.
FORMS = {
    "9/9/Y": Form(2, 0, 1, either=True),
    "9-9-Y": Form(2, 0, 1, either=True),
    "9.9.Y": Form(2, 1, 0),
    "Y/9/9": Form(0, 1, 2),
    "Y.9.9": Form(0, 1, 2),
    "9 a Y": Form(1, NAME, 0),
    "9-a-Y": Form(1, SHORT_NAME, 0),
    "9/a/Y": Form(1, SHORT_NAME, 0),
    "a 9, Y": Form(1, NAME, 0),
    "a 9 Y": Form(1, NAME, 0),
    "a Y": Form(0, NAME, None),
    "a-Y": Form(0, SHORT_NAME, None),
    "9/Y": Form(1, 0, None),
    "9-Y": Form(1, 0, None),
    "9/9/9": Form(2, 0, 1, either=True),
    "9-9-9": Form(2, 0, 1, either=True),
    "9.9.9": Form(2, 1, 0),
    "9-a-9": Form(1, SHORT_NAME, 0),
    "9 a 9": Form(1, SHORT_NAME, 0),
}
# Year, month and day without a mark between them.
COMPACT = "YY"
MONTHS = (
    "january february march april may june july august september october november december"
).split()
FIRST_SHORT_YEAR = 69
FIRST_DAY = "1677-09-22"
LAST_DAY = "2262-04-11"
LAST_YEAR = 2262

_ISO = r"^\d{4}-\d{1,2}-\d{1,2}$"
# Years of more digits are none that a cell means.
_YEAR_FIRST = r"^\s*\d{4}(?!\d)"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


def shape(text: Column) -> Column:
    """Letters, four digits and up to two digits as one mark each; the rest as it stands."""
    letters = F.regexp_replace(text, "[A-Za-z]+", "a")
    return F.regexp_replace(F.regexp_replace(letters, "[0-9]{4}", "Y"), "[0-9]{1,2}", "9")


def _by_shape(form: Column, choose: Callable[[Form], Column | None]) -> Column:
    """What ``choose`` makes of the form of a shape, one branch for equal choices."""
    groups: dict[str, tuple[list[str], Column]] = {}
    for name, one in FORMS.items():
        made = choose(one)
        if made is not None:
            groups.setdefault(str(made), ([], made))[0].append(name)
    return F.coalesce(*[F.when(form.isin(names), made) for names, made in groups.values()])


def _canonical(text: Column) -> Column:
    """A cell of an accepted form as ``y-m-d``, else null."""

    def spelled(cell: Column) -> Column:
        form, numbers, word = cell["shape"], cell["numbers"], cell["word"]

        def number(at: int) -> Column:
            return F.get(numbers, at)

        def year(one: Form) -> Column:
            return number(one.year)

        def month(one: Form) -> Column:
            if one.month == SHORT_NAME:
                return _position(word, [m[:3] for m in MONTHS])
            if one.month == NAME:
                return F.coalesce(*[_position(word, names) for names in ([m[:3] for m in MONTHS], MONTHS)])
            first, second = number(one.month), number(one.day) if one.either else None
            return F.when(first.cast("int") > 12, second).otherwise(first) if one.either else first

        def day(one: Form) -> Column:
            if one.day is None:
                return F.lit("1")
            first, second = number(one.month) if one.either else None, number(one.day)
            return F.when(first.cast("int") > 12, first).otherwise(second) if one.either else second

        found = _by_shape(form, year)
        # Years have two or four digits; of two digits, the century is to be told.
        early = F.when(found.cast("int") >= FIRST_SHORT_YEAR, "19").otherwise("20")
        full = F.when(F.length(found) == 4, found).when(F.length(found) == 2, F.concat(early, found))
        return F.when(
            form == COMPACT, F.concat_ws("-", *[F.substring(text, a, n) for a, n in ((1, 4), (5, 2), (7, 2))])
        ).when(form.isin(list(FORMS)), F.concat(full, F.lit("-"), _by_shape(form, month), F.lit("-"), _by_shape(form, day)))

    parts = F.struct(
        shape(text).alias("shape"),
        F.regexp_extract_all(text, F.lit("([0-9]+)")).alias("numbers"),
        F.lower(F.regexp_extract(text, "[A-Za-z]+", 0)).alias("word"),
    )
    return _let(parts, spelled)


def _position(word: Column, names: list[str]) -> Column:
    """The place of a word among names, from 1, as text; null where it is none of them."""
    at = F.array_position(F.array(*[F.lit(n) for n in names]), word)
    return F.when(at > 0, at.cast("string"))


def lenient_date(text: Column) -> Column:
    """Text as a date in any accepted form; null where none fits."""
    iso = F.when(text.rlike(_YEAR_FIRST), text.try_cast("timestamp_ntz").cast("date"))
    return F.coalesce(iso, _canonical(text).try_cast("date"))


def strict_expiry(text: Column) -> Column:
    """An ISO date of any year, else a lenient date within nanosecond range."""
    iso = F.when(text.rlike(_ISO), text.try_cast("date"))
    first, last = F.lit(FIRST_DAY).cast("date"), F.lit(LAST_DAY).cast("date")
    in_range = _let(lenient_date(text), lambda day: F.when(day.between(first, last), day))
    return F.coalesce(iso, in_range)


def clamped_expiry(text: Column) -> Column:
    """A lenient date with its year held to 2262; null where that day does not exist."""

    def held(day: Column) -> Column:
        moved = F.concat(F.lit(str(LAST_YEAR)), F.date_format(day, "-MM-dd")).try_cast("date")
        return F.when(F.year(day) > LAST_YEAR, moved).otherwise(day)

    return _let(lenient_date(text), held)
