"""Column expressions shared by all analyses. Every one is a built-in JVM expression."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data model.
DELIVERED = "delivered"
CANCELED = "canceled"
ON_TIME = "On Time"
LATE = "Late"

# Wide enough for sums over 10^12 rows; a quotient of two such values still has
# at least 12 decimals, so that rounding it to 2 or 4 digits is exact.
_NUMERATOR = "decimal(26,4)"
_DENOMINATOR = "decimal(22,2)"


ColumnOrName = Column | str


def _column(value: ColumnOrName) -> Column:
    return F.col(value) if isinstance(value, str) else value


def is_delivered() -> Column:
    return F.col("order_status") == DELIVERED


def is_late() -> Column:
    return F.col("order_delivered_customer_date") > F.col("order_estimated_delivery_date")


def delivery_status(missing_is_late: bool) -> Column:
    """On Time / Late. A missing estimate is Late in the reporting mart and a
    null group in the delivery analyses."""
    on_time = F.col("order_delivered_customer_date") <= F.col("order_estimated_delivery_date")
    status = F.when(on_time, ON_TIME)
    return status.otherwise(LATE) if missing_is_late else status.when(is_late(), LATE)


def wide(column: ColumnOrName) -> Column:
    """A count as an exact decimal, safe to multiply by another sum."""
    return _column(column).cast("decimal(20,0)")


def cents_sum(name: str) -> Column:
    """Sum of a two-decimal amount in whole cents, each rounded, so that amounts stored as doubles count right.

    Long addition is several times cheaper in a hash aggregate than decimal
    addition. A group may reach 9e16 units of money, beyond which it raises: use
    it for grains such as order, person, product or seller, and ``money_total``
    or ``F.sum`` for the few groups of a report.
    """
    return F.sum(F.round(F.col(name) * 100).cast("long"))


def money(cents: ColumnOrName) -> Column:
    """Whole cents as an exact amount with two decimals."""
    return wide(cents) * F.lit(Decimal("0.01"))


def money_total(cents: ColumnOrName) -> Column:
    """Sum of cents over any number of rows as an amount."""
    return F.sum(wide(cents)) * F.lit(Decimal("0.01"))


def money_sum(name: str) -> Column:
    return money(cents_sum(name))


def ratio(numerator: ColumnOrName, denominator: ColumnOrName, digits: int = 2) -> Column:
    """Exact decimal quotient, rounded half away from zero; null when dividing by zero."""
    quotient = F.try_divide(_column(numerator).cast(_NUMERATOR), _column(denominator).cast(_DENOMINATOR))
    return F.round(quotient, digits)


def pct(part: ColumnOrName, whole: ColumnOrName, digits: int = 2) -> Column:
    return ratio(_column(part) * 100, whole, digits)


def mean(column: ColumnOrName, digits: int = 2) -> Column:
    """Average from an exact sum and a count, so rounding happens once."""
    return ratio(F.sum(column), F.count(column), digits)


def count_when(condition: Column) -> Column:
    return F.count_if(condition)


def month_start(column: ColumnOrName) -> Column:
    return F.trunc(column, "MM")


def months_between_starts(later: Column, earlier: Column) -> Column:
    """Whole months between two first-of-month dates."""
    return (F.year(later) - F.year(earlier)) * 12 + (F.month(later) - F.month(earlier))


def full_days(start: ColumnOrName, end: ColumnOrName) -> Column:
    """Elapsed full 24-hour days, truncated towards zero."""
    return F.date_part(F.lit("DAY"), _column(end) - _column(start)).cast("long")


def calendar_days(start: ColumnOrName, end: ColumnOrName) -> Column:
    """Difference of the calendar dates, whatever the time of day."""
    return F.datediff(end, start)


def blank_to_null(column: ColumnOrName) -> Column:
    """The trimmed text, null if nothing is left. By length, so that text under a collation keeps it."""
    trimmed = F.trim(column)
    return F.when(F.length(trimmed) > 0, trimmed)


def strip_all(column: ColumnOrName) -> Column:
    """Strip every Unicode white space at both ends (``trim`` takes spaces only)."""
    return F.regexp_replace(column, r"(?U)^\s+|\s+$", "")
