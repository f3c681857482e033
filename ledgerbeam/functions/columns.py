from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: dates are published as 31/12/2020.
DAY_LABEL_FORMAT = "dd/MM/yyyy"


def net_amount() -> Column:
    """Debit less credit of one ledger row; NULL when either side is NULL."""
    return F.col("debit") - F.col("credit")


def money_scale(ledger: DataFrame) -> int:
    """Decimal places of the ledger's amounts."""
    return ledger.schema["debit"].dataType.scale


def net_of_sums(ledger: DataFrame, where: Column | None = None) -> Column:
    """Total debit less total credit, over the rows that meet ``where``.

    Unlike ``sum(net_amount())`` this keeps the known side of a row whose other side is
    NULL. One digit is left free for the subtraction: two 38-digit operands would make
    Spark drop decimal places beyond the sixth.
    """
    total = T.DecimalType(37, money_scale(ledger))

    def side(column: str) -> Column:
        amount = F.col(column) if where is None else F.when(where, F.col(column))
        return F.sum(amount).cast(total)

    return side("debit") - side("credit")


def text_key(column: str) -> Column:
    """Text as it is compared when case and trailing spaces do not count."""
    return F.lower(F.rtrim(F.col(column)))


def same_text(column: str, text: str, table: DataFrame | None = None) -> Column:
    """Equality that ignores case and trailing spaces, for hand-typed status values.

    If ``table`` stores the column's key, that is compared: a plain equality, which
    reaches the scan."""
    wanted = text.rstrip(" ").lower()
    stored = stored_name(column)
    if table is not None and stored in table.columns:
        return F.col(stored) == wanted
    return text_key(column) == wanted


# Columns that the stored layout adds to a table, by the column that they are made of.
_STORED_NAMES = {"status": "status_key", "posting_date": "posting_month"}


def stored_name(column: str) -> str | None:
    return _STORED_NAMES.get(column)


def month_number(column: str, table: DataFrame | None = None) -> Column:
    """The month of a date; the stored one, if ``table`` has it, so that files are skipped."""
    stored = stored_name(column)
    if table is not None and stored in table.columns:
        return F.col(stored)
    return F.month(column)


def as_of_date(as_of: date | None) -> Column:
    """The given day, or the day on which the query runs."""
    return F.current_date() if as_of is None else F.lit(as_of)


def in_month_of_year(
    column: str, as_of: date | None, offset: int = 0, table: DataFrame | None = None
) -> Column:
    """Month number equals that of ``as_of`` plus ``offset``, in any year.

    The number does not wrap: one month before January is 0 and matches nothing. Give the
    ``table`` that is filtered, and a month that it stores is used.
    """
    return month_number(column, table) == F.month(as_of_date(as_of)) + offset


def in_calendar_month(
    column: str, as_of: date | None, offset: int = 0, table: DataFrame | None = None
) -> Column:
    """Within the calendar month that lies ``offset`` months from ``as_of``.

    A plain range on the bare column, so Parquet can skip row groups with it, and with a
    month that ``table`` stores, so that Spark skips files.
    """
    first = F.add_months(F.trunc(as_of_date(as_of), "MM"), offset)
    day = F.col(column)
    inside = (day >= first) & (day < F.add_months(first, 1))
    if table is not None and stored_name(column) in table.columns:
        inside = inside & (month_number(column, table) == F.month(first))
    return inside


def day_label(column: str) -> Column:
    return F.date_format(column, DAY_LABEL_FORMAT)
