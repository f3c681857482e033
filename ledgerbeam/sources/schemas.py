from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)


# Columns that the stored layout adds: the month that files are dealt by, and the status as
# it is compared.
STORED = {
    "gl_entry": T.StructType([T.StructField("posting_month", T.IntegerType())]),
    "sales_invoice": T.StructType([T.StructField("status_key", T.StringType())]),
    "purchase_invoice": T.StructType([T.StructField("status_key", T.StringType())]),
}


def table_schemas(money: T.DecimalType = MONEY) -> dict[str, T.StructType]:
    """Schema of each input table, with amounts of the given decimal type."""

    def struct(**columns: T.DataType) -> T.StructType:
        return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])

    text, day = T.StringType(), T.DateType()
    return {
        "sales_invoice": struct(posting_date=day, total=money, status=text),
        "purchase_invoice": struct(posting_date=day, total=money, status=text),
        "gl_entry": struct(
            account=text,
            posting_date=day,
            debit=money,
            credit=money,
            fiscal_year=text,
            party=text,
            party_type=text,
            voucher_type=text,
        ),
        "account": struct(name=text, parent_account=text, root_type=text),
        "employee": struct(name=text, date_of_joining=day),
    }


# Integer digits that any value of a whole-number type may have.
_WHOLE_DIGITS = {T.ByteType(): 3, T.ShortType(): 5, T.IntegerType(): 10, T.LongType(): 19}


def _as_money(name: str, found: T.DataType, money: T.DecimalType, exact_floats: bool) -> Column:
    """The column as ``money``, or a refusal if any of its values might change."""
    column = F.col(name)
    room = money.precision - money.scale
    if isinstance(found, T.DecimalType):
        if found.scale > money.scale:
            raise ValueError(
                f"{name} is {found.simpleString()}: pass a money type with "
                f"{found.scale} decimal places, so that no digits are rounded away"
            )
        digits = found.precision - found.scale
    elif isinstance(found, T.FloatType | T.DoubleType) and exact_floats:
        as_money = column.cast("double").try_cast(money)
        same = as_money.cast("double") == column.cast("double")
        lost = F.raise_error(
            F.concat(F.lit(f"{name} is not exactly a {money.simpleString()}: "), column.cast("string"))
        )
        return F.when(column.isNull() | same, as_money).otherwise(lost.cast(money))
    else:
        digits = _WHOLE_DIGITS.get(found)
    if digits is None:
        raise ValueError(
            f"{name} is {found.simpleString()}: give amounts as decimals, or pass "
            "exact_floats=True to take floating-point amounts that decimals hold exactly"
        )
    if digits > room:
        raise ValueError(
            f"{name} is {found.simpleString()}: pass a money type with {digits} integer "
            f"digits; {money.simpleString()} has room for {room}"
        )
    return column.cast(money)


def conform(
    df: DataFrame,
    schema: T.StructType,
    exact_floats: bool = False,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Keep the columns of ``schema`` and give them its types; ``keep`` names others that
    stay as they are where ``df`` has them.

    Columns that already have the type are passed on bare, so filters on them still
    reach the scan. No amount is rounded or lost, in ANSI mode or not: types that could
    not be held in full are refused. With ``exact_floats`` floating-point amounts are
    taken, and the first value that is not the floating-point form of a decimal of the
    wanted type stops the query. Dates are taken from dates and timestamps only.
    """
    columns = []
    for field in schema:
        found = df.schema[field.name].dataType
        if found == field.dataType:
            columns.append(F.col(field.name))
        elif isinstance(field.dataType, T.DecimalType):
            columns.append(
                _as_money(field.name, found, field.dataType, exact_floats).alias(field.name)
            )
        elif isinstance(field.dataType, T.DateType) and not isinstance(
            found, T.TimestampType | T.TimestampNTZType
        ):
            raise ValueError(f"{field.name} is {found.simpleString()}, not a date or timestamp")
        else:
            columns.append(F.col(field.name).cast(field.dataType).alias(field.name))
    return df.select(*columns, *(c for c in keep if c in df.columns))
