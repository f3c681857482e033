"""Column expressions shared by the operators. All of them stay inside Catalyst."""

from ledgerbeam.functions.columns import (
    DAY_LABEL_FORMAT,
    as_of_date,
    day_label,
    in_calendar_month,
    in_month_of_year,
    money_scale,
    month_number,
    net_amount,
    net_of_sums,
    same_text,
    stored_name,
    text_key,
)

__all__ = [
    "DAY_LABEL_FORMAT",
    "as_of_date",
    "day_label",
    "in_calendar_month",
    "in_month_of_year",
    "money_scale",
    "month_number",
    "net_amount",
    "net_of_sums",
    "same_text",
    "stored_name",
    "text_key",
]
