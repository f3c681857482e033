"""The dashboard's operators: DataFrames in, one DataFrame out.

Sums stay exact decimals, and every grouping sums before it shuffles. With a chart of
accounts that fits a broadcast, operators are lazy, none moves ledger rows, and a hot key
costs no more than any other. Beyond the broadcast limit an operator runs one job over the
account table when it first meets a selection of accounts, to measure it. Selections that
are too large are shuffled: against one row per account, or, for sums per day, against the
entries themselves, where adaptive execution splits hot accounts.
"""

from ledgerbeam.operators.balances import (
    account_balance,
    account_balance_calendar_month,
    account_balance_month,
)
from ledgerbeam.operators.daily import account_daily_credit, daily_count, daily_total, ledger_daily
from ledgerbeam.operators.parties import top_parties
from ledgerbeam.operators.pruned import top_parties_pruned
from ledgerbeam.operators.rollup import category_frame, category_rollup
from ledgerbeam.operators.totals import income_vs_expense, root_type_totals

__all__ = [
    "account_balance",
    "account_balance_calendar_month",
    "account_balance_month",
    "account_daily_credit",
    "category_frame",
    "category_rollup",
    "daily_count",
    "daily_total",
    "income_vs_expense",
    "ledger_daily",
    "root_type_totals",
    "top_parties",
    "top_parties_pruned",
]
