from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from ledgerbeam.operators.rollup import check_categories


@dataclass(frozen=True)
class DashboardParams:
    """What the dashboard shows. Category lists are in output order.

    Expenses are compared by month number, as on the original page: a month of all years
    together, and nothing for the month before January. With ``calendar_months`` they are
    those of the month of ``as_of`` and of the calendar month before it.
    """

    income_parent: str
    cash_categories: tuple[str, ...]
    expense_categories: tuple[str, ...]
    fiscal_year: str
    prior_fiscal_year: str
    as_of: date | None = None  # None: the day on which the query runs
    party_type: str = "Customer"
    voucher_type: str = "Payment Entry"
    top_k: int = 5
    paid_status: str = "paid"
    income_root: str = "Income"
    expense_root: str = "Expense"
    calendar_months: bool = False

    def __post_init__(self) -> None:
        check_categories(self.cash_categories)
        check_categories(self.expense_categories)


# The chart of accounts and the years of the original dashboard.
RUPIAH_2020 = DashboardParams(
    income_parent="4100.000 - Penjualan Barang Dagangan - RE",
    cash_categories=(
        "1111.000 - Kas Rupiah - RE",
        "1113.000 - Investasi Jangka Pendek - RE",
        "1121.000 - Bank Rupiah - RE",
    ),
    expense_categories=(
        "5110.000 - Beban Penjualan - RE",
        "5120.000 - Biaya Gaji & Kesejahteraan Pegawai - RE",
        "5130.000 - Biaya Kantor & Gudang - RE",
        "5210.000 - Biaya Gaji & Kesejahteraan Pegawai Indirect - RE",
        "5220.000 - Biaya Operational Indirect - RE",
        "5230.000 - Biaya Kantor Indirect - RE",
        "5310.000 - Biaya Penyusutan - RE",
        "5410.000 - Biaya Amortisasi - RE",
        "5510.000 - Beban Lain lain - RE",
    ),
    fiscal_year="2020",
    prior_fiscal_year="2019",
)
