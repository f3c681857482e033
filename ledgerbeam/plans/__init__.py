"""The dashboard as a whole: its parameters and its combined plan."""

from ledgerbeam.plans.dashboard import as_lists, dashboard_series, ledger_base
from ledgerbeam.plans.params import RUPIAH_2020, DashboardParams
from ledgerbeam.plans.publish import published

__all__ = [
    "RUPIAH_2020",
    "DashboardParams",
    "as_lists",
    "dashboard_series",
    "ledger_base",
    "published",
]
