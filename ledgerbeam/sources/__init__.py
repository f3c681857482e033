"""The five input tables: their schemas, readers, and the stored layout."""

from ledgerbeam.sources.books import (
    Books,
    books_from_erp,
    books_from_sql,
    open_books,
    rewrite_months,
    write_books,
)
from ledgerbeam.sources.by_account import open_books_by_account, write_books_by_account
from ledgerbeam.sources.chart import BROADCAST_LIMIT_BYTES, ChartOfAccounts, DuplicateAccounts
from ledgerbeam.sources.compact import compact_ledger, compacted, refresh, with_compact_ledger
from ledgerbeam.sources.splits import SPLIT_TABLES, SplitTable, date_splits
from ledgerbeam.sources.star import books_from_star

__all__ = [
    "BROADCAST_LIMIT_BYTES",
    "Books",
    "ChartOfAccounts",
    "DuplicateAccounts",
    "SPLIT_TABLES",
    "SplitTable",
    "books_from_erp",
    "books_from_sql",
    "books_from_star",
    "compact_ledger",
    "compacted",
    "date_splits",
    "open_books",
    "open_books_by_account",
    "refresh",
    "rewrite_months",
    "with_compact_ledger",
    "write_books",
    "write_books_by_account",
]
