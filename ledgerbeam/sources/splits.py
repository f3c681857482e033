"""Disjoint conditions that let a table of an SQL source be read by many tasks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A day with more than this part of a split's share beside it is cut by a second column.
_FULL = 1.5


@dataclass(frozen=True)
class SplitTable:
    """How a table can be cut: by ranges of its date, and crowded days by its key."""

    date_column: str
    key_column: str


# The ERP's large tables with their posting date and primary key.
SPLIT_TABLES = {
    "sales_invoice": SplitTable("posting_date", "name"),
    "purchase_invoice": SplitTable("posting_date", "name"),
    "gl_entry": SplitTable("posting_date", "name"),
}


def day_counts_sql(table: str, split: SplitTable) -> str:
    """A query, as a table expression, for the source itself to count its rows per day."""
    day = split.date_column
    return f"(SELECT {day} AS day, COUNT(*) AS n FROM {table} GROUP BY {day}) days"


def _key_parts(split: SplitTable, parts: int) -> list[str]:
    """Conditions of which each key, a missing one too, meets exactly one."""
    number = f"MOD(CRC32({split.key_column}), {parts})"
    first = f"({number} = 0 OR {split.key_column} IS NULL)"
    return [first, *(f"{number} = {i}" for i in range(1, parts))]


def date_splits(days: list[tuple[date | None, int]], split: SplitTable, splits: int) -> list[str]:
    """About ``splits`` conditions of like numbers of rows, of which any row meets exactly one.

    ``days`` are rows per day; a source with a day per row would still have some ten
    thousand at most. Neighbouring days are put together up to a split's share. A day that
    holds much more is cut by a checksum of its key, as are rows without a date. The first
    and the last range are open, so rows of days that were not there when they were counted
    are read as well, once.
    """
    if splits < 1:
        raise ValueError(f"cannot read in {splits} splits")
    known = sorted((day, n) for day, n in days if day is not None)
    missing = sum(n for day, n in days if day is None)
    share = max(1, -(-(missing + sum(n for _, n in known)) // splits))
    starts: list[tuple[date, int]] = []  # first day and rows of each range
    for day, n in known:
        held = starts[-1][1] if starts else 0
        if starts and held + n <= _FULL * share:
            starts[-1] = (starts[-1][0], held + n)
        else:
            starts.append((day, n))
    column = split.date_column
    ranges = []
    for i, (start, n) in enumerate(starts):
        bounds = [f"{column} >= DATE '{start}'"] if i else []
        if i + 1 < len(starts):
            bounds.append(f"{column} < DATE '{starts[i + 1][0]}'")
        ranges.append((" AND ".join(bounds) or f"{column} IS NOT NULL", n))
    ranges.append((f"{column} IS NULL", missing))
    if len(ranges) == 1:
        ranges.insert(0, (f"{column} IS NOT NULL", 0))
    conditions = []
    for where, n in ranges:
        parts = -(-n // share) if n > _FULL * share else 1
        if parts == 1:
            conditions.append(where)
        else:
            conditions += [f"{where} AND {part}" for part in _key_parts(split, parts)]
    return conditions


def split_reader(
    read: Callable[[str], DataFrame],
    read_where: Callable[[str, list[str]], DataFrame],
    splits: int,
    quoted: Callable[[str], str] = lambda table: f"`{table}`",
) -> Callable[[str, SplitTable | None], DataFrame]:
    """A reader of tables for ``books_from_sql``: whole without a ``SplitTable``, else in
    one task per condition, after the source has counted its rows per day."""

    def table(name: str, split: SplitTable | None) -> DataFrame:
        if split is None:
            return read(quoted(name))
        days = read(day_counts_sql(quoted(name), split)).select(
            F.col("day").cast("date"), F.col("n").cast("long")
        )
        counted = [(r["day"], r["n"]) for r in days.collect()]
        return read_where(quoted(name), date_splits(counted, split, splits))

    return table
