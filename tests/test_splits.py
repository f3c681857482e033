"""Reading an SQL source by disjoint conditions, recorded on temporary views over Parquet."""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce

import pytest
from pyspark.sql import functions as F

from ledgerbeam import operators as op
from ledgerbeam.sources import SPLIT_TABLES, books_from_sql, date_splits
from ledgerbeam.sources.books import ERP_TABLES
from tests.helpers import CHART, entry, frame, rows

SPLIT = SPLIT_TABLES["gl_entry"]
HOT = date(2020, 6, 1)


def ledger_rows():
    """A third of the rows on one day, a tenth without a date, some without a key."""
    found = []
    for i in range(3000):
        day = HOT if i % 3 == 0 else None if i % 10 == 1 else date(2019, 1, 1) + timedelta(days=i % 700)
        found.append((*entry("till", i, 1, day=day), None if i % 97 == 0 else f"GL-{i:05}", i))
    return found


class Source:
    """Stands for a database: it answers queries and records how tables were read."""

    def __init__(self, spark):
        self.spark, self.whole, self.split = spark, [], {}

    def read(self, table):
        self.whole.append(table)
        return self.spark.sql(f"select * from {table}")

    def read_where(self, table, conditions):
        self.split[table] = conditions
        parts = [self.spark.sql(f"select * from {table} where {c}") for c in conditions]
        return reduce(lambda a, b: a.unionAll(b), parts)


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("erp")
    schema = frame(spark, "gl_entry", []).schema.add("name", "string").add("id", "integer")
    tables = {
        "gl_entry": spark.createDataFrame(ledger_rows(), schema),
        "account": frame(spark, "account", CHART),
        "employee": frame(spark, "employee", [("e", HOT)]),
    }
    for name in ("sales_invoice", "purchase_invoice"):
        tables[name] = frame(spark, name, [(HOT, None, "Paid")]).withColumn("name", F.lit("x"))
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}")
        spark.read.parquet(f"{folder}/{name}").createOrReplaceTempView(f"`{ERP_TABLES[name]}`")
    return Source(spark)


def test_every_row_is_in_exactly_one_split_and_splits_are_even(spark, source):
    ledger = spark.table("`tabGL Entry`")
    days = [tuple(r) for r in ledger.groupBy("posting_date").count().collect()]
    conditions = date_splits(days, SPLIT, 8)
    assert 8 <= len(conditions) <= 16
    met = ledger.select("id", *(F.coalesce(F.expr(c), F.lit(False)).cast("int").alias(f"c{i}") for i, c in enumerate(conditions)))
    times = reduce(lambda a, b: a + b, (F.col(c) for c in met.columns[1:]))
    assert met.filter(times != 1).count() == 0
    sizes = met.agg(*(F.sum(c) for c in met.columns[1:])).first()
    assert max(sizes) <= 1.6 * 3000 / 8  # no split holds the day of a third of all rows
    assert sum(sizes) == 3000


def test_days_that_come_later_are_read_once(spark):
    conditions = date_splits([(date(2020, 1, 1), 5), (date(2020, 1, 2), 5), (None, 1)], SPLIT, 3)
    later = [date(1990, 1, 1), date(2020, 1, 1), date(2020, 1, 2), date(2035, 1, 1), None]
    df = spark.createDataFrame([(d, "k") for d in later], "posting_date date, name string")
    assert sorted(str(r[0]) for c in conditions for r in df.filter(c).collect()) == sorted(map(str, later))


@pytest.mark.parametrize("days", [[], [(None, 50)], [(HOT, 50)], [(HOT, 0), (None, 0)]], ids=str)
def test_tables_without_days_or_with_one(spark, days):
    df = spark.createDataFrame(
        [(HOT, "a"), (None, "b"), (HOT, None), (None, None)], "posting_date date, name string"
    )
    conditions = date_splits(days, SPLIT, 4)
    assert sum(df.filter(c).count() for c in conditions) == 4
    with pytest.raises(ValueError):
        date_splits(days, SPLIT, 0)


def test_books_from_a_split_source(spark, source):
    books = books_from_sql(source.read, source.read_where, splits=6)
    assert set(source.split) == {"`tabGL Entry`", "`tabSales Invoice`", "`tabPurchase Invoice`"}
    assert {"`tabAccount`", "`tabEmployee`"} <= set(source.whole)
    assert len([t for t in source.whole if t.startswith("(SELECT")]) == 3
    assert books.gl_entry.count() == 3000
    whole = spark.table("`tabGL Entry`").filter("fiscal_year = '2020'")
    want = whole.agg(F.sum(F.col("debit") - F.col("credit"))).first()[0]
    assert [r[2] for r in rows(op.account_balance(books.gl_entry, books.chart, ["CASH"], "2020"))] == [want]
    plan = books.gl_entry.filter(F.col("posting_date") == HOT)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("2020-06-01") >= 1
