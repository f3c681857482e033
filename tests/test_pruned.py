from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerbeam.operators import top_parties, top_parties_pruned
from ledgerbeam.operators.pruned import surviving_entries


def ledger(spark, rows):
    return spark.createDataFrame(
        [(p, None if c is None else Decimal(c), "Customer", "Receive") for p, c in rows],
        "party string, credit decimal(18,2), party_type string, voucher_type string",
    )


def same(gl, k=5, buckets=64):
    want = top_parties(gl, "Customer", "Receive", k).collect()
    assert top_parties_pruned(gl, "Customer", "Receive", k, buckets).collect() == want
    return want


CASES = {
    "ties": [(f"p{i:02}", 10) for i in range(40)],
    "a tie at the end": [(f"p{i:02}", max(0, 10 - i // 2)) for i in range(40)],
    "negative": [("a", 100), ("a", -99), ("b", 50), ("c", -5), ("d", -1), ("e", 0), ("f", -7)],
    "all negative": [(f"p{i}", -i - 1) for i in range(30)],
    "no party": [(None, 40), (None, 2), ("a", 41), ("b", 43), ("c", 1), ("d", 1), ("e", 1)],
    "no amount": [("a", None), (None, None), ("b", 1), ("c", None)],
    "nothing": [],
}


@pytest.mark.parametrize("name", CASES)
def test_odd_ledgers(spark, name):
    same(ledger(spark, CASES[name]))


def test_few_entries_of_many_parties_are_grouped(spark):
    """A third of all entries are one party's; of 20,000 others a handful pay much."""
    n = 60_000
    big = F.pmod(F.col("id"), F.lit(4001)) == 17
    party = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), (F.col("id") % 20_000).cast("string")))
    gl = spark.range(n).select(
        party.alias("party"),
        F.when(big, 5000).otherwise(F.col("id") % 7 - 2).cast("decimal(18,2)").alias("credit"),
        F.lit("Customer").alias("party_type"),
        F.lit("Receive").alias("voucher_type"),
    )
    want = same(gl, buckets=1 << 12)
    left = surviving_entries(gl, "Customer", "Receive", 5, 1 << 12)
    parties = {r[0] for r in left.select("party").distinct().collect()}
    assert {r["customer"] for r in want} <= parties
    assert len(parties) < 200 and left.filter("party <> 'hot'").count() < n // 100
