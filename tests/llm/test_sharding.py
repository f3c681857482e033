from __future__ import annotations

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerbeam.llm import sharding
from ledgerbeam.llm.queries import op10_sharding
from tests.llm.helpers import TESTDATA, documents, ordered, same_as_duckdb

NAMES = [f"s{i}" for i in range(7)]


def brute_table(names, size):
    """Whole preference lists, consumed in turns."""
    lists = []
    for name in names:
        d = hashlib.md5(name.encode()).hexdigest()
        offset, skip = int(d[:16], 16) % size, int(d[16:], 16) % (size - 1) + 1
        lists.append([(offset + j * skip) % size for j in range(size)])
    owner = {}
    while len(owner) < size:
        for i, wishes in enumerate(lists):
            free = [s for s in wishes if s not in owner]
            if free:
                owner[free[0]] = i
    return [owner[s] for s in range(size)]


def test_table_equals_brute_force_and_is_even():
    assert sharding.lookup_table(NAMES, 211) == brute_table(NAMES, 211)
    sizes = Counter(sharding.lookup_table(NAMES)).values()
    assert max(sizes) - min(sizes) <= 1


def test_removing_a_shard_moves_few_other_slots():
    before = sharding.lookup_table(NAMES)
    after = sharding.lookup_table(NAMES[:-1])
    moved = sum(b != a for b, a in zip(before, after, strict=True) if b != len(NAMES) - 1)
    assert moved < 0.15 * len(before)


@pytest.mark.parametrize("names, size", [(NAMES, 210), ([], 211), (["a", "a"], 211), (NAMES, 5)])
def test_refused(names, size):
    with pytest.raises(ValueError):
        sharding.lookup_table(names, size)


def test_place_equals_brute_force(spark):
    rows = [(i, "t") for i in range(300)] + [(None, "t"), (5, "t"), (-(2**63), None)]
    got = sharding.place(documents(spark, rows), "doc_id", NAMES, 211)
    slots = brute_table(NAMES, 211)

    def want(key):
        slot = int(hashlib.md5(("" if key is None else str(key)).encode()).hexdigest()[:15], 16) % 211
        return (key, slot, slots[slot], NAMES[slots[slot]])

    expected = sorted(
        (want(i) for i, _ in rows), key=lambda r: tuple((v is not None, str(type(v)), v) for v in r)
    )
    assert ordered(got, "doc_id", "slot", "shard_index", "shard") == expected
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_empty_table_and_written_shards(spark, tmp_path):
    assert sharding.place(documents(spark, []), "doc_id", NAMES, 211).count() == 0
    docs = documents(spark, [(i, f"t{i}") for i in range(50)] * 2)
    sharding.write_shards(docs, "doc_id", NAMES, str(tmp_path / "out"), splits=2, table_size=211)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert ordered(back, "doc_id", "text") == ordered(docs, "doc_id", "text")
    placed = sharding.place(docs, "doc_id", NAMES, 211).distinct()
    assert ordered(back.distinct(), "doc_id", "shard") == ordered(placed, "doc_id", "shard")


def test_written_shards_keep_columns_with_any_names(spark, tmp_path):
    docs = documents(spark, [(i, f"t{i}") for i in range(20)])
    docs = docs.withColumns({"placed_slot": F.lit(1), "Placed_Index": F.lit(2), "placed__split": F.lit(3)})
    sharding.write_shards(docs, "doc_id", NAMES, str(tmp_path / "out"), splits=2, table_size=211)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert set(back.columns) == {*docs.columns, "shard"}
    columns = ("doc_id", "placed_slot", "Placed_Index", "placed__split")
    assert ordered(back, *columns) == ordered(docs, *columns)


def test_sql_gives_the_same_rows(spark):
    same_as_duckdb(spark, "op10_sharding", op10_sharding, f"{TESTDATA}/sf0.01")
