from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from ledgerbeam.llm import prefix_trie
from ledgerbeam.llm.queries import op11_prefix_trie
from tests.llm.helpers import TESTDATA, ordered, same_as_duckdb

COLUMNS = (
    "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
)


def brute(rows, group=5, most_shared=9):
    said = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            spelt = f"{len(role.encode())}:{role}{text}"
            tie = hashlib.sha256(spelt.encode()).hexdigest()
            said[conv].append(((turn is not None, turn or 0, tie), (role, text)))
    own = {c: [turn for _, turn in sorted(t)] for c, t in said.items()}
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % most_shared
        base = c - int(np.fmod(c, group))
        path = tuple(own.get(base, [])[:h]) + tuple(turns[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
            if d:
                children[path[: d - 1]].add(path[:d])
        ends[path].append(c)
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, inside in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += (len(inside) - 1) * (len(path[-1][1].encode()) if path else 0)
    out = []
    for path, inside in members.items():
        text = ",".join(str(c) for c in sorted(ends[path]))
        parent = min(members[path[:-1]]) if path else None
        out.append(
            (min(inside), len(path), parent, len(inside), len(children[path]), leaves[path], saved[path],
             hashlib.sha256(text.encode()).hexdigest())
        )
    return sorted(out, key=lambda r: tuple((v is not None, str(type(v)), v) for v in r))


def conversations(spark, rows):
    df = spark.createDataFrame(list(rows), "conv_id long, turn long, role string, text string")
    names = ("pos", "d1", "depth", "n", "base", "at", "part", "bytes", "a.b")
    return df.withColumns({c: F.lit("clash") for c in names}).repartition(3)


def odd_rows():
    rng = random.Random(4)
    rows = [(None, 0, "user", "nobody's"), (0, None, None, None), (0, 1, "user", None), (0, 1, "user", None)]
    rows += [(0, 1, "user", "tie"), (0, 1, "assistant", "tie"), (0, 2, None, "é漢𝄞")]
    rows += [(1, 0, "user", "only")]  # short: its turns may all lie in the shared part
    rows += [(c, t, "user", f"text {t % 3}") for c in range(5, 25) for t in range(rng.randrange(1, 14))]
    rows += [(c, 0, "user", "no base here") for c in (31, 32, 33, 34, 36, 37, 38, 39)]
    rows += [(-3, 0, "user", "minus"), (-5, 1, "user", "minus five"), (-(2**63), 0, "u", "least"), (2**63 - 1, 0, "u", "most")]
    rows += [(50, t, "user", f"long {t}") for t in range(60)]
    rows += [(55, t, "user", f"long {t}") for t in range(60)] + [(56, 0, "user", "x" * 200_000)]
    rows += [(c, t, "user", f"same {t}") for c in range(100, 200, 5) for t in range(4)]
    rng.shuffle(rows)
    return rows


def test_equals_brute_force_on_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SEGMENT", 7)
    monkeypatch.setattr(prefix_trie, "BLOCK", 3)
    rows = odd_rows()
    got = prefix_trie.prefix_trie(conversations(spark, rows))
    want = brute(rows)
    assert ordered(got, *COLUMNS) == want
    assert any(r[3] > 1 and r[1] > 9 for r in want) and any(r[3] == 0 or r[1] == 0 for r in want)
    assert not got.filter("screened AND n_convs > 1").count()


def test_false_alarms_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "LEAST_BITS", 3)
    monkeypatch.setattr(prefix_trie, "MOST_BITS", 3)
    rows = odd_rows()
    got = prefix_trie.prefix_trie(conversations(spark, rows), group=4, most_shared=3)
    assert ordered(got, *COLUMNS) == brute(rows, 4, 3)


def test_false_alarms_below_single_prefixes_keep_their_rows(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "LEAST_BITS", 8)
    monkeypatch.setattr(prefix_trie, "MOST_BITS", 8)
    rows = odd_rows() + [(c, t, "user", f"own {c} {t}") for c in range(300, 320) for t in range(12)]
    got = prefix_trie.prefix_trie(conversations(spark, rows))
    assert ordered(got, *COLUMNS) == brute(rows)
    below = got.filter("screened").select("conv_id", (F.col("depth") + 1).alias("depth"))
    assert got.filter("NOT screened").join(below, ["conv_id", "depth"]).count() > 5


def test_query_equals_sql_and_screens_most_tails(spark):
    same_as_duckdb(spark, "op11_prefix_trie", op11_prefix_trie, f"{TESTDATA}/sf0.01", ("conversations",))
    nodes = prefix_trie.prefix_trie(spark.read.parquet(f"{TESTDATA}/sf0.01/conversations.parquet"))
    single = nodes.filter("n_convs = 1")
    assert single.filter("screened").count() >= 0.95 * single.count()


def test_empty_table(spark):
    assert prefix_trie.prefix_trie(conversations(spark, [])).count() == 0
    assert prefix_trie.prefix_trie(conversations(spark, [(None, 1, "user", "x")])).count() == 0


def test_sketch_is_bounded_and_never_estimates_too_little(spark):
    assert prefix_trie.sketch_bits(0) == prefix_trie.LEAST_BITS
    assert prefix_trie.sketch_bits(10**12) == prefix_trie.MOST_BITS
    assert 1 << prefix_trie.sketch_bits(10**6) >= 4 * 10**6
    rng = np.random.default_rng(1)
    digests = rng.integers(-(2**63), 2**63, size=(3000, 2), dtype=np.int64)
    digests = np.concatenate([digests, digests[:500]])
    df = spark.createDataFrame([tuple(map(int, d)) for d in digests], "d1 long, d2 long")
    bits = 12
    sketch = prefix_trie._sketch(df, bits)
    cells = prefix_trie._cell_numbers(digests[:, 0].copy(), digests[:, 1].copy(), bits)
    for row, found in zip(sketch, cells, strict=True):
        counts = np.bincount(found, minlength=1 << bits)
        want = np.packbits(counts > 1, bitorder="little")
        assert (row == want).all()
