from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from ledgerbeam.llm import circulant
from ledgerbeam.llm.common import stored
from ledgerbeam.llm.queries import op12_circulant_minhash
from tests.llm.helpers import TESTDATA, documents, ordered, shape, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 3:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 3]) for i in range(len(words) - 2)}


def brute(rows, per_cent=85):
    """Candidates are all pairs that share a shingle; ids are one node each."""
    sets = [shingles(t) for _, t in rows]
    nodes = [("row", i) if rows[i][0] is None else ("id", rows[i][0]) for i in range(len(rows))]
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    having = defaultdict(list)
    for i, found in enumerate(sets):
        for s in found if rows[i][0] is not None else ():
            having[s].append(i)
    shared = defaultdict(int)
    for members in having.values():
        for a, i in enumerate(members):
            for j in members[a + 1 :]:
                shared[i, j] += 1
    for (i, j), both in shared.items():
        if 100 * both >= per_cent * (len(sets[i]) + len(sets[j]) - both):
            up[top(nodes[i])] = top(nodes[j])
    least = {}
    for n in nodes:
        if n[0] == "id":
            least[top(n)] = min(least.get(top(n), n[1]), n[1])
    out = []
    for (doc_id, _), found, n in zip(rows, sets, nodes, strict=True):
        component = None if doc_id is None else least[top(n)]
        out.append((doc_id, len(found), component, doc_id is None or doc_id == component))
    return sorted(out, key=lambda r: tuple((v is not None, v or 0) for v in r))


def found(df):
    return sorted(
        (tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()),
        key=lambda r: tuple((v is not None, v or 0) for v in r),
    )


def near(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"new{rng.random()}"
    return " ".join(words)


def test_equals_brute_force_on_odd_rows(spark):
    rng = random.Random(1)
    base = [f"w{rng.randrange(500)}" for _ in range(300)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one two")]
    rows += [(None, "one"), (None, " ".join(base)), (None, None), (4, "one"), (4, "one"), (2, None)]
    rows += [(100 + i, near(rng, base, i)) for i in range(25)]
    rows += [(8, near(rng, base, 3)), (8, "other text of its own here"), (9, "other text of its own here")]
    rows += [(-(2**63), "x y z"), (2**63 - 1, "X  y\tz"), (300, "long " * 60_000), (301, "long " * 50_000)]
    rows += [(400, "É a b c"), (401, "é a b c")]
    assert found(circulant.near_duplicates(documents(spark, rows))) == brute(rows)


def test_query_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, "documents").collect()]
    want = brute(rows)
    got = op12_circulant_minhash(spark, f"{TESTDATA}/sf0.001")
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert found(got) == want
    assert any(r[0] != r[2] for r in want)


def test_chains_in_hot_buckets_equal_brute_force(spark, monkeypatch):
    """Drifting copies of three sizes: few are similar to their hub, so cells decide."""
    monkeypatch.setattr(circulant, "CELL", 8)
    monkeypatch.setattr(circulant, "CELL_BYTES", 8000)
    monkeypatch.setattr(circulant, "SPLIT", 4)
    monkeypatch.setattr(circulant, "LARGE", 20)
    rng = random.Random(2)
    rows = []
    for size in (60, 75, 200):
        words = [f"s{size}w{i}" for i in range(size)]
        for _ in range(120):
            rows.append((len(rows) * 7 % 1009, " ".join(words)))
            words[rng.randrange(size)] = f"n{rng.random()}"
    shared = [f"p{i}" for i in range(400)]  # a passage that makes buckets, not links
    rows += [(2000 + i, " ".join(shared + [f"t{i}x{j}" for j in range(90)])) for i in range(60)]
    rows += [(3000 + i, near(rng, shared, 2)) for i in range(40)]
    want = brute(rows)
    assert 3 < len({r[2] for r in want}) < len(rows)
    assert found(circulant.near_duplicates(documents(spark, rows))) == want


def test_cells_bring_every_pair_of_like_sizes_together_once(spark, monkeypatch):
    monkeypatch.setattr(circulant, "CELL", 5)
    sizes = [10 + i % 40 for i in range(120)]
    label = [0 if i % 3 else i for i in range(120)]  # two thirds are of the main component
    rows = [(1, i, s, label[i], 120, 0) for i, s in enumerate(sizes)]
    rows += [(2, i, 50, i, 4, 0) for i in range(4)]
    names = "key long, cid long, size long, label long, n long, main long"
    members = spark.createDataFrame(rows, names)
    cells = defaultdict(list)
    for r in circulant._cells(members, 85).collect():
        cells[r["cell"]].append((r["part"], r["cid"]))
    met = defaultdict(int)
    for cell, inside in cells.items():
        for a, i in inside:
            for b, j in inside:
                if i < j and (cell["low"] == cell["high"] or a != b):
                    met[cell["key"], i, j] += 1
    for i in range(120):
        for j in range(i + 1, 120):
            if label[i] == label[j] == 0:
                assert (1, i, j) not in met
            elif 100 * min(sizes[i], sizes[j]) >= 85 * max(sizes[i], sizes[j]):
                assert met[1, i, j] == 1
    assert set(met.values()) == {1}
    assert all(met[2, i, j] == 1 for i in range(4) for j in range(i + 1, 4))
    far = sum(1 for (k, i, j) in met if k == 1 and min(sizes[i], sizes[j]) < 0.7 * max(sizes[i], sizes[j]))
    assert far == 0


def test_permutations_and_estimate():
    domain = np.arange(2**16, dtype=np.uint32) * np.uint32(65_537)
    for permutation in (circulant.sigma, lambda x: circulant.pi(x.copy())):
        assert len(np.unique(permutation(domain))) == len(domain)
    shift = np.uint32(9)
    one = np.array([7 << 32], dtype=np.uint64)
    least = circulant.signature(one)
    place = circulant.sigma(np.array([7], dtype=np.uint32))
    assert least[9] == circulant.pi(place + shift)[0]  # coordinate 9: shifted by 9
    rng = np.random.default_rng(4)
    for similarity in (0.3, 0.6, 0.85):
        n = 400
        both = int(round(2 * n * similarity / (1 + similarity)))
        equal = []
        for _ in range(60):
            pool = rng.integers(0, 2**63, 2 * n - both, dtype=np.uint64)
            a, b = pool[:n], np.concatenate([pool[:both], pool[n:]])
            equal.append((circulant.signature(a) == circulant.signature(b)).mean())
        assert abs(np.mean(equal) - similarity) < 0.02


def test_least_matches_keeps_almost_all_pairs_just_similar_enough():
    least = circulant.least_matches()
    assert 60 < least < 100
    rng = np.random.default_rng(8)
    assert (rng.binomial(125, 0.85, 1_000_000) >= least).all()
    assert 1 - (1 - 0.85**circulant.ROWS) ** circulant.BANDS > 0.999999


def test_empty_table_and_kept_rows(spark):
    none = documents(spark, [])
    assert circulant.near_duplicates(none).count() == 0
    assert circulant.keep_one_of_each_component(none).count() == 0
    rows = [(i, f"a b c d e f g {i // 3}") for i in range(9)] + [(None, "a"), (50, None)]
    docs = documents(spark, rows)
    kept = circulant.keep_one_of_each_component(docs)
    assert shape(kept) == shape(docs)
    assert ordered(stored(kept), "doc_id") == [(None,), (0,), (3,), (6,), (50,)]
    assert kept.filter(F.col("`a.b`") == "clash").count() == 5
