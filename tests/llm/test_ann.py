from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerbeam.llm import ann
from tests.llm.helpers import table


def vectors(spark, rows):
    df = spark.createDataFrame(list(rows), "vec_id long, embedding array<float>")
    return df.withColumns({c: F.lit("clash") for c in ("key", "part", "parts", "vector", "ids", "score")}).repartition(3)


def brute(rows, k=10, every=100):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, dtype=np.float32).astype(np.float64)
    out = {}
    for q in (i for i in good if i % every == 0):
        near = sorted((float(np.sqrt(((good[i] - good[q]) ** 2).sum())), i) for i in good if i != q)
        out[q] = near[:k]
    return out


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def nearest(df, k=10, every=100):
    return result(ann.nearest(df, F.col("vec_id") % every == 0, k))


def recall(got, want):
    hit = sum(len({v for _, v in got.get(q, [])} & {v for _, v in near}) for q, near in want.items())
    return hit / max(1, sum(map(len, want.values())))


def learned(spark, sf):
    rows = table(spark, "embeddings", sf).orderBy("vec_id").collect()
    return ann.learn(np.array([r["embedding"] for r in rows], dtype=np.float64), len(rows) // ann.PART_ROWS), len(rows)


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_routing_leaves_rows_out_at_small_sizes_too(spark, sf):
    router, rows = learned(spark, sf)
    parts = router.weights[2].shape[1]
    assert parts == rows // ann.PART_ROWS > 1
    assert router.probes < 0.9 * parts  # these vectors are random: nothing routes them well


def test_clustered_vectors_need_few_parts():
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((40, 32)) * 4
    x = centres[rng.integers(0, 40, 4000)] + rng.standard_normal((4000, 32))
    router = ann.learn(x, len(x) // ann.PART_ROWS)
    place = router.logits(x).argmax(1)
    order = np.argsort(-router.logits(x), axis=1)[:, : router.probes]
    read = np.bincount(place, minlength=len(x) // ann.PART_ROWS)[order].sum(1).mean()
    assert read < 0.2 * len(x)
    near = ann.neighbour_graph(x, 10)
    found = (place[near][:, :, None] == order[:, None, :]).any(2).mean()
    assert found >= 0.95


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_recall_and_exact_scores_on_whole_tables(spark, sf):
    df = table(spark, "embeddings", sf)
    rows = [tuple(r) for r in df.select("vec_id", "embedding").collect()]
    got, want = nearest(df), brute(rows)
    assert got.keys() == want.keys()
    assert recall(got, want) >= 0.9
    good = {i: np.array(v, dtype=np.float64) for i, v in rows}
    for q, near in got.items():
        assert len(near) == 10 and near == sorted(near)
        for score, v in near:
            assert v != q and score == pytest.approx(np.linalg.norm(good[v] - good[q]), rel=1e-12)


def test_recall_with_many_parts(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART_ROWS", 60)
    monkeypatch.setattr(ann, "CELL_ROWS", 50)
    monkeypatch.setattr(ann, "CELL_QUERIES", 7)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((20, 16)) * 4
    rows = [(i, (centres[i % 20] + rng.standard_normal(16)).tolist()) for i in range(3000)]
    rows += [(10_000 + i, rows[0][1]) for i in range(1500)]  # a third of all rows share one vector
    got, want = nearest(vectors(spark, rows)), brute(rows)
    assert got.keys() == want.keys()
    assert recall(got, want) >= 0.9
    assert [v for _, v in got[0]] == list(range(10_000, 10_010))  # ties to the smaller id
    assert [v for _, v in got[10_000]][:2] == [0, 10_001]


def test_odd_vectors_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (100, [1.0, 1.0]), (100, [1.0, 1.0])]
    odd = [(3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [float("nan"), 1.0]),
           (8, [float("inf"), 1.0]), (None, [1.0, 0.0]), (9, [1.0, 2.0, 3.0]), (200, None)]
    got = nearest(vectors(spark, rows + odd))
    assert got == {
        0: [(0.0, 2), (1.0, 100), (pytest.approx(2**0.5), 1)],
        100: [(1.0, 0), (1.0, 1), (1.0, 2)],
    }


def test_few_rows_and_nothing(spark):
    assert nearest(vectors(spark, [(0, [1.0, 2.0])])) == {}
    assert nearest(vectors(spark, [])) == {}
    assert nearest(vectors(spark, [(1, [1.0]), (2, [2.0])])) == {}


def test_parts_are_balanced():
    rng = np.random.default_rng(0)
    graph = ann.neighbour_graph(rng.standard_normal((1000, 8)), 10)
    assert all(len(set(g)) == 10 and i not in g for i, g in enumerate(graph))
    sizes = np.bincount(ann.balanced_parts(graph, 7, rng))
    assert len(sizes) == 7 and sizes.max() - sizes.min() <= 3


def test_ties_of_many_vectors_go_to_the_smaller_id(spark):
    rows = [(i * 50 % 599, [float(j == i) for j in range(599)]) for i in range(599)]  # one-hot
    got, want = nearest(vectors(spark, rows)), brute(rows)
    assert got == want
    assert [v for _, v in got[300]] == list(range(10))


def test_copies_that_differ_in_the_last_bits(spark):
    rng = np.random.default_rng(5)
    one = (rng.standard_normal(64) / 1000).astype(np.float32)
    one[0] = 1
    steps = rng.integers(-1, 2, (1000, 64))
    steps[:, 0] = 0
    rows = [(i, np.nextafter(one, one + s.astype(np.float32)).tolist()) for i, s in enumerate(steps)]
    got, want = nearest(vectors(spark, rows)), brute(rows)
    assert got.keys() == want.keys()
    for q, near in want.items():
        assert [v for _, v in got[q]] == [v for _, v in near]
        assert [s for s, _ in got[q]] == pytest.approx([s for s, _ in near], rel=1e-12)


def test_one_id_with_many_equally_far_vectors():
    c = np.eye(40)[1:]
    ids = np.array([[7]] * 30 + [[i] for i in range(20, 29)], dtype=object)
    (best,) = ann.reranked(np.eye(40)[:1], c, ids, 5)
    assert [v for _, v in best] == [7, 20, 21, 22, 23]
