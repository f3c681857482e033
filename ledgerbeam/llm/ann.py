"""Nearest neighbours through learned partitions of a neighbour graph."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerbeam.llm.common import map_batches, stored

SAMPLE = 8192  # distinct vectors that the partitions are learned on
MOST_PARTS = 256
PART_ROWS = 64  # wished size of a partition while there are fewer than MOST_PARTS
GRAPH_DEGREE = 10
HIDDEN = 64
ROUTED = 0.96  # share of the sample's neighbours that the probes of a query should reach
CELL_ROWS, CELL_QUERIES = 4096, 1024
BLOCK = 1024  # rows whose differences from a query are held at once


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def reranked(q: np.ndarray, c: np.ndarray, ids: np.ndarray, k: int):
    """For each row of ``q`` its least (distance, id) pairs, ``k`` of them, over the rows of
    ``c``, of which each has a sorted list of ids.

    The expanded formula only says which rows can be among them: all whose rough value is
    within its rounding error of the k-th smallest, however many tie. Their distances are
    then taken from the differences, in blocks."""
    rough = squared(q, c)
    least = np.partition(rough, min(k, len(c)) - 1, axis=1)[:, min(k, len(c)) - 1]
    largest = (q * q).sum(1) + (c * c).sum(1).max()
    limit = least + 8 * (q.shape[1] + 4) * np.finfo(np.float64).eps * largest
    first = np.array([i[0] for i in ids], dtype=np.int64)
    for one, row, most in zip(q, rough, limit, strict=True):
        near = np.flatnonzero(~(row > most))
        exact = np.concatenate([
            np.sqrt(((c[near[at : at + BLOCK]] - one) ** 2).sum(axis=1))
            for at in range(0, len(near), BLOCK)
        ])
        # Of rows beyond k different pairs of distance and least id, no id can count.
        order = np.lexsort((first[near], exact))
        score, head = exact[order], first[near][order]
        fresh = np.concatenate([[True], (np.diff(score) != 0) | (np.diff(head) != 0)])
        order = order[np.cumsum(fresh) <= k]
        yield sorted({(float(exact[j]), int(v)) for j in order for v in ids[near[j]]})[:k]


def neighbour_graph(x: np.ndarray, degree: int) -> np.ndarray:
    """The nearest others of each row, by brute force over the bounded sample."""
    out = np.empty((len(x), degree), dtype=np.int64)
    for at in range(0, len(x), 1024):
        d = squared(x[at : at + 1024], x)
        d[np.arange(len(d)), at + np.arange(len(d))] = np.inf
        near = np.argpartition(d, degree - 1, axis=1)[:, :degree]
        out[at : at + 1024] = near
    return out


def _bisected(edges: np.ndarray, n: int, share: float, rng: np.random.Generator) -> np.ndarray:
    """Cut a graph in two at the wished size: along its second eigenvector, then by swaps
    that lower the number of edges cut and leave the sizes as they are."""
    a, b = edges
    degree = np.bincount(a, minlength=n) + 1.0
    v = rng.standard_normal(n)
    for _ in range(60):
        v -= (v * degree).sum() / degree.sum()
        v = (v + np.bincount(a, v[b], minlength=n)) / degree
        v /= np.abs(v).max() + 1e-12
    left = np.zeros(n, dtype=bool)
    left[np.argsort(v, kind="stable")[: max(1, min(n - 1, round(n * share)))]] = True
    for _ in range(12):
        across = left[a] != left[b]
        gain = np.bincount(a, np.where(across, 1, -1), minlength=n)
        ours, theirs = np.flatnonzero(left), np.flatnonzero(~left)
        ours = ours[np.argsort(-gain[ours], kind="stable")]
        theirs = theirs[np.argsort(-gain[theirs], kind="stable")]
        most = min(len(ours), len(theirs), max(1, n // 50))
        better = gain[ours[:most]] + gain[theirs[:most]] > 1
        if not better.any():
            break
        left[ours[:most][better]], left[theirs[:most][better]] = False, True
    return left


def balanced_parts(graph: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """Recursive bisection of the graph into parts of equal size, to within one row each."""
    n = len(graph)
    a = np.repeat(np.arange(n), graph.shape[1])
    b = graph.ravel()
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    label = np.zeros(n, dtype=np.int64)
    todo = [(np.arange(n), parts, 0)]
    place = np.empty(n, dtype=np.int64)
    while todo:
        rows, count, first = todo.pop()
        if count == 1 or len(rows) < 2:
            label[rows] = first
            continue
        inside = np.zeros(n, dtype=bool)
        inside[rows] = True
        place[rows] = np.arange(len(rows))
        both = inside[a] & inside[b]
        half = count // 2
        left = _bisected(np.stack([place[a[both]], place[b[both]]]), len(rows), half / count, rng)
        todo.append((rows[left], half, first))
        todo.append((rows[~left], count - half, first + half))
    return label


@dataclass
class Router:
    """A network with one hidden layer from a vector to the partitions' probabilities."""

    weights: list[np.ndarray]
    centre: np.ndarray
    scale: float
    probes: int

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.maximum((x - self.centre) / self.scale @ w1 + b1, 0) @ w2 + b2


def _trained(x: np.ndarray, target: np.ndarray, rng: np.random.Generator) -> Router:
    """``target``: each row's distribution over the parts of itself and its neighbours."""
    centre, scale = x.mean(0), float(x.std()) or 1.0
    z = (x - centre) / scale
    dim, parts = x.shape[1], target.shape[1]
    w = [
        rng.standard_normal((dim, HIDDEN)) * np.sqrt(2 / dim),
        np.zeros(HIDDEN),
        rng.standard_normal((HIDDEN, parts)) * np.sqrt(1 / HIDDEN),
        np.zeros(parts),
    ]
    m, v = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
    step, epochs = 0, 40
    for epoch in range(epochs):
        order = rng.permutation(len(z))
        for at in range(0, len(z), 256):
            rows = order[at : at + 256]
            h = np.maximum(z[rows] @ w[0] + w[1], 0)
            out = h @ w[2] + w[3]
            p = np.exp(out - out.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            d = (p - target[rows]) / len(rows)
            d_h = d @ w[2].T * (h > 0)
            step += 1
            for i, g in enumerate((z[rows].T @ d_h, d_h.sum(0), h.T @ d, d.sum(0))):
                m[i] += 0.1 * (g - m[i])
                v[i] += 0.001 * (g * g - v[i])
                rate = 0.005 * (1 - epoch / epochs)
                w[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-9)
    return Router(w, centre, scale, 1)


def learn(x: np.ndarray, parts: int, seed: int = 11) -> Router:
    """Partition the sample's neighbour graph and train the router on it.

    The number of probes is the least with which the sample's rows, as queries, reach the
    share ``ROUTED`` of their neighbours, where these are put by the router itself."""
    rng = np.random.default_rng(seed)
    if parts < 2 or len(x) <= GRAPH_DEGREE + 1:
        dim = x.shape[1]
        w = [np.zeros((dim, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)]
        return Router(w, np.zeros(dim), 1.0, 1)
    graph = neighbour_graph(x, GRAPH_DEGREE)
    label = balanced_parts(graph, parts, rng)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.arange(len(x)), label), 1.0)
    np.add.at(target, (np.repeat(np.arange(len(x)), GRAPH_DEGREE), label[graph].ravel()), 1.0)
    router = _trained(x, target / target.sum(1, keepdims=True), rng)
    logits = router.logits(x)
    place = logits.argmax(1)
    order = np.argsort(-logits, axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(parts)[None, :].repeat(len(x), 0), axis=1)
    needed = np.sort(np.take_along_axis(rank, place[graph], axis=1).ravel())
    router.probes = int(needed[min(len(needed) - 1, int(ROUTED * len(needed)))]) + 1
    return router


def usable(vector: Column) -> Column:
    """Not null, not empty, not zero, and without null or non-finite components."""
    numbers = F.transform(vector, lambda v: v.cast("double"))
    odd = F.exists(
        numbers, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    )
    return F.coalesce(~odd & F.exists(numbers, lambda v: v != 0.0), F.lit(False))


def _routed(rows: DataFrame, router: Router, sizes: dict[int, int], need: int) -> DataFrame:
    """Adds ``parts``: the most probable ones, more of them where they hold too few rows."""
    shared = rows.sparkSession.sparkContext.broadcast((router, sizes))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, held = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch["vector"].to_pylist(), dtype=np.float64)
            order = np.argsort(-net.logits(x), axis=1, kind="stable")
            chosen = []
            for row in order.tolist():
                if not need:
                    chosen.append(row[:1])
                    continue
                n, got = 0, 0
                while n < len(row) and (n < net.probes or got < need):
                    got += held.get(row[n], 0)
                    n += 1
                chosen.append([p for p in row[:n] if p in held])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(chosen, pa.list_(pa.int32()))],
                names=[*batch.schema.names, "parts"],
            )

    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", parts array<int>"
    return map_batches(rows, work, schema)


def nearest(embeddings: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """The ``k`` nearest other rows of each query row of ``embeddings`` (vec_id, embedding).

    1. Equal vectors are one class, with its ``k + 1`` smallest ids: more of them can be in
       no result. So a vector that a third of all rows share is searched once, exactly.
    2. At most ``SAMPLE`` classes, drawn by a hash, reach the driver. Their neighbour graph
       is cut into balanced parts, and a small network learns to tell a vector's part.
    3. Every class is put in the part that the network deems most probable. A query class
       goes to the most probable parts, as many as the sample's own neighbours needed.
    4. A part with its queries is dealt over cells of at most about ``CELL_ROWS`` by
       ``CELL_QUERIES``; each cell reranks by distances in double precision, all rows
       that tie or nearly tie included, and the cells' best are merged. Queries with the same vector share one search.

    Returned: query_id, rank (from 1), vec_id, score (Euclidean distance); ties go to the
    smaller vec_id, a query's own id is left out. All others are returned where there are
    fewer than ``k``. Rows without an id, and vectors that are null, empty, zero, hold a
    null or non-finite component, or have another dimension than most, take no part. Rows
    that repeat id and vector count once; an id with several vectors is a candidate by
    each of them, and as a query it is searched by its least vector. An empty table gives
    no rows. Other columns are not read, whatever their names.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(
        embeddings["vec_id"].cast("long").alias("vec_id"),
        embeddings["embedding"].cast("array<double>").alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("asked"),
    ).filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    dims = rows.groupBy(F.size("vector").alias("dim")).count()
    common = dims.orderBy(F.desc("count"), "dim").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if common is None:
        return spark.createDataFrame([], schema)
    rows = rows.filter(F.size("vector") == common["dim"])
    key = F.md5(F.concat_ws(",", F.transform("vector", lambda v: (v + 0.0).cast("string"))))
    by_key = Window.partitionBy("key").orderBy("vec_id")
    keyed = rows.withColumn("key", key)
    kept = (
        keyed.select("key", "vec_id", "vector")
        .withColumn("nth", F.dense_rank().over(by_key))
        .filter(F.col("nth") <= k + 1)
    )
    classes = stored(
        kept.groupBy("key").agg(
            F.first("vector").alias("vector"), F.sort_array(F.collect_set("vec_id")).alias("ids")
        )
    )
    sample = classes.select("vector", "key").orderBy(F.md5("key")).limit(SAMPLE).collect()
    parts = max(1, min(MOST_PARTS, classes.count() // PART_ROWS, len(sample) // 16))
    router = learn(np.array([r["vector"] for r in sample], dtype=np.float64), parts)
    index = stored(
        _routed(classes, router, {}, 0).select(
            "key", "vector", "ids", F.col("parts")[0].alias("part")
        )
    )
    # One number per part: at most MOST_PARTS of each.
    held = {r["part"]: (r["n"], r["ids"]) for r in index.groupBy("part").agg(
        F.count("*").alias("n"), F.sum(F.size("ids")).alias("ids")).collect()}
    queries = stored(keyed.filter("asked").groupBy("vec_id").agg(F.min("key").alias("key")))
    asked = index.join(queries.select("key").distinct(), "key", "left_semi")
    probing = stored(
        _routed(asked.select("key", "vector"), router, {p: i for p, (_, i) in held.items()}, k + 1)
        .select("key", "vector", F.explode("parts").alias("part"))
    )
    loads = {r["part"]: r["count"] for r in probing.groupBy("part").count().collect()}
    shape = spark.createDataFrame(
        [(p, -(-n // CELL_ROWS), -(-loads[p] // CELL_QUERIES)) for p, (n, _) in held.items() if p in loads],
        "part int, row_blocks int, query_blocks int",
    )

    def celled(side: DataFrame, own: str, other: str) -> DataFrame:
        """Its own block by a hash, and a copy for every block of the other side."""
        return (
            side.join(F.broadcast(shape), "part")
            .withColumn(own[:-1], F.pmod(F.xxhash64("key"), F.col(own)).cast("int"))
            .withColumn(other[:-1], F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
            .drop("row_blocks", "query_blocks")
        )

    cell = ["part", "row_block", "query_block"]

    def rerank(_key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"key": [], "vec_id": [], "score": []})
        if left.empty or right.empty:
            return none
        q = np.stack(left["vector"].to_numpy()).astype(np.float64)
        c = np.stack(right["vector"].to_numpy()).astype(np.float64)
        ids = right["ids"].to_numpy()
        keys, found, scores = [], [], []
        for one, best in zip(left["key"], reranked(q, c, ids, k + 1), strict=True):
            keys += [one] * len(best)
            scores += [s for s, _ in best]
            found += [v for _, v in best]
        return pd.DataFrame({"key": keys, "vec_id": found, "score": scores})

    found = (
        celled(probing, "query_blocks", "row_blocks")
        .groupBy(*cell)
        .cogroup(celled(index, "row_blocks", "query_blocks").groupBy(*cell))
        .applyInPandas(rerank, "key string, vec_id long, score double")
    )
    merged = Window.partitionBy("key").orderBy("score", "vec_id")
    best = found.distinct().withColumn("nth", F.row_number().over(merged)).filter(
        F.col("nth") <= k + 1
    )
    best = stored(best.drop("nth"))
    ranked = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        queries.withColumnRenamed("vec_id", "query_id")
        .join(best, "key")
        .filter("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(ranked))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
