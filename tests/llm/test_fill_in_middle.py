from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerbeam.llm import fill_in_middle as fim
from ledgerbeam.llm.queries import op13_fill_in_middle
from tests.llm.helpers import TESTDATA, documents, ordered, same_as_duckdb, table

LINES = re.compile(r"[^\n]*\n|[^\n]+")


def brute(doc_id, text, seed=7, rate=100, suffix_first=50):
    text = text or ""
    lines = LINES.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return (doc_id, len(lines), "plain", None, None, text)
    low, high = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    p, m, s = ("".join(part) for part in (lines[:low], lines[low:high], lines[high:]))
    if h[3] % 100 < suffix_first:
        return (doc_id, len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def odd_texts():
    rng = random.Random(3)
    passage = "".join(rng.choice("abc é漢\n𝄞") for _ in range(40_000))
    texts = [None, "", "\n", "\n\n", "a", "a\n", "a\nb", "\r\n\r\n", "<P>", "x<M>y\n", "<S", "<P\n>", "M>\n<"]
    texts += ["é漢𝄞\n" * 3000, "x" * 30_000, "<" * 5000 + "\n" + ">" * 5000, "\n" * 20_000]
    texts += [passage, "lead\n" + passage, passage + passage, passage[:30_000] + "tail"]
    return [(i, t) for i, t in enumerate(texts)]


def columns():
    return ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")


@pytest.mark.parametrize("parameters", [{}, {"seed": 1, "rate": 60, "suffix_first": 20}, {"rate": 0}])
def test_equals_brute_force_and_comes_back(spark, parameters):
    rows = odd_texts() + [(None, "a\nb\nc"), (None, None), (5, "again\nagain"), (5, "again\nagain")]
    rows += [(-(2**63), "low\nend\n")] + [(100 + i, "some\nlines\nhere\n" * i) for i in range(50)]
    got = fim.fill_in_middle(documents(spark, rows), **parameters)
    want = sorted((brute(*r, **parameters) for r in rows), key=lambda r: tuple((v is not None, v or 0) if not isinstance(v, str) else (True, v) for v in r))
    found = sorted((tuple(r[c] for c in columns()) for r in got.collect()), key=lambda r: tuple((v is not None, v or 0) if not isinstance(v, str) else (True, v) for v in r))
    assert found == want
    back = got.select("doc_id", fim.restored(F.col("output"), F.col("form")).alias("text"))
    assert ordered(back, "doc_id", "text") == ordered(
        spark.createDataFrame([(i, t or "") for i, t in rows], "doc_id long, text string"), "doc_id", "text"
    )
    forms = {r[2] for r in found}
    assert forms == ({"plain"} if parameters.get("rate") == 0 else {"plain", "psm", "spm"})


def test_nothing_is_shuffled_and_an_empty_table_stays_empty(spark):
    got = fim.fill_in_middle(documents(spark, []))
    assert got.count() == 0
    assert "Exchange" not in fim.fill_in_middle(table(spark, "documents"))._jdf.queryExecution().executedPlan().toString()


def test_chunks_depend_on_content_and_are_remembered_by_it():
    rng = np.random.default_rng(5)
    passage = rng.integers(0, 256, 200_000, dtype=np.uint8)
    moved = np.concatenate([rng.integers(0, 256, 12_345, dtype=np.uint8), passage])

    def chunks(data):
        ends = [0, *fim.boundaries(data)]
        assert ends[-1] == len(data)
        sizes = np.diff(ends)
        assert sizes.max() <= fim.MOST and (sizes[:-1] >= fim.LEAST).all()
        return {data[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)}

    first, second = chunks(passage), chunks(moved)
    assert len(first & second) > 0.9 * len(first)
    assert fim.boundaries(passage[:0]) == []

    summaries = fim.Summaries()
    fim.Located(passage.tobytes(), summaries)
    made = summaries.made
    fim.Located(moved.tobytes(), summaries)
    assert summaries.made - made < 0.2 * made


def test_the_rolling_hash_sees_its_window_alone():
    rng = np.random.default_rng(6)
    data = rng.integers(0, 256, 500, dtype=np.uint8)
    with np.errstate(over="ignore"):
        whole = fim.rolling_hash(data)
        for end in (1, 7, 16, 17, 100, 500):
            part = fim.rolling_hash(data[max(0, end - fim.WINDOW) : end])
            assert whole[end - 1] == part[-1]
            slow = 0
            for byte in data[max(0, end - fim.WINDOW) : end].tolist():
                slow = (slow * int(fim._BASE) + byte + 1) % 2**32
            assert whole[end - 1] == slow


def test_memory_is_bounded_and_forgetting_changes_nothing():
    small = fim.Summaries(memory=2000)
    for doc_id, text in odd_texts():
        got = fim.rearranged(doc_id, (text or "").encode(), small, 7, 100, 50)
        assert got[4].decode() == brute(doc_id, text)[5]
        assert small.held < 2000 + 17 * fim.MOST


def test_query_equals_sql(spark):
    same_as_duckdb(spark, "op13_fill_in_middle", op13_fill_in_middle, f"{TESTDATA}/sf0.01")
