from __future__ import annotations

import re
import subprocess
import sys
from pathlib import Path

import corpus_pipeline
import __spark_entry__ as driver
from ledgerbeam.llm import toxicity
from ledgerbeam.llm.common import stored
from tests.llm.helpers import TESTDATA, documents, ordered, shape, table
from tests.llm.test_exact_dedup import brute as brute_copies
from tests.llm.test_jaccard_join import brute as brute_near
from tests.llm.test_packing import WORDS, check_packed
from ledgerbeam.llm.words import WordEncoder

SF = f"{TESTDATA}/sf0.001"


def test_every_operator_and_the_pipeline_are_registered():
    names = driver.queries()
    for n in range(1, 14):
        assert len([q for q in names if q.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names
    assert set(driver.oracle_sql()) <= set(names)


def test_stages_keep_what_brute_force_keeps(spark):
    docs = table(spark, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact dedup", "n-gram Jaccard join", "personal data", "best-fit packing"]

    def step(name, before):
        after = stages[name](spark, before, SF)
        if name != "best-fit packing":
            assert shape(after) == shape(before)
        return spark.createDataFrame(after.collect(), after.schema)

    def ids(df):
        return {r["doc_id"] for r in df.collect()}

    def rows(df):
        return [(r["doc_id"], r["text"]) for r in df.collect()]

    net = toxicity.fit(docs, table(spark, "labels"))
    clean = step("toxicity", docs)
    assert ids(clean) == ids(toxicity.score(docs, net).filter("predicted = 0"))

    single = step("exact dedup", clean)
    assert ids(single) == {keep for _, keep, _, _ in brute_copies(rows(clean))}
    assert dict(rows(single)).items() <= dict(rows(clean)).items()

    apart = step("n-gram Jaccard join", single)
    assert ids(apart) == {group for *_, group in brute_near(rows(single))}

    private = step("personal data", apart)
    assert ids(private) == ids(apart)
    old, new = dict(rows(apart)), dict(rows(private))
    assert any(old[i] != new[i] for i in old)
    for r in private.collect():
        assert r["n_chars"] == len(r["text"])
        assert not set(re.findall(r"\S+@\S+\w", old[r["doc_id"]])) & set(re.findall(r"\S+@\S+\w", r["text"]))

    packed = step("best-fit packing", private)
    columns = ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    found = [tuple(r[c] for c in columns) for r in packed.collect()]
    check_packed(found, WordEncoder(WORDS), new, 2048)
    whole = [tuple(r[c] for c in columns) for r in corpus_pipeline.run(spark, SF).collect()]
    assert sorted(r[:5] for r in whole) == sorted(r[:5] for r in found)


def test_stages_take_an_empty_table(spark):
    docs = table(spark, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0, name


def test_columns_with_any_names_pass_through_all_stages(spark):
    docs = documents(spark, [(1, "one text here"), (2, None), (3, "one  text here"), (4, "")])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert shape(after) == shape(docs), name
        docs = stored(after)
    assert ordered(docs, "doc_id") == [(2,), (3,)]
    assert {r["a.b"] for r in docs.collect()} == {"clash"}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_the_rest_imports_without_the_subpackage():
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith(('ledgerbeam.llm', 'corpus_pipeline')):\n"
        "            raise ModuleNotFoundError(name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert e.queries() and not [q for q in e.queries() if q.startswith('op') or q == 'pipeline']\n"
        "assert e.oracle_sql().keys() <= e.queries().keys()\n"
    )
    root = Path(driver.__file__).resolve().parent
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
