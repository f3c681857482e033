"""From raw documents to packed training sequences: five stages, each one operator.

Every stage takes ``(spark, docs, sf_dir)`` and returns what it keeps as a DataFrame. All
but the last return the columns of ``docs``, whatever these are beside ``doc_id`` and
``text``. Between stages a table is written and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerbeam.llm import best_fit, exact_dedup, jaccard_join, surrogates, toxicity
from ledgerbeam.llm.common import read_table, stored
from ledgerbeam.llm.params import SURROGATE_KEY, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network does not predict to be toxic."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The longest document of each group of equal texts."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group that is linked by n-gram similarity."""
    return jaccard_join.keep_one_of_each_class(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced; ``n_chars`` follows the new text."""
    replaced = surrogates.replace_entities(docs, SURROGATE_KEY)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        known = F.when(F.col("n_chars").isNotNull(), F.length("text").cast(kind))
        replaced = replaced.withColumn("n_chars", known)
    return replaced


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in the packed sequences."""
    return best_fit.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("personal data", replace_personal_data),
    ("best-fit packing", pack),
]

# A trained network, MinHash and a tokenizer have no SQL form; tests/llm compares the
# stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
