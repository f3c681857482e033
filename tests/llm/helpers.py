"""Small tables with missing, empty, long, repeated and oddly named content."""

from __future__ import annotations

import duckdb
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerbeam.llm.oracles import ORACLES

TESTDATA = "/root/testdata"
# Names that operators use for columns of their own.
CLASHING = ("row", "row_hash", "kept", "n", "key", "length", "label", "node", "score", "rank", "a.b")


def documents(spark: SparkSession, rows, clashing: bool = True) -> DataFrame:
    """``rows`` of (doc_id, text), with columns whose names clash with the operators' own."""
    df = spark.createDataFrame(list(rows), "doc_id long, text string")
    if clashing:
        df = df.withColumns({c: F.lit("clash") for c in CLASHING})
    return df.repartition(3)


def table(spark: SparkSession, name: str, sf: str = "0.001") -> DataFrame:
    return spark.read.parquet(f"{TESTDATA}/sf{sf}/{name}.parquet")


def ordered(df: DataFrame, *columns: str) -> list[tuple]:
    rows = [tuple(r[c] for c in columns) for r in df.select(*columns).collect()]
    return sorted(rows, key=lambda r: tuple((v is not None, str(type(v)), v) for v in r))


def shape(df: DataFrame) -> list[tuple]:
    return [(f.name, f.dataType.simpleString()) for f in df.schema]


def same_as_duckdb(spark, name, query, sf_dir, tables=("documents",)):
    """The registered query and its SQL give the same rows."""
    db = duckdb.connect()
    for t in tables:
        db.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    want = db.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    got = query(spark, sf_dir)
    assert sorted(got.columns) == sorted(names)

    def key(row):
        return tuple((v is not None, str(type(v)), v) for v in row)

    found = sorted((tuple(r[c] for c in names) for r in got.collect()), key=key)
    wanted = sorted(want.fetchall(), key=key)
    assert found == wanted
