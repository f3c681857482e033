"""What several operators need: shared scratch tables, row identity, typed table readers."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it.

    Where the session names none, a folder of this machine serves if tasks run here too, as
    in tests; on a cluster it would lose rows, so that is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="ledgerbeam-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    This cuts the lineage: a lost executor costs the tasks it ran, never the whole plan,
    and numbers given to rows while writing stay as they are. The folder goes when the
    driver ends.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of a loop's state through a reliable checkpoint."""
    scratch(df.sparkSession)
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    return df.checkpoint()


_sent_to: set[str] = set()


@cache
def _packed() -> str:
    """This package as a zip file, made once by the driver."""
    package = Path(__file__).resolve().parent.parent
    path = Path(tempfile.mkdtemp(prefix="ledgerbeam-")) / f"{package.name}.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    return str(path)


def map_batches(df: DataFrame, work: Callable, schema: str | StructType) -> DataFrame:
    """``mapInArrow``, after Spark has sent this package to the executors' Python.

    Columns go there by position and get their names back inside, since a name with a dot
    would be taken for a field of a struct."""
    context = df.sparkSession.sparkContext
    if context.applicationId not in _sent_to:
        context.addPyFile(_packed())
        _sent_to.add(context.applicationId)
    names = df.columns

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return work(batch.rename_columns(names) for batch in batches)

    return df.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(named, schema)


HOT_SHARE = 4096  # a group that holds more than this part of all rows is hot


def join_groups(
    rows: DataFrame, groups: DataFrame, keys: list[str], size: str, how: str = "inner"
) -> DataFrame:
    """Give each row what ``groups`` (one row per key, ``size`` rows in each) knows of its key.

    Groups with more than 1/``HOT_SHARE`` of all rows, of which there are fewer than
    ``HOT_SHARE`` in any data, are broadcast, so their rows stay where they are; the others
    go through a shuffle, in which no key is large. ``groups`` should be a stored table, as
    its sizes are looked at first."""
    total, largest = groups.agg(F.sum(size), F.max(size)).first()
    hot = F.col(size) * HOT_SHARE > F.lit(total)
    if total is None or largest * HOT_SHARE <= total:
        return rows.join(groups, keys, how)
    large, small = groups.filter(hot), groups.filter(~hot)
    near = rows.join(F.broadcast(large), keys)
    far = rows.join(F.broadcast(large.select(*keys)), keys, "left_anti").join(small, keys, how)
    return near.unionByName(far)


def text_of(docs: DataFrame) -> Column:
    """The document's text; a missing one counts as empty."""
    return F.coalesce(docs["text"], F.lit(""))


def column(df: DataFrame, name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return df["`" + name.replace("`", "``") + "`"]


def row_hash(docs: DataFrame) -> Column:
    """With ``doc_id`` the identity of a row, also where ids are missing or repeated."""
    return F.xxhash64(docs["text"])


def rows_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``(doc_id, row_hash)`` is in ``chosen``, with the columns
    of ``docs`` alone. Texts move once, by a spread key, and are not sorted: the hash table
    is made of ``chosen``, which is narrow."""
    keys = chosen.select(
        F.col("doc_id").alias("chosen_doc_id"), F.col("row_hash").alias("chosen_row_hash")
    ).hint("shuffle_hash")
    same = docs["doc_id"].eqNullSafe(keys["chosen_doc_id"])
    return docs.join(keys, same & (row_hash(docs) == keys["chosen_row_hash"]), "left_semi")


def without_repeats(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """One of each set of rows of ``docs`` that repeat both ``doc_id`` and text.

    ``keys`` is a stored narrow table with ``doc_id`` and ``row_hash`` of each row. Tables
    seldom repeat rows, and then this costs one small job over ``keys``.
    """
    counted = keys.groupBy("doc_id", "row_hash").agg(F.count("*").alias("copies"))
    repeated = counted.filter("copies > 1").select("doc_id", "row_hash")
    if repeated.isEmpty():
        return docs
    single = counted.filter("copies = 1")
    return rows_of(docs, single).unionByName(
        rows_of(docs, repeated).dropDuplicates(["doc_id", "text"])
    )
