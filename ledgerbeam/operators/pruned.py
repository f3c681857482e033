from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16  # of each hash; what is broadcast has at most HASHES times as many rows
HASHES = 2
TRIED = 4  # for each wanted party so many of the fullest buckets are summed exactly


def _bucket(party: Column, nth: int, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(nth), party), F.lit(buckets))


def surviving_entries(
    gl: DataFrame, party_type: str, voucher_type: str, k: int, buckets: int = BUCKETS
) -> DataFrame:
    """(party, credit) of the entries whose party may be among the ``k`` with the highest
    credits; no entry of a party that is among them is missing.

    Two jobs find out. The first sums the positive credits by bucket of the party's hash:
    no party's total is higher than that of any bucket it is in, whatever its negative
    credits. The second sums all parties in the fullest buckets exactly; the ``k``-th total
    there is one that no party below can do without. Parties with a bucket of less are left
    out. Where fewer than ``k`` parties have a total, or most buckets remain, nothing is.
    """
    entries = gl.filter(
        (F.col("party_type") == party_type) & (F.col("voucher_type") == voucher_type)
    ).select("party", "credit")
    places = F.array(
        *(
            F.struct(F.lit(n).alias("nth"), _bucket(F.col("party"), n, buckets).alias("bucket"))
            for n in range(HASHES)
        )
    )
    sums = (
        entries.select(F.greatest("credit", F.lit(0)).alias("credit"), F.explode(places).alias("at"))
        .groupBy("at.nth", "at.bucket")
        .agg(F.sum("credit").alias("most"))
        .collect()  # at most HASHES * BUCKETS rows of three numbers
    )
    first = sorted((r for r in sums if r["nth"] == 0), key=lambda r: (-r["most"], r["bucket"]))
    fullest = [r["bucket"] for r in first[: TRIED * k]]
    totals = (
        entries.filter(_bucket(F.col("party"), 0, buckets).isin(fullest))
        .groupBy("party")
        .agg(F.sum("credit").alias("total"))
        .filter("total IS NOT NULL")
        .orderBy(F.col("total").desc())
        .limit(k)
        .collect()
    )
    if len(totals) < k:
        return entries
    bound = totals[-1]["total"]
    left = [[r["bucket"] for r in sums if r["nth"] == n and r["most"] >= bound] for n in range(HASHES)]
    if min(map(len, left)) * 2 > buckets:
        return entries
    spark = gl.sparkSession

    def kept(rows: DataFrame, n: int) -> DataFrame:
        some = spark.createDataFrame(pa.table({"bucket": pa.array(left[n], pa.int64())}))
        return rows.join(F.broadcast(some), _bucket(rows["party"], n, buckets) == some["bucket"], "left_semi")

    return reduce(kept, range(HASHES), entries)


def top_parties_pruned(
    gl: DataFrame, party_type: str, voucher_type: str, k: int = 5, buckets: int = BUCKETS
) -> DataFrame:
    """``top_parties`` for ledgers with very many parties: the same rows.

    The ledger is read three times; only entries of parties that may be among the first
    are grouped by party. Ties go to the name that sorts first, entries without a party
    are one party, and one without any amount comes last, as there.
    """
    return (
        surviving_entries(gl, party_type, voucher_type, k, buckets)
        .groupBy(F.col("party").alias("customer"))
        .agg(F.sum("credit").alias("total_annual"))
        .orderBy(F.col("total_annual").desc_nulls_last(), F.col("customer").asc_nulls_last())
        .limit(k)
    )
