from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top_parties(gl: DataFrame, party_type: str, voucher_type: str, k: int = 5) -> DataFrame:
    """The ``k`` parties with the highest credits, over all dates.

    Ties go to the party whose name sorts first. Entries without a party count as one
    party of their own.
    """
    return (
        gl.filter((F.col("party_type") == party_type) & (F.col("voucher_type") == voucher_type))
        .groupBy(F.col("party").alias("customer"))
        .agg(F.sum("credit").alias("total_annual"))
        .orderBy(F.col("total_annual").desc_nulls_last(), F.col("customer").asc_nulls_last())
        .limit(k)
    )
