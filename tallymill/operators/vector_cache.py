"""Vectors kept ready in blocks, with a fingerprint of the rows they come from: used again while it agrees, built anew when it doesn't."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.errors import AnalysisException

#: Vectors of a block on average.
BLOCK = 4096


def fingerprint(rows: DataFrame) -> tuple[int, int]:
    """Number and sum of hashes of (id, vector): the same for the same rows in any order."""
    n, total = rows.agg(F.count("*"), F.sum(F.xxhash64("id", "vector").cast("decimal(38,0)"))).first()
    return n, int(total or 0)


def cached(rows: DataFrame, path: str) -> tuple[DataFrame, bool]:
    """The rows (id, vector) from their blocks under a path, and whether these were there already.

    Blocks of other rows under the path stay, each set under its own fingerprint: who still reads them isn't disturbed.
    """
    spark = rows.sparkSession
    n, total = fingerprint(rows)
    place = f"{path}/{n}-{total}".replace("--", "-m")
    try:
        blocks, there = spark.read.parquet(place), True
    except AnalysisException:
        block = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n // BLOCK)))).alias("block")
        rows.groupBy(block).agg(F.array_sort(F.collect_list(F.struct("id", "vector"))).alias("vectors")).write.mode("overwrite").parquet(place)
        blocks, there = spark.read.parquet(place), False
    return blocks.select(F.explode("vectors").alias("x")).select("x.id", "x.vector"), there
