"""First, last and best rows of groups, with every tie broken by an explicit order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallymill.sources.files import stored


def first_per_key(rows: DataFrame, keys: list[str | Column], *order: Column | str) -> DataFrame:
    """The first row of each key. Spark drops rows that can't be first before it shuffles."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_place = 1").drop("_place")


def top_per_key(rows: DataFrame, keys: list[str | Column], k: int, *order: Column | str, rank: str = "rank") -> DataFrame:
    """The first k rows of each key and their places."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def majority(rows: DataFrame, keys: list[str], value: str, rank: str) -> DataFrame:
    """(keys, value): the most frequent value of each key; the best-ranked one among equals."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("_n"), F.min(rank).alias("_best"))
    return first_per_key(counts, keys, F.desc("_n"), "_best").select(*keys, value)


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by order, as one aggregate."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_last")).select(*keys, *[f"_last.{c}" for c in rest])


def dealt(rows: DataFrame, key: str, order: list[str], label: str = "dealt") -> DataFrame:
    """The rows, stored, with ``_part``: parts are ranges of (key, order), so a key with many rows has several, in ascending number, and a part no more than its share."""
    return stored(rows.repartitionByRange(key, *order).withColumn("_part", F.spark_partition_id()), label)


def running(parts: DataFrame, key: str, order: list[str], **sums: Column) -> DataFrame:
    """dealt rows with sums over the rows of the key up to and with this one, in order; equal rows come in any order.

    Sums of a key's earlier parts come from a small row for each part and key; inside a part only its own rows are sorted.
    """
    valued = parts.withColumns({f"_{n}": v for n, v in sums.items()})
    totals = valued.groupBy("_part", key).agg(*[F.sum(f"_{n}").alias(n) for n in sums])
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(F.col("_part").alias("_of_part"), F.col(key).alias("_of_key"), *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_before_{n}") for n in sums])
    inside = Window.partitionBy("_part", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = valued.withColumns({f"_{n}": F.sum(f"_{n}").over(inside) for n in sums})
    joined = summed.join(before, (F.col("_part") == F.col("_of_part")) & F.col(key).eqNullSafe(F.col("_of_key")))
    return joined.select(*[F.col(f"`{c}`") for c in parts.columns], *[(F.col(f"_{n}") + F.col(f"_before_{n}")).alias(n) for n in sums])


def running_sum(rows: DataFrame, key: str, order: str, value: Column) -> DataFrame:
    """rows with ``upto``: the sum of value over the rows of its key up to this one, in an order without ties. No task sorts a whole key, however its order's values lie."""
    return running(dealt(rows, key, [order]), key, [order], upto=value).drop("_part")
