"""The nearest amount within a tolerance, without bands that could fill up: both sides are sorted together, and a value looks at the last one before and the first one after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallymill.operators.ranking import dealt


def nearest_amount(left: DataFrame, right: DataFrame, by: str, tolerance: float) -> DataFrame:
    """(by, amount, near_id, near_amount): for each different amount of left (by, amount) the nearest of right (by, id, amount) that is no further from it than the share ``tolerance`` of it.

    Of two as near the one with the smaller id; of equal amounts the smallest id. Amounts without such a neighbour, null amounts and null keys are
    left out. Amounts are whole or decimal numbers, so that distances are exact. A key with many amounts is dealt over several parts.
    """
    known = right.where(F.col("amount").isNotNull() & F.col(by).isNotNull()).groupBy(by, "amount").agg(F.min("id").alias("id"))
    asked = left.where(F.col("amount").isNotNull() & F.col(by).isNotNull()).select(by, "amount").distinct()
    rows = known.select(by, "amount", "id", F.lit(0).alias("kind")).unionByName(asked.select(by, "amount", F.lit(None).cast(known.schema["id"].dataType).alias("id"), F.lit(1).alias("kind")))
    order = ["amount", "kind"]
    parts = dealt(rows, by, order, "amounts")
    value = F.when(F.col("kind") == 0, F.struct(F.col("amount").alias("v"), "id"))
    ends = parts.groupBy("_part", by).agg(F.max(value).alias("high"), F.min(value).alias("low"))
    along = Window.partitionBy(by).orderBy("_part")
    around = ends.select("_part", by, F.max("high").over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_high"), F.min("low").over(along.rowsBetween(1, Window.unboundedFollowing)).alias("_low"))
    inside = Window.partitionBy("_part", by).orderBy(*order)
    # shuffled before value is made, which would go along with every row
    found = parts.repartition("_part", by).withColumn("below", F.max(value).over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn("above", F.min(value).over(inside.rowsBetween(1, Window.unboundedFollowing)))
    found = found.where("kind = 1").join(around, ["_part", by]).select(by, "amount", F.coalesce("below", "_high").alias("below"), F.coalesce("above", "_low").alias("above"))
    away = lambda side: F.when(F.col(side).isNotNull(), F.struct(F.abs(F.col(f"{side}.v") - F.col("amount")).alias("d"), F.col(f"{side}.id").alias("id"), F.col(f"{side}.v").alias("v")))
    best = found.withColumn("best", F.least(away("below"), away("above")))
    within: Column = F.col("best.d") <= F.lit(str(tolerance)).cast("decimal(10,6)") * F.abs("amount")
    return best.where(within).select(by, "amount", F.col("best.id").alias("near_id"), F.col("best.v").alias("near_amount"))
