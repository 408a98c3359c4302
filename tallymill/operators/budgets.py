"""Running costs against a budget that begins anew once it is exceeded: each row depends on where the last budget ended.

Where a budget that begins at a row would end follows from running sums alone: at the first row up to which more than the budget has been
spent since. So every row knows where the next budget would begin if one began with it, and the budgets that do begin are those on the
way from a key's first row. That way is found by doubling: a step's target and the target's own step make a step twice as far, and rows
reached so far reach as many again. A key takes rounds for the logarithm of its budgets, and its rows are dealt over tasks throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tallymill.operators.ranking import dealt, running
from tallymill.sources.files import drop, stored


def _first_beyond(rows: DataFrame, budget: int) -> DataFrame:
    """(_k, at, ends): for each row of (_k, at, spent, before) the first row of its key up to which more than before + budget is spent; null where there is none."""
    ends = rows.select("_k", F.col("spent").alias("v"), F.lit(0).alias("kind"), "at")
    asks = rows.select("_k", (F.col("before") + budget).alias("v"), F.lit(1).alias("kind"), "at")
    # a row with exactly the value asked for comes before the question, so what follows has more
    order = ["v", "kind", "at"]
    parts = dealt(ends.unionByName(asks), "_k", order, "beyond")
    here = F.min(F.when(F.col("kind") == 0, F.col("at")))
    firsts = parts.groupBy("_part", "_k").agg(here.alias("first"))
    later = Window.partitionBy("_k").orderBy("_part").rowsBetween(1, Window.unboundedFollowing)
    after = firsts.select("_part", "_k", F.min("first").over(later).alias("after"))
    inside = Window.partitionBy("_part", "_k").orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    found = parts.withColumn("inside", here.over(inside)).where("kind = 1").join(after, ["_part", "_k"])
    return found.select("_k", "at", F.coalesce("inside", "after").alias("ends"))


def _begins(rows: DataFrame, budget: int) -> DataFrame:
    """(_k, at) of the rows at which a budget begins, of rows (_k, at, spent, before)."""
    steps = stored(_first_beyond(rows, budget).where("ends is not null").select("_k", F.col("at").alias("src"), (F.col("ends") + 1).alias("to")), "steps")
    reached = stored(rows.where("at = 1").select("_k", "at"), "reached")
    while True:
        new = reached.join(steps, (reached["_k"] == steps["_k"]) & (F.col("at") == F.col("src"))).select(reached["_k"], F.col("to").alias("at"))
        more = stored(reached.unionByName(new), "reached")
        if more.count() == reached.count():
            drop(steps, reached)
            return more
        onward = steps.select("_k", F.col("src").alias("to"), F.col("to").alias("further"))
        twice = stored(steps.join(onward, ["_k", "to"]).select("_k", "src", F.col("further").alias("to")), "steps")
        drop(steps, reached)
        steps, reached = twice, more


def running_cost(rows: DataFrame, key: str, order: list[str], cost: str, budget: int) -> DataFrame:
    """rows with ``spent``: the cost so far of the row's key, in an order without ties; at a row before which more than the budget was spent it begins anew.

    Costs are whole numbers of 0 or more, null counts as 0; a null key is a key. A negative cost is an error, for then what is spent can fall.
    """
    amount = F.coalesce(F.col(cost), F.lit(0)).cast("long")
    checked = F.when(amount < 0, F.raise_error(F.lit("a cost below 0"))).otherwise(amount)
    parts = dealt(rows.withColumn("_k", F.struct(key)).withColumn("_cost", checked), "_k", order, "costs")
    whole = stored(running(parts, "_k", order, at=F.lit(1), _sum=F.col("_cost")).drop("_part"), "costs")
    plain = whole.select("_k", "at", F.col("_sum").alias("spent"), (F.col("_sum") - F.col("_cost")).alias("before"))
    begins = _begins(plain, budget)
    # what was spent before a budget began grows from one to the next, so the last begin is the highest
    marked = whole.join(begins.withColumn("_begins", F.lit(True)), ["_k", "at"], "left").withColumn("_mark", F.when(F.col("_begins"), F.col("_sum") - F.col("_cost")))
    again = dealt(marked, "_k", ["at"], "marked")
    drop(begins)
    tops = again.groupBy("_part", "_k").agg(F.max("_mark").alias("top"))
    earlier = Window.partitionBy("_k").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    above = tops.select("_part", "_k", F.max("top").over(earlier).alias("_above"))
    inside = Window.partitionBy("_part", "_k").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    out = again.withColumn("_here", F.max("_mark").over(inside)).join(above, ["_part", "_k"])
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("_sum") - F.greatest("_here", "_above")).alias("spent"))
