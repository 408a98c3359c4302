"""Rules added to a specialist's text one after another; every earlier text stays readable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallymill.operators.ranking import running_sum

#: Who has a text to add rules to. Fixed values.
SPECIALISTS = ["pl_income", "pl_expense", "bs_liability", "bs_asset"]


def rule_line(pattern: Column, row: Column, tag: str = "CA_VERIFIED_2026") -> Column:
    """The line that a rule adds."""
    return F.concat(F.lit(f'- **[{tag}]** If source text matches "'), pattern, F.lit('", classify to Row '), row.cast("string"), F.lit("."))


def promoted(rules: DataFrame, order: str, specialist: str = "specialist") -> DataFrame:
    """rules with ``version``: how many rules its specialist's text has with this one, by a whole-number order without ties; and ``error`` for unknown specialists, whose rules get no version.

    A version's text is the base and the lines up to its number, so an archive is these rows and no copy of a growing text.
    """
    known = F.coalesce(F.col(specialist).isin(SPECIALISTS), F.lit(False))
    counted = running_sum(rules.withColumn("_who", F.coalesce(specialist, F.lit(""))), "_who", order, F.when(known, 1).otherwise(0)).drop("_who")
    return counted.withColumn("version", F.when(known, F.col("upto"))).drop("upto").withColumn("error", F.when(~known, F.concat(F.lit("Unknown specialist: "), F.coalesce(specialist, F.lit("")))))


def text_at(base: DataFrame, rules: DataFrame, version: int) -> DataFrame:
    """(specialist, text) as it was at a version: base (specialist, text) and the lines of promoted rules up to it."""
    lines = rules.where(F.col("version") <= version).groupBy("specialist").agg(F.array_sort(F.collect_list(F.struct("version", "line"))).alias("x"))
    return base.join(lines, "specialist", "left").select("specialist", F.array_join(F.concat(F.array("text"), F.coalesce(F.transform("x", lambda r: r["line"]), F.array().cast("array<string>"))), "\n\n").alias("text"))
