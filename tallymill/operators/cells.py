"""Report cells: conversion, grouping, provenance, and the questions that corrections raise."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallymill.functions import amounts as A


def placed(items: DataFrame, fields: DataFrame, first: DataFrame, out_unit: str = "lakhs") -> DataFrame:
    """Items with their row (its own, or that of the field's name), their year's column counted from the client's first year, and their amount in the output unit; items without a row or column are left out.

    items: client_id, document_id, line_no, part_id, cma_row, field_name, financial_year, source_unit, amount. first: client_id, base.
    """
    by_name = fields.select(F.col("name").alias("field_name"), F.col("cma_row").alias("named_row"))
    rows = items.join(by_name, "field_name", "left").join(first, "client_id")
    row = F.coalesce(F.nullif(F.col("cma_row"), F.lit(0)), F.col("named_row"))
    out = rows.select("client_id", "document_id", "line_no", "part_id", row.alias("cma_row"), A.year_column(F.col("financial_year"), F.col("base")).alias("col"), "financial_year", "amount", A.converted(F.col("amount"), F.col("source_unit"), out_unit).alias("converted"))
    return out.where("cma_row is not null and col is not null")


def fill(rows: DataFrame) -> DataFrame:
    """(client_id, cma_row, col, n, total, formula): amounts are rounded one by one before they are put together, in the order of their documents."""
    x = F.array_sort(F.collect_list(F.struct("document_id", "line_no", "part_id", "converted")))
    cells = rows.groupBy("client_id", "cma_row", "col").agg(F.count("*").alias("n"), F.sum("converted").cast("double").alias("total"), x.alias("x"))
    formula = F.when(F.col("n") > 1, A.formula(F.transform("x", lambda i: A.number_token(i["converted"]))))
    return cells.select("client_id", "cma_row", "col", "n", "total", formula.alias("formula"))


def cell_diff(made: DataFrame, fixed: DataFrame, keys: list[str]) -> DataFrame:
    """Cells (keys, v) that differ between two versions, with both values."""
    both = made.withColumnRenamed("v", "made").join(fixed.withColumnRenamed("v", "corrected"), keys, "full")
    return both.where(~A.equal_absolute(F.col("made"), F.col("corrected")))


def questions(differences: DataFrame, sources: DataFrame, keys: list[str]) -> DataFrame:
    """A question for each difference: its cell, what stands behind it, and three options to answer with."""
    options = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(t).alias("text")) for k, t in (("A", "one-off"), ("B", "new rule"), ("C", "other row"))])
    behind = sources.groupBy(*keys).agg(F.array_sort(F.collect_set("document_id")).alias("sources"))
    joined = differences.join(behind, keys, "left")
    return joined.select(*keys, F.col("made").cast("double").alias("made"), F.col("corrected").cast("double").alias("corrected"), F.coalesce("sources", F.array().cast("array<bigint>")).alias("sources"), options.alias("options"))
