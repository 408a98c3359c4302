"""Stored model replies about scanned pages as line items, and the reader that a file type asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallymill.functions import amounts as A, text as T

#: Shape of a reply, as the model is asked to give it; values are read as text, whatever their JSON type. Fixed values.
REPLY = "page_results array<struct<page_number string, page_type string, scale_factor string, items array<struct<description string, amount string, section string, ambiguity_question string>>>>"
SKIPPED_PAGES = ["auditor_report", "other_non_financial"]
READERS = {"xlsx": "workbook", "xls": "workbook", "pdf": "pages"}
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def without_fence(reply: Column) -> Column:
    """The reply without the code fence that may stand around it."""
    text = T.strip(reply)
    inner = T.strip(F.regexp_replace(F.regexp_replace(text, r"^```(?:json)?\s*\n?", ""), r"\n?```\s*$", ""))
    return F.when(text.startswith("```"), inner).otherwise(text)


def reply_items(replies: DataFrame, keys: list[str], reply: str = "reply") -> DataFrame:
    """(keys, page, place, description, amount, section, raw_text, page_type, ambiguity_question): a row for each usable item of each reply, page and place by position.

    Pages that are not financial give no rows, neither do items without a description or a number for an amount, nor replies that are null
    or no JSON of this shape. Amounts come out in units, whatever the scale of their page.
    """
    parsed = F.from_json(without_fence(F.col(reply)), REPLY)["page_results"]
    pages = replies.select(*keys, F.posexplode(parsed).alias("page", "p")).where(~F.coalesce(F.col("p.page_type"), F.lit("")).isin(SKIPPED_PAGES))
    items = pages.select(*keys, "page", "p", F.posexplode("p.items").alias("place", "x")).withColumn("description", T.strip(F.col("x.description")))
    usable = items.where((F.col("description") != "") & F.rlike(F.col("x.amount"), F.lit(_NUMBER)))
    question = T.strip(F.col("x.ambiguity_question"))
    return usable.select(
        *keys,
        "page",
        "place",
        "description",
        (F.col("x.amount").cast("double") * A.scale(F.col("p.scale_factor"))).alias("amount"),
        F.coalesce(F.lower(T.strip(F.col("x.section"))), F.lit("")).alias("section"),
        F.concat(F.lit("[Page "), F.coalesce("p.page_number", F.lit("?")), F.lit("] "), "description", F.lit("  "), "x.amount").alias("raw_text"),
        T.page_type(F.col("p.page_type")).alias("page_type"),
        F.when(question != "", question).alias("ambiguity_question"),
    )


def with_reader(files: DataFrame, file_type: str = "file_type") -> DataFrame:
    """files with ``reader``, by the file type in any case, and ``error`` where there is none for it: one bad file stops no others."""
    low = F.lower(F.col(file_type))
    reader = F.coalesce(*[F.when(low == t, r) for t, r in READERS.items()])
    message = F.concat(F.lit("Unsupported file type: '"), F.coalesce(low, F.lit("")), F.lit(f"'. Must be one of: {', '.join(READERS)}."))
    return files.withColumn("reader", reader).withColumn("error", F.when(reader.isNull(), message))
