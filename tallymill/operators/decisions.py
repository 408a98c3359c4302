"""What reviewers decide about classifications, and all the traces that it leaves: statuses, learned mappings, proposed rules, an audit trail."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallymill.operators.ranking import last_wins

#: What a decision makes of a status. Fixed values.
STATUSES = {"approve": "approved", "correct": "corrected"}


def traces(rows: DataFrame, keys: list[str], mappings: DataFrame) -> DataFrame:
    """(trace, subject, cma_row, detail, n) of the decisions in rows (keys, text, cma_row, decision, said, at).

    status: the subject is a row's keys, the detail its new status, cma_row what it is classified as now; rows without a decision have none.
    mapping: (source_text, cma_row) with the times it was used, those of mappings (source_text, cma_row, times_used) and one for each decision.
    rule: what corrections say of a text, the last of them by ``at``. audit: a row for each decision, with what was before.
    """
    known = F.element_at(F.create_map(*[F.lit(x) for pair in STATUSES.items() for x in pair]), F.col("decision"))
    made = rows.where(F.col("decision").isin(*STATUSES)).withColumn("subject", F.concat_ws("-", *[F.col(k).cast("string") for k in keys]))
    made = made.withColumn("now", F.when(F.col("decision") == "correct", F.col("said")).otherwise(F.col("cma_row"))).withColumn("text", F.lower("text"))
    row = lambda trace, subject, value, detail, n: [F.lit(trace).alias("trace"), subject.alias("subject"), value.cast("int").alias("cma_row"), detail.cast("string").alias("detail"), n.cast("long").alias("n")]
    one, none = F.lit(1), F.lit(None)
    status = made.select(*row("status", F.col("subject"), F.col("now"), known, one))
    used = mappings.select(F.col("source_text").alias("text"), F.col("cma_row").alias("now"), "times_used").unionByName(made.select("text", "now", F.lit(1).cast("long").alias("times_used")))
    mapping = used.groupBy("text", "now").agg(F.sum("times_used").alias("n")).select(*row("mapping", F.col("text"), F.col("now"), none, F.col("n")))
    corrected = made.where(F.col("decision") == "correct").select("text", "now", F.struct("at", "subject").alias("o"))
    rule = last_wins(corrected, ["text"], "o").select(*row("rule", F.col("text"), F.col("now"), none, one))
    audit = made.select(*row("audit", F.col("subject"), F.col("cma_row"), F.col("decision"), one))
    return status.unionByName(mapping).unionByName(rule).unionByName(audit)
