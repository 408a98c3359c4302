"""The relations of the line-item model, derived from the test tables; each as a DataFrame and as a CTE for DuckDB."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

DEC = "decimal(12,2)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, industry_type, balance."""
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lower("c_mktsegment").alias("industry_type"), F.col("c_acctbal").cast(DEC).alias("balance"))


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the model: id, client_id, financial_year, nature, source_unit, file_type, status, uploaded_by, uploaded_at."""
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.col("o_orderkey") % n + 1).cast("int"))
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("client_id"),
        F.year("o_orderdate").alias("financial_year"),
        F.when(F.col("o_orderstatus") == "F", "audited").when(F.col("o_orderstatus") == "O", "provisional").otherwise("other").alias("nature"),
        pick(["rupees", "thousands", "lakhs", "crores"], 4).alias("source_unit"),
        pick(["pdf", "xlsx", "xls"], 3).alias("file_type"),
        pick(["pending", "processing", "extracted", "verified", "failed"], 5).alias("status"),
        (F.col("o_custkey") % 10).alias("uploaded_by"),
        F.col("o_orderdate").alias("uploaded_at"),
    )


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, ord, source_text, amount, section, sheet, part_id, supplier_id, qty. No key is unique; ord orders the rows of a document."""
    lines, parts = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return lines.join(parts, "l_partkey").select(
        F.col("l_orderkey").alias("document_id"),
        F.struct(F.col("l_linenumber").alias("a"), F.col("l_partkey").alias("b"), F.col("l_suppkey").alias("c"), F.col("l_extendedprice").cast(DEC).alias("d")).alias("ord"),
        F.col("p_name").alias("source_text"),
        F.col("l_extendedprice").cast(DEC).alias("amount"),
        F.col("l_returnflag").alias("section"),
        F.when(F.col("l_linestatus") == "F", "Notes BS (2)").otherwise("P & L").alias("sheet"),
        F.col("l_partkey").alias("part_id"),
        F.col("l_suppkey").alias("supplier_id"),
        F.col("l_quantity").cast(DEC).alias("qty"),
    )


def classifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, line_no, part_id, cma_row, confidence, is_doubt, status, amount, reviewer."""
    confidence = (F.lit(1).cast("decimal(4,2)") - 3 * F.col("l_discount").cast("decimal(4,2)")).cast("decimal(6,2)")
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (22 + F.col("l_partkey") % 237).cast("int").alias("cma_row"), confidence.alias("confidence"), F.col("l_extendedprice").cast(DEC).alias("amount"), (F.col("l_suppkey") % 7).alias("reviewer"))
    doubt = F.col("confidence") < 0.80
    status = F.when(doubt, "needs_review").when(F.col("confidence") >= 0.85, "approved").otherwise("auto_classified")
    return rows.select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("line_no"), F.col("l_partkey").alias("part_id"), "cma_row", "confidence", doubt.alias("is_doubt"), status.alias("status"), "amount", "reviewer")


def mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned mappings: source_text, cma_row, times_used; one for each text, the last part's."""
    rows = read(spark, sf_dir, "part")
    return rows.groupBy(F.lower("p_name").alias("source_text")).agg(F.max_by((F.col("p_partkey") % 260).cast("int"), "p_partkey").alias("cma_row"), F.count("*").alias("times_used"))


def fields(spark: SparkSession, sf_dir: str | None = None) -> DataFrame:
    """The field dimension: cma_row, name, for all but every tenth row."""
    rows = spark.range(22, 259).select(F.col("id").cast("int").alias("cma_row"))
    return rows.where(F.col("cma_row") % 10 != 9).select("cma_row", F.concat(F.lit("Field "), F.lpad(F.col("cma_row").cast("string"), 3, "0")).alias("name"))


_PICK = "[{}][o_orderkey % {} + 1]"
#: Fixed order: a relation uses only tables.
RELATIONS: dict[str, str] = {
    "clients": "SELECT c_custkey AS id, c_name AS name, lower(c_mktsegment) AS industry_type, c_acctbal::DECIMAL(12,2) AS balance FROM customer",
    "statements": """SELECT o_orderkey AS id, o_custkey AS client_id, year(o_orderdate)::INTEGER AS financial_year, CASE o_orderstatus WHEN 'F' THEN 'audited' WHEN 'O' THEN 'provisional' ELSE 'other' END AS nature,
      ['rupees','thousands','lakhs','crores'][o_orderkey % 4 + 1] AS source_unit, ['pdf','xlsx','xls'][o_orderkey % 3 + 1] AS file_type, ['pending','processing','extracted','verified','failed'][o_orderkey % 5 + 1] AS status, o_custkey % 10 AS uploaded_by, o_orderdate AS uploaded_at FROM orders""",
    "line_items": """SELECT l_orderkey AS document_id, l_linenumber AS oa, l_partkey AS ob, l_suppkey AS oc, l_extendedprice::DECIMAL(12,2) AS od, p_name AS source_text, l_extendedprice::DECIMAL(12,2) AS amount, l_returnflag AS section,
      CASE l_linestatus WHEN 'F' THEN 'Notes BS (2)' ELSE 'P & L' END AS sheet, l_partkey AS part_id, l_suppkey AS supplier_id, l_quantity::DECIMAL(12,2) AS qty FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "classifications": """SELECT *, confidence < 0.80 AS is_doubt, CASE WHEN confidence < 0.80 THEN 'needs_review' WHEN confidence >= 0.85 THEN 'approved' ELSE 'auto_classified' END AS status FROM (SELECT l_orderkey AS document_id, l_linenumber AS line_no, l_partkey AS part_id,
      (22 + l_partkey % 237)::INTEGER AS cma_row, (1 - 3 * l_discount::DECIMAL(4,2))::DECIMAL(6,2) AS confidence, l_extendedprice::DECIMAL(12,2) AS amount, l_suppkey % 7 AS reviewer FROM lineitem)""",
    "mappings": "SELECT lower(p_name) AS source_text, max_by((p_partkey % 260)::INTEGER, p_partkey) AS cma_row, count(*) AS times_used FROM part GROUP BY lower(p_name)",
    "fields": "SELECT r::INTEGER AS cma_row, 'Field ' || lpad(r::VARCHAR, 3, '0') AS name FROM range(22, 259) t(r) WHERE r % 10 <> 9",
}


def with_relations(sql: str) -> str:
    """SQL with the CTEs of the relations that it names in front."""
    used = [f"{n} AS ({q})" for n, q in RELATIONS.items() if re.search(rf"\b{n}\b", sql)]
    if not used:
        return sql
    head = "WITH " + ",\n".join(used)
    return head + (",\n" + sql.strip()[5:] if sql.strip().upper().startswith("WITH ") else "\n" + sql)


Relation = Callable[[SparkSession, str], DataFrame]
