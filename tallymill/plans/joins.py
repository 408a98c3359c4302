"""Joins, keyed changes and set operations."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tallymill.functions import amounts as A
from tallymill.operators import writes
from tallymill.operators.ranking import first_per_key, last_wins
from tallymill.operators.upserts import insert_absent, update_by_key, upsert_counts
from tallymill.plans.base import query
from tallymill.sources import replies
from tallymill.sources.files import new_path, read_csv, write_csv, write_json
from tallymill.sources.relations import classifications, clients, fields, line_items, mappings, read, statements


@query("a1_table_scan", "SELECT id, name FROM clients WHERE industry_type = 'building'")
def a1(spark, sf_dir):
    return clients(spark, sf_dir).where("industry_type = 'building'").select("id", "name")


@query("a2_point_lookup", "SELECT id, name FROM clients WHERE id = 7")
def a2(spark, sf_dir):
    return clients(spark, sf_dir).where("id = 7").select("id", "name").limit(2)


@query("a3_in_list", "SELECT id, name FROM clients WHERE id IN (SELECT client_id FROM statements WHERE id % 97 = 0)")
def a3(spark, sf_dir):
    wanted = statements(spark, sf_dir).where("id % 97 = 0").select(F.col("client_id").alias("id"))
    return clients(spark, sf_dir).join(wanted, "id", "left_semi").select("id", "name")


@query("a4_full_scan", "SELECT document_id, count(*) AS n FROM line_items GROUP BY document_id")
def a4(spark, sf_dir):
    return line_items(spark, sf_dir).groupBy("document_id").agg(F.count("*").alias("n"))


@query("a7_merged_cells", "SELECT l_orderkey, l_linenumber, l_partkey, first_value(p) OVER (PARTITION BY l_orderkey, (l_linenumber - 1) // 3 ORDER BY l_linenumber, l_partkey, l_suppkey, p) AS value FROM (SELECT *, l_extendedprice::DECIMAL(12,2)::DOUBLE AS p FROM lineitem)")
def a7(spark, sf_dir):
    # a merged range spans three rows and shows the value of its first cell in all of them
    cells = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").cast("decimal(12,2)").cast("double").alias("p"), F.floor((F.col("l_linenumber") - 1) / 3).alias("range"))
    head = Window.partitionBy("l_orderkey", "range").orderBy("l_linenumber", "l_partkey", "l_suppkey", "p")
    return cells.select("l_orderkey", "l_linenumber", "l_partkey", F.first("p").over(head).alias("value"))


@query("a8_typed_cells", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN round(o_totalprice::DECIMAL(14,2), 0)::BIGINT::VARCHAR WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN CASE WHEN o_orderkey % 8 = 2 THEN 'true' ELSE 'false' END END AS cell FROM orders")
def a8(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    cell = F.when(k == 0, F.round(F.col("o_totalprice").cast("decimal(14,2)"), 0).cast("bigint").cast("string")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 2, (F.col("o_orderkey") % 8 == 2).cast("string"))
    return read(spark, sf_dir, "orders").select("o_orderkey", cell.alias("cell"))


_REPLY_LINES = "SELECT *, coalesce(CASE WHEN ob % 8 <> 0 THEN amount::VARCHAR END, 'n/a') AS raw, CASE document_id % 4 WHEN 0 THEN 'face' WHEN 1 THEN 'notes' ELSE 'unknown' END AS page_type, CASE document_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 100000 WHEN 3 THEN 10000000 ELSE 1 END AS factor FROM line_items WHERE document_id % 4 <> 2 AND document_id % 11 <> 5 AND ob % 9 <> 0"


@query("a9_reply_items", f"SELECT document_id, trim(source_text) AS description, (raw::DOUBLE * factor)::DOUBLE AS amount, lower(section) AS section, '[Page ' || (document_id % 3 + 1) || '] ' || trim(source_text) || '  ' || raw AS raw_text, page_type FROM ({_REPLY_LINES}) WHERE raw <> 'n/a'")
def a9(spark, sf_dir):
    # replies about a page for each document: some fenced, some cut off, some items without a description or a number
    doc = F.col("document_id")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (doc % n + 1).cast("int"))
    description = F.when(F.col("ord.b") % 9 == 0, "  ").otherwise(F.concat(F.lit(" "), "source_text"))
    amount = F.when(F.col("ord.b") % 8 == 0, "n/a").otherwise(F.col("amount").cast("string"))
    items = line_items(spark, sf_dir).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct(description.alias("description"), amount.alias("amount"), "section"))).alias("items"))
    page = F.struct((doc % 3 + 1).alias("page_number"), pick(["balance_sheet", "schedules", "auditor_report", "cover"], 4).alias("page_type"), pick(["absolute", "in_thousands", "in_lakhs", "in_crores", "furlongs"], 5).alias("scale_factor"), "items")
    json = F.to_json(F.struct(F.array(page).alias("page_results")))
    reply = F.when(doc % 11 == 5, F.concat(F.lit("No "), json)).when(doc % 3 == 0, F.concat(F.lit("```json\n"), json, F.lit("\n```"))).otherwise(json)
    return replies.reply_items(items.select("document_id", reply.alias("reply")), ["document_id"]).select("document_id", "description", "amount", "section", "raw_text", "page_type")


@query("a12_readers", "SELECT id, CASE t WHEN 'pdf' THEN 'pages' WHEN 'docx' THEN NULL ELSE 'workbook' END AS reader, CASE WHEN t = 'docx' THEN 'Unsupported file type: ''docx''. Must be one of: xlsx, xls, pdf.' END AS error FROM (SELECT id, CASE WHEN id % 7 = 0 THEN 'docx' ELSE file_type END AS t FROM statements)")
def a12(spark, sf_dir):
    file_type = F.when(F.col("id") % 7 == 0, "docx").when(F.col("id") % 2 == 0, F.upper("file_type")).otherwise(F.col("file_type"))
    return replies.with_reader(statements(spark, sf_dir).select("id", file_type.alias("file_type"))).select("id", "reader", "error")


@query("a10_json_items", "SELECT event_id, json_extract(props, '$.k')::INTEGER AS k FROM events")
def a10(spark, sf_dir):
    # a payload is a list, or an object with a list of items
    wrapped = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("["), "props", F.lit("]"))).otherwise(F.concat(F.lit('{"items":['), "props", F.lit("]}")))
    items = F.coalesce(F.when(wrapped.startswith("["), F.from_json(wrapped, "array<struct<k:int>>")), F.from_json(wrapped, "items array<struct<k:int>>")["items"])
    return read(spark, sf_dir, "events").select("event_id", F.explode(items).alias("i")).select("event_id", "i.k")


@query("a11_reference_rows", "SELECT document_id, oa, ob, oc, source_text FROM line_items WHERE ob % 4 <> 0 AND oa > 1")
def a11(spark, sf_dir):
    number = F.when(F.col("ord.b") % 4 == 0, "n/a").otherwise((F.col("ord.a") - 1).cast("string"))
    rows = line_items(spark, sf_dir).withColumn("c0", number)
    return rows.where((F.expr("try_cast(c0 as double)") > 0) & (F.trim("source_text") != "")).select("document_id", F.col("ord.a").alias("oa"), F.col("ord.b").alias("ob"), F.col("ord.c").alias("oc"), "source_text")


@query("a13_upload_check", "SELECT id, file_type IN ('pdf', 'xlsx') AND financial_year BETWEEN 1990 AND 2100 AND id % 4 <> 3 AS ok FROM statements")
def a13(spark, sf_dir):
    content = F.when(F.col("id") % 4 == 3, F.lit("oops").cast("binary")).when(F.col("file_type") == "pdf", F.lit("%PDF-1.7").cast("binary")).otherwise(F.lit("PK\x03\x04").cast("binary"))
    magic = F.hex(F.substring(content, 1, 4))
    good = ((F.col("file_type") == "pdf") & (magic == "25504446")) | ((F.col("file_type") == "xlsx") & (magic == "504B0304"))
    return statements(spark, sf_dir).select("id", (good & F.col("financial_year").between(1990, 2100) & (F.length(content) <= 50 * 1024 * 1024)).alias("ok"))


#: Buckets of a stored table of the test's size.
BUCKETS = 8


@query("a14_append", "SELECT id, status, 'base' AS part FROM statements UNION ALL SELECT id, status, 'more' FROM statements WHERE id % 10 = 0")
def a14(spark, sf_dir):
    base, path = statements(spark, sf_dir).select("id", "status", F.lit("base").alias("part")), new_path(spark, "append")
    writes.create(base, path, "id", BUCKETS)
    writes.append(base.where("id % 10 = 0").withColumn("part", F.lit("more")), path, "id", BUCKETS)
    return writes.rows_of(spark, path)


@query("a15_replace_groups", "SELECT document_id, count(*) AS n, sum(CASE WHEN document_id % 10 = 0 THEN 0 ELSE amount END)::DOUBLE AS total FROM line_items GROUP BY document_id")
def a15(spark, sf_dir):
    base, path = line_items(spark, sf_dir).select("document_id", "amount"), new_path(spark, "replace")
    writes.create(base, path, "document_id", BUCKETS)
    again = base.where("document_id % 10 = 0").withColumn("amount", F.lit(0).cast("decimal(12,2)"))
    for _ in range(2):  # running it again changes nothing
        writes.replace(again, path, "document_id", BUCKETS)
    return writes.rows_of(spark, path).groupBy("document_id").agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("total"))


@query("a16_update_by_key", "SELECT id, CASE WHEN id % 6 = 0 THEN 'verified' ELSE status END AS status FROM statements")
def a16(spark, sf_dir):
    base = statements(spark, sf_dir).select("id", "status")
    return update_by_key(base, base.where("id % 6 = 0").withColumn("status", F.lit("verified")), ["id"])


@query("a17_compare_and_set", "WITH x AS (SELECT id, status, id % 2 = 0 AND status IN ('pending', 'failed') AS hit FROM statements) SELECT id, CASE WHEN hit THEN 'processing' ELSE status END AS status, (SELECT count(*) FROM x WHERE hit) AS n_first, 0::BIGINT AS n_second FROM x")
def a17(spark, sf_dir):
    path = new_path(spark, "set")
    writes.create(statements(spark, sf_dir).select("id", "status"), path, "id", BUCKETS)
    condition = (F.col("id") % 2 == 0) & F.col("status").isin("pending", "failed")
    first, second = (writes.compare_and_set(spark, path, condition, "status", F.lit("processing")) for _ in range(2))  # the second comes too late
    return writes.rows_of(spark, path).select("id", "status", F.lit(first).cast("long").alias("n_first"), F.lit(second).cast("long").alias("n_second"))


@query("a18_upsert_counts", "SELECT user_id, event_type, count(*) AS times_used, max(event_id) AS last_id FROM events GROUP BY user_id, event_type")
def a18(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("user_id", "event_type", F.lit(1).cast("long").alias("times_used"), F.col("event_id").alias("last_id"))
    base = rows.where("last_id % 2 = 0").groupBy("user_id", "event_type").agg(F.sum("times_used").alias("times_used"), F.max("last_id").alias("last_id"))
    return upsert_counts(base, rows.where("last_id % 2 = 1"), ["user_id", "event_type"], "times_used", "last_id")


@query("a20_fixed_fields", "SELECT id, client_id, nature, NULL::VARCHAR AS note FROM statements")
def a20(spark, sf_dir):
    path = new_path(spark, "statements-csv")
    schema = write_csv(statements(spark, sf_dir), ["id", "client_id", "nature", "note"], path)
    return read_csv(spark, schema, path)


@query("a21_report_lines", "SELECT client_id, count(*) AS n, '# Statements' || chr(10) || string_agg('* ' || id || ': ' || status, chr(10) ORDER BY id) AS body FROM statements GROUP BY client_id")
def a21(spark, sf_dir):
    # a report of each client in Markdown, as a line of JSON
    rows = statements(spark, sf_dir).groupBy("client_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("id", "status"))).alias("x"))
    lines = F.transform("x", lambda i: F.concat(F.lit("* "), i["id"].cast("string"), F.lit(": "), i["status"]))
    reports = rows.select("client_id", "n", F.array_join(F.concat(F.array(F.lit("# Statements")), lines), "\n").alias("body"))
    path = new_path(spark, "reports-json")
    write_json(reports, path)
    return spark.read.schema(reports.schema).json(path)


@query("a23_constant_mapping", "SELECT part_id, line_no, document_id, CASE cma_row WHEN 22 THEN 122 WHEN 30 THEN 130 WHEN 41 THEN 141 ELSE cma_row END::INTEGER AS cma_row FROM classifications")
def a23(spark, sf_dir):
    pairs = spark.range(3).select(F.element_at(F.array(*map(F.lit, [22, 30, 41])), (F.col("id") + 1).cast("int")).alias("cma_row"))
    pairs = pairs.withColumn("to_row", F.col("cma_row") + 100)
    rows = classifications(spark, sf_dir).join(F.broadcast(pairs), "cma_row", "left")
    return rows.select("part_id", "line_no", "document_id", F.coalesce("to_row", "cma_row").alias("cma_row"))


@query("a24_null_counts", "SELECT count(*) FILTER (WHERE quality IS NULL) AS missing, count(quality) AS present FROM documents LEFT JOIN labels USING (doc_id)")
def a24(spark, sf_dir):
    joined = read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.agg(F.count_if(F.col("quality").isNull()).alias("missing"), F.count("quality").alias("present"))


@query("a25_fill_blank", "SELECT id, coalesce(CASE WHEN id % 3 = 0 THEN NULL ELSE nature END, '') AS nature, coalesce(CASE WHEN id % 5 = 0 THEN NULL ELSE file_type END, '') AS file_type FROM statements")
def a25(spark, sf_dir):
    rows = statements(spark, sf_dir).select("id", F.when(F.col("id") % 3 != 0, F.col("nature")).alias("nature"), F.when(F.col("id") % 5 != 0, F.col("file_type")).alias("file_type"))
    return rows.fillna("", ["nature", "file_type"])


@query("a26_insert_absent", "SELECT id, CASE WHEN id % 2 = 0 THEN name ELSE 'new' END AS name FROM clients WHERE id % 2 = 0 OR id % 3 = 0")
def a26(spark, sf_dir):
    base = clients(spark, sf_dir).select("id", "name")
    return insert_absent(base.where("id % 2 = 0"), base.where("id % 3 = 0").withColumn("name", F.lit("new")), ["id"])


@query("a27_partial_index", "SELECT id, client_id FROM statements WHERE CASE WHEN id % 7 = 0 THEN id END IS NOT NULL")
def a27(spark, sf_dir):
    return statements(spark, sf_dir).where(F.when(F.col("id") % 7 == 0, F.col("id")).isNotNull()).select("id", "client_id")


@query("a28_path_precedence", "SELECT id, CASE WHEN id % 3 = 0 THEN 'redacted/' WHEN id % 3 = 1 THEN 'filtered/' ELSE 'raw/' END || id AS path FROM statements")
def a28(spark, sf_dir):
    key = F.col("id").cast("string")
    redacted, filtered = F.when(F.col("id") % 3 == 0, F.concat(F.lit("redacted/"), key)).otherwise(""), F.when(F.col("id") % 3 == 1, F.concat(F.lit("filtered/"), key))
    return statements(spark, sf_dir).select("id", F.coalesce(F.nullif(redacted, F.lit("")), F.nullif(filtered, F.lit("")), F.concat(F.lit("raw/"), key)).alias("path"))


@query("a29_formula_catalogue", "SELECT document_id, section, min_by('=' || oa || '+' || ob, [oa, ob, oc]) AS formula FROM line_items WHERE oa BETWEEN 2 AND 20 AND ob % 2 = 0 GROUP BY document_id, section")
def a29(spark, sf_dir):
    cells = line_items(spark, sf_dir).where(F.col("ord.a").between(2, 20) & (F.col("ord.b") % 2 == 0))
    formula = F.concat(F.lit("="), F.col("ord.a").cast("string"), F.lit("+"), F.col("ord.b").cast("string"))
    return cells.groupBy("document_id", "section").agg(F.min_by(formula, F.struct("ord.a", "ord.b", "ord.c")).alias("formula"))


@query("d1_normalised_join", """WITH a AS (SELECT section, source_text, max_by(amount, [document_id, oa, ob, oc]) AS amount FROM line_items WHERE document_id % 2 = 0 GROUP BY section, source_text),
b AS (SELECT section, source_text, max_by(amount, [document_id, oa, ob, oc]) AS amount FROM line_items WHERE document_id % 2 = 1 GROUP BY section, source_text)
SELECT a.section, a.source_text, a.amount::DOUBLE AS before, b.amount::DOUBLE AS after FROM a JOIN b USING (section, source_text)""")  # fmt: skip
def d1(spark, sf_dir):
    rows = line_items(spark, sf_dir).select("section", "source_text", "amount", F.struct("document_id", "ord.a", "ord.b", "ord.c").alias("o"), (F.col("document_id") % 2).alias("side"))
    left, right = (last_wins(rows.where(F.col("side") == s).drop("side"), ["section", "source_text"], "o") for s in (0, 1))
    return left.select("section", "source_text", F.col("amount").cast("double").alias("before")).join(right.select("section", "source_text", F.col("amount").cast("double").alias("after")), ["section", "source_text"])


@query("d2_learned_lookup", "SELECT i.document_id, oa, ob, oc, m.cma_row, m.cma_row IS NOT NULL AS hit FROM line_items i LEFT JOIN (SELECT * FROM mappings WHERE cma_row > 0 AND cma_row % 3 <> 0) m ON lower(i.source_text) = m.source_text")
def d2(spark, sf_dir):
    known = mappings(spark, sf_dir).where("cma_row > 0 and cma_row % 3 <> 0 and source_text <> ''").select("source_text", "cma_row")
    rows = line_items(spark, sf_dir).withColumn("source_text", F.lower("source_text")).join(known, "source_text", "left")
    return rows.select("document_id", F.col("ord.a").alias("oa"), F.col("ord.b").alias("ob"), F.col("ord.c").alias("oc"), "cma_row", F.col("cma_row").isNotNull().alias("hit"))


@query("d3_items_with_year", "SELECT c.document_id, line_no, c.part_id, f.name, s.financial_year, c.amount::DOUBLE AS amount FROM classifications c JOIN statements s ON c.document_id = s.id JOIN fields f ON c.cma_row = f.cma_row WHERE NOT is_doubt")
def d3(spark, sf_dir):
    years = statements(spark, sf_dir).select(F.col("id").alias("document_id"), "financial_year").where("financial_year <> 0")
    rows = classifications(spark, sf_dir).where(~F.col("is_doubt")).join(years, "document_id").join(fields(spark), "cma_row")
    return rows.select("document_id", "line_no", "part_id", "name", "financial_year", F.col("amount").cast("double").alias("amount"))


@query("d4_last_classification", "SELECT s.id, c.cma_row FROM statements s LEFT JOIN (SELECT document_id, max_by(cma_row, [line_no, part_id]) AS cma_row FROM classifications WHERE NOT is_doubt GROUP BY document_id) c ON s.id = c.document_id")
def d4(spark, sf_dir):
    last = classifications(spark, sf_dir).where(~F.col("is_doubt")).groupBy("document_id").agg(F.max_by("cma_row", F.struct("line_no", "part_id")).alias("cma_row"))
    return statements(spark, sf_dir).select(F.col("id").alias("document_id")).join(last, "document_id", "left").select(F.col("document_id").alias("id"), "cma_row")


@query("d5_flattened", "SELECT c.document_id, line_no, c.part_id, p_name AS source_text, s.file_type, s.nature FROM classifications c LEFT JOIN part ON c.part_id = p_partkey LEFT JOIN statements s ON c.document_id = s.id")
def d5(spark, sf_dir):
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_id"), F.col("p_name").alias("source_text"))
    docs = statements(spark, sf_dir).select(F.col("id").alias("document_id"), "file_type", "nature")
    return classifications(spark, sf_dir).join(parts, "part_id", "left").join(docs, "document_id", "left").select("document_id", "line_no", "part_id", "source_text", "file_type", "nature")


@query("d6_ownership_chain", "SELECT c.document_id, line_no, part_id FROM classifications c JOIN statements s ON c.document_id = s.id JOIN clients k ON s.client_id = k.id WHERE s.uploaded_by = 3 AND k.industry_type = 'machinery'")
def d6(spark, sf_dir):
    owned = statements(spark, sf_dir).where("uploaded_by = 3").select(F.col("id").alias("document_id"), "client_id")
    who = clients(spark, sf_dir).where("industry_type = 'machinery'").select(F.col("id").alias("client_id"))
    return classifications(spark, sf_dir).join(owned, "document_id").join(who, "client_id", "left_semi").select("document_id", "line_no", "part_id")


@query("d7_report_doubts", "SELECT client_id AS report_id, c.document_id, line_no, part_id FROM classifications c JOIN statements s ON c.document_id = s.id WHERE is_doubt")
def d7(spark, sf_dir):
    # a report is a client's list of documents
    reports = statements(spark, sf_dir).groupBy(F.col("client_id").alias("report_id")).agg(F.collect_list("id").alias("document_ids"))
    exploded = reports.select("report_id", F.explode("document_ids").alias("document_id"))
    return exploded.join(classifications(spark, sf_dir).where("is_doubt"), "document_id").select("report_id", "document_id", "line_no", "part_id")


_CELLS = "SELECT client_id, cma_row, financial_year, sum(c.amount) AS v FROM classifications c JOIN statements s ON c.document_id = s.id WHERE {} GROUP BY client_id, cma_row, financial_year"


def _report_cells(spark, sf_dir, condition):
    docs = statements(spark, sf_dir).select(F.col("id").alias("document_id"), "client_id", "financial_year")
    return classifications(spark, sf_dir).where(condition).join(docs, "document_id").groupBy("client_id", "cma_row", "financial_year").agg(F.sum("amount").alias("v"))


@query("d8_cell_diff", f"""WITH a AS ({_CELLS.format("confidence >= 0.85")}), b AS ({_CELLS.format("confidence >= 0.80")})
SELECT client_id, cma_row, financial_year, a.v::DOUBLE AS made, b.v::DOUBLE AS corrected FROM a FULL JOIN b USING (client_id, cma_row, financial_year) WHERE a.v IS NULL OR b.v IS NULL OR abs(a.v - b.v) > 0.01""")  # fmt: skip
def d8(spark, sf_dir):
    keys = ["client_id", "cma_row", "financial_year"]
    made, fixed = _report_cells(spark, sf_dir, "confidence >= 0.85").withColumnRenamed("v", "made"), _report_cells(spark, sf_dir, "confidence >= 0.80").withColumnRenamed("v", "corrected")
    both = made.join(fixed, keys, "full")
    return both.where(~A.equal_absolute(F.col("made"), F.col("corrected"))).select(*keys, F.col("made").cast("double").alias("made"), F.col("corrected").cast("double").alias("corrected"))


@query("d9_cell_compare", f"""WITH a AS ({_CELLS.format("confidence >= 0.85")}), b AS ({_CELLS.format("confidence >= 0.70 AND part_id % 5 <> 0")}), j AS (SELECT a.v AS a, b.v AS b FROM a FULL JOIN b USING (client_id, cma_row, financial_year))
SELECT CASE WHEN a IS NULL THEN 'EXTRA' WHEN b IS NULL THEN 'MISSING' WHEN abs(b - a) * 50 <= abs(a) THEN 'MATCH' ELSE 'MISMATCH' END AS status, count(*) AS n FROM j GROUP BY 1""")  # fmt: skip
def d9(spark, sf_dir):
    keys = ["client_id", "cma_row", "financial_year"]
    a, b = _report_cells(spark, sf_dir, "confidence >= 0.85").withColumnRenamed("v", "a"), _report_cells(spark, sf_dir, "confidence >= 0.70 and part_id % 5 <> 0").withColumnRenamed("v", "b")
    return a.join(b, keys, "full").groupBy(A.cell_status(F.col("a"), F.col("b")).alias("status")).agg(F.count("*").alias("n"))


@query("d10_diff_provenance", "SELECT DISTINCT f.cma_row, c.document_id FROM fields f LEFT JOIN classifications c ON f.cma_row = c.cma_row")
def d10(spark, sf_dir):
    # a row for each source of a cell: a list of them could grow with the table
    sources = classifications(spark, sf_dir).select("cma_row", "document_id").distinct()
    return fields(spark).join(sources, "cma_row", "left").select("cma_row", "document_id")


@query("d11_answers_to_rules", "SELECT event_id, ['A','B','C'][event_id % 3 + 1] AS opt, (user_id % 250)::INTEGER AS cma_row FROM events WHERE event_id % 3 <> 0 AND user_id % 250 > 0 AND event_id % 4 <> 0")
def d11(spark, sf_dir):
    rows = read(spark, sf_dir, "events")
    questions = rows.where("event_id % 4 <> 0").select("event_id", (F.col("user_id") % 250).cast("int").alias("cma_row"))
    answers = rows.select("event_id", F.element_at(F.array(*map(F.lit, "ABC")), (F.col("event_id") % 3 + 1).cast("int")).alias("opt"))
    return answers.where("opt <> 'A'").join(questions.where("cma_row > 0"), "event_id").select("event_id", "opt", "cma_row")


@query("d18_cross_check", """WITH a AS (SELECT lower(source_text) AS t, financial_year AS fy, max_by(ob % 5, [document_id, oa, ob, oc]) AS v FROM line_items i JOIN statements s ON i.document_id = s.id WHERE document_id % 2 = 0 GROUP BY 1, 2),
b AS (SELECT lower(source_text) AS t, financial_year AS fy, ob % 5 AS v FROM line_items i JOIN statements s ON i.document_id = s.id WHERE document_id % 2 = 1)
SELECT count(*) AS compared, count(*) FILTER (WHERE a.v = b.v) AS agreed FROM a JOIN b USING (t, fy)""")  # fmt: skip
def d18(spark, sf_dir):
    years = statements(spark, sf_dir).select(F.col("id").alias("document_id"), F.col("financial_year").alias("fy"))
    rows = line_items(spark, sf_dir).join(years, "document_id").select("document_id", F.lower("source_text").alias("t"), "fy", (F.col("ord.b") % 5).alias("v"), F.struct("document_id", "ord.a", "ord.b", "ord.c").alias("o"))
    left = rows.where("document_id % 2 = 0").groupBy("t", "fy").agg(F.max_by("v", "o").alias("a"))
    return rows.where("document_id % 2 = 1").join(left, ["t", "fy"]).agg(F.count("*").alias("compared"), F.count_if(F.col("a") == F.col("v")).alias("agreed"))


@query("d19_override_join", "SELECT d.doc_id, CASE WHEN quality IS NOT NULL THEN 'q' || quality WHEN d.doc_id % 2 = 0 THEN 'kept' ELSE 'truly_unverified' END AS status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def d19(spark, sf_dir):
    verdicts = read(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("verdict"))
    return read(spark, sf_dir, "documents").select("doc_id").join(verdicts, "doc_id", "left").select("doc_id", F.coalesce("verdict", F.when(F.col("doc_id") % 2 == 0, "kept").otherwise("truly_unverified")).alias("status"))


@query("d20_not_yet_captured", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def d20(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels").where("toxic = 1"), "doc_id", "left_anti")


@query("d21_canonical_row", "SELECT c.document_id, line_no, part_id, coalesce(f.cma_row, c.cma_row) AS cma_row, coalesce(f.name, 'unknown') AS name FROM classifications c LEFT JOIN fields f ON (c.cma_row + 1) = f.cma_row")
def d21(spark, sf_dir):
    canonical = fields(spark).select((F.col("cma_row") - 1).alias("cma_row"), F.col("cma_row").alias("right_row"), "name")
    rows = classifications(spark, sf_dir).join(canonical, "cma_row", "left")
    return rows.select("document_id", "line_no", "part_id", F.coalesce("right_row", "cma_row").alias("cma_row"), F.coalesce("name", F.lit("unknown")).alias("name"))


_PREDICTED = "CASE WHEN n_chars % 9 = 0 THEN NULL WHEN length(text) > 800 THEN 1 ELSE 0 END"


@query("d22_predictions", f"SELECT l.doc_id, quality, {_PREDICTED} AS predicted, CASE WHEN {_PREDICTED} IS NULL THEN 'missing' WHEN {_PREDICTED} = quality THEN 'correct' ELSE 'wrong' END AS outcome FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id")
def d22(spark, sf_dir):
    predicted = F.when(F.col("n_chars") % 9 == 0, None).when(F.char_length("text") > 800, 1).otherwise(0)
    docs = read(spark, sf_dir, "documents").select("doc_id", predicted.alias("predicted"))
    rows = read(spark, sf_dir, "labels").select("doc_id", "quality").join(docs, "doc_id", "left")
    return rows.withColumn("outcome", F.when(F.col("predicted").isNull(), "missing").when(F.col("predicted") == F.col("quality"), "correct").otherwise("wrong"))


_ACC = "SELECT reviewer, (100 * count(*) FILTER (WHERE {}))::DOUBLE / count(*) AS acc FROM classifications GROUP BY reviewer"


def _accuracy(spark, sf_dir, condition, name):
    return classifications(spark, sf_dir).groupBy("reviewer").agg(((100 * F.count_if(F.expr(condition))).cast("double") / F.count("*")).alias(name))


@query("d23_baseline_vs_proposed", f"WITH a AS ({_ACC.format('confidence >= 0.85')}), b AS ({_ACC.format('confidence >= 0.80')}) SELECT reviewer, a.acc AS before, b.acc AS after FROM a JOIN b USING (reviewer) WHERE reviewer <> 3")
def d23(spark, sf_dir):
    after = _accuracy(spark, sf_dir, "confidence >= 0.80", "after").where("reviewer <> 3")
    return _accuracy(spark, sf_dir, "confidence >= 0.85", "before").join(after, "reviewer").where("before is not null and after is not null")


@query("d24_before_after", f"WITH a AS ({_ACC.format('confidence >= 0.85')}), b AS ({_ACC.format('confidence >= 0.80')}) SELECT a.reviewer, CASE WHEN b.acc IS NULL THEN 'N/A' ELSE floor(b.acc)::BIGINT::VARCHAR END AS after FROM a LEFT JOIN b ON a.reviewer = b.reviewer AND b.reviewer <> 3")
def d24(spark, sf_dir):
    after = _accuracy(spark, sf_dir, "confidence >= 0.80", "acc").where("reviewer <> 3")
    return _accuracy(spark, sf_dir, "confidence >= 0.85", "before").join(after, "reviewer", "left").select("reviewer", F.coalesce(F.floor("acc").cast("string"), F.lit("N/A")).alias("after"))


@query("d25_range_join", "SELECT b.name, count(*) AS n, min(cma_row) AS lo, max(cma_row) AS hi FROM classifications c JOIN (VALUES ('pl_income', 22, 34), ('pl_expense', 41, 108), ('bs_liability', 110, 160), ('bs_asset', 161, 258)) b(name, a, z) ON c.cma_row BETWEEN a AND z GROUP BY b.name")
def d25(spark, sf_dir):
    ranges = spark.createDataFrame(A.BUCKETS, "name string, first int, last int")
    joined = classifications(spark, sf_dir).join(F.broadcast(ranges), F.col("cma_row").between(F.col("first"), F.col("last")))
    return joined.groupBy("name").agg(F.count("*").alias("n"), F.min("cma_row").alias("lo"), F.max("cma_row").alias("hi"))


@query("d27_candidate_fill", "WITH c AS (SELECT document_id, list_sort(list(DISTINCT cma_row)) AS known FROM classifications GROUP BY document_id) SELECT document_id, list_slice(list_concat(list_filter(known, lambda x: x % 2 = 0), list_filter(known, lambda x: x % 2 <> 0)), 1, 3) AS candidates FROM c")
def d27(spark, sf_dir):
    known = classifications(spark, sf_dir).groupBy("document_id").agg(F.array_sort(F.collect_set("cma_row")).alias("known"))
    # the rows that retrieval proposes come first, then the other known ones
    proposed = F.array_intersect("known", F.filter("known", lambda x: x % 2 == 0))
    return known.select("document_id", F.slice(F.array_union(proposed, "known"), 1, 3).alias("candidates"))


@query("d28_section_rows", "SELECT section, count(DISTINCT c.cma_row) AS n_rows, count(DISTINCT f.name) AS n_names FROM line_items i JOIN classifications c ON i.document_id = c.document_id AND oa = line_no AND i.part_id = c.part_id LEFT JOIN fields f ON c.cma_row = f.cma_row GROUP BY section")
def d28(spark, sf_dir):
    items = line_items(spark, sf_dir).select("document_id", F.col("ord.a").alias("line_no"), "part_id", "section")
    rows = items.join(classifications(spark, sf_dir), ["document_id", "line_no", "part_id"]).join(fields(spark), "cma_row", "left")
    return rows.groupBy("section").agg(F.countDistinct("cma_row").alias("n_rows"), F.countDistinct("name").alias("n_names"))


@query("d29_year_split", "SELECT s.id, s.financial_year = m.first_year AS dropped FROM statements s JOIN (SELECT client_id, min(financial_year) AS first_year FROM statements GROUP BY client_id) m ON s.client_id = m.client_id")
def d29(spark, sf_dir):
    docs = statements(spark, sf_dir).select("id", "client_id", "financial_year")
    first = docs.groupBy("client_id").agg(F.min("financial_year").alias("first_year"))
    return docs.join(first, "client_id").select("id", (F.col("financial_year") == F.col("first_year")).alias("dropped"))


@query("d30_label_counts", "SELECT f.cma_row, f.name, coalesce(n, 0) AS n FROM fields f LEFT JOIN (SELECT cma_row, count(*) AS n FROM classifications WHERE part_id % 9 = 0 GROUP BY cma_row) c ON f.cma_row = c.cma_row")
def d30(spark, sf_dir):
    counts = classifications(spark, sf_dir).where("part_id % 9 = 0").groupBy("cma_row").agg(F.count("*").alias("n"))
    return fields(spark).join(counts, "cma_row", "left").select("cma_row", "name", F.coalesce("n", F.lit(0)).alias("n"))


@query("d31_doubt_cascade", "SELECT c.document_id, line_no, c.part_id, CASE WHEN m.p_partkey IS NOT NULL THEN 'manual' WHEN r.cma_row IS NOT NULL THEN 'rule' ELSE 'unmatched' END AS found_by FROM classifications c LEFT JOIN (SELECT p_partkey FROM part WHERE p_partkey % 10 = 0) m ON c.part_id = m.p_partkey LEFT JOIN fields r ON c.cma_row = r.cma_row WHERE is_doubt")
def d31(spark, sf_dir):
    manual = read(spark, sf_dir, "part").where("p_partkey % 10 = 0").select(F.col("p_partkey").alias("part_id"), F.lit("manual").alias("by_hand"))
    rules = fields(spark).select("cma_row", F.lit("rule").alias("by_rule"))
    doubts = classifications(spark, sf_dir).where("is_doubt").join(manual, "part_id", "left").join(rules, "cma_row", "left")
    return doubts.select("document_id", "line_no", "part_id", F.coalesce("by_hand", "by_rule", F.lit("unmatched")).alias("found_by"))


@query("d32_positional_join", "SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations) WHERE pos IN (1, 3)")
def d32(spark, sf_dir):
    batch = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("items"))
    replies = F.explode(F.array(F.lit(1), F.lit(3)))
    asked = batch.select("conv_id", "items", replies.alias("item_index"))
    return asked.select("conv_id", F.try_element_at("items", F.col("item_index")).alias("i")).where("i is not null").select("conv_id", "i.turn", "i.role", "i.text")


@query("d33_row_names", "SELECT document_id, line_no, part_id, coalesce(f.name, 'Row ' || c.cma_row) AS name FROM classifications c LEFT JOIN fields f ON c.cma_row = f.cma_row")
def d33(spark, sf_dir):
    rows = classifications(spark, sf_dir).join(fields(spark), "cma_row", "left")
    return rows.select("document_id", "line_no", "part_id", F.coalesce("name", F.concat(F.lit("Row "), F.col("cma_row").cast("string"))).alias("name"))


@query("h1_union_streams", "SELECT kind, count(*) AS n FROM (SELECT 'doubt' AS kind FROM classifications WHERE is_doubt UNION ALL SELECT 'sure' FROM classifications WHERE NOT is_doubt UNION ALL SELECT 'learned' FROM mappings) GROUP BY kind")
def h1(spark, sf_dir):
    rows = classifications(spark, sf_dir)
    streams = [rows.where("is_doubt").select(F.lit("doubt").alias("kind")), rows.where("not is_doubt").select(F.lit("sure").alias("kind")), mappings(spark, sf_dir).select(F.lit("learned").alias("kind"))]
    return streams[0].unionByName(streams[1]).unionByName(streams[2]).groupBy("kind").agg(F.count("*").alias("n"))


@query("h2_missing_ids", "SELECT DISTINCT doc_id * 2 AS id FROM documents WHERE doc_id * 2 NOT IN (SELECT doc_id FROM documents)")
def h2(spark, sf_dir):
    ids = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return ids.select((F.col("id") * 2).alias("id")).distinct().join(ids, "id", "left_anti")


@query("h3_key_union", "SELECT coalesce(a.id, b.id) AS id, a.id IS NOT NULL AS in_a, b.id IS NOT NULL AS in_b FROM (SELECT id FROM clients WHERE id % 2 = 0) a FULL JOIN (SELECT id FROM clients WHERE id % 3 = 0) b ON a.id = b.id")
def h3(spark, sf_dir):
    ids = clients(spark, sf_dir).select("id")
    a, b = ids.where("id % 2 = 0").withColumn("a", F.lit(True)), ids.where("id % 3 = 0").withColumn("b", F.lit(True))
    return a.join(b, "id", "full").select("id", F.coalesce("a", F.lit(False)).alias("in_a"), F.coalesce("b", F.lit(False)).alias("in_b"))


@query("h4_common_keys", "SELECT client_id FROM statements WHERE nature = 'audited' INTERSECT SELECT client_id FROM statements WHERE nature = 'provisional'")
def h4(spark, sf_dir):
    docs = statements(spark, sf_dir)
    return docs.where("nature = 'audited'").select("client_id").intersect(docs.where("nature = 'provisional'").select("client_id"))


@query("h5_replace_element", "SELECT client_id, list_transform(list_sort(list(id)), lambda x: CASE WHEN x % 4 = 1 THEN x + 1000000 ELSE x END) AS ids FROM statements GROUP BY client_id")
def h5(spark, sf_dir):
    docs = statements(spark, sf_dir).groupBy("client_id").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return docs.select("client_id", F.transform("ids", lambda x: F.when(x % 4 == 1, x + 1000000).otherwise(x)).alias("ids"))


@query("h6_page_difference", "SELECT client_id, list_sort(list(DISTINCT financial_year) FILTER (WHERE financial_year NOT IN (1993, 1995))) AS years FROM statements WHERE financial_year NOT IN (1993, 1995) GROUP BY client_id")
def h6(spark, sf_dir):
    docs = statements(spark, sf_dir).groupBy("client_id").agg(F.array_sort(F.collect_set("financial_year")).alias("all"))
    return docs.select("client_id", F.array_except("all", F.array(F.lit(1993), F.lit(1995))).alias("years")).where(F.size("years") > 0)


@query("h7_precedence_union", "SELECT p_name, min(CASE WHEN p_partkey % 3 = 0 THEN 1 WHEN p_partkey % 3 = 1 THEN 2 ELSE 3 END)::INTEGER AS level FROM part GROUP BY p_name")
def h7(spark, sf_dir):
    parts = read(spark, sf_dir, "part").select("p_name", "p_partkey")
    levels = [parts.where(f"p_partkey % 3 = {i}").select("p_name", F.lit(i + 1).alias("level")).distinct() for i in range(3)]
    out = levels[0]
    for level in levels[1:]:
        out = insert_absent(out, level, ["p_name"])
    return out


@query("h8_tagged_union", "SELECT tag, count(*) AS n, sum(k)::BIGINT AS total FROM (SELECT 'customer' AS tag, c_custkey AS k FROM customer UNION ALL SELECT 'supplier', s_suppkey FROM supplier) GROUP BY tag")
def h8(spark, sf_dir):
    a = read(spark, sf_dir, "customer").select(F.lit("customer").alias("tag"), F.col("c_custkey").alias("k"))
    b = read(spark, sf_dir, "supplier").select(F.lit("supplier").alias("tag"), F.col("s_suppkey").alias("k"))
    return a.unionByName(b).groupBy("tag").agg(F.count("*").alias("n"), F.sum("k").alias("total"))


@query("h9_first_wins", "SELECT lower(source_text) AS t, section, min_by(document_id, [document_id, oa, ob, oc]) AS document_id FROM line_items GROUP BY 1, 2")
def h9(spark, sf_dir):
    rows = line_items(spark, sf_dir).select(F.lower("source_text").alias("t"), "section", "document_id", "ord")
    return first_per_key(rows, ["t", "section"], "document_id", "ord").select("t", "section", "document_id")
