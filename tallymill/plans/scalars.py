"""Projections, filters and scalar functions, each over a whole relation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymill.functions import amounts as A, text as T
from tallymill.plans.base import query
from tallymill.sources.relations import classifications, clients, fields, line_items, read, statements

#: What stands before a part's label in a statement, by the part's number; the label in SQL.
_BEFORE = ["Item 1 (i) : ", "Note 3 - ", "1. ", "a) ", "  ", "Particulars: 2) b. "]
_RAW_SQL = "['Item 1 (i) : ', 'Note 3 - ', '1. ', 'a) ', '  ', 'Particulars: 2) b. '][p_partkey % 6 + 1] || array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || '  Net '"
_LABEL_SQL = r"trim(regexp_replace(regexp_replace(regexp_replace(trim(raw), '^(?:(?:Item|Note|Particulars)\s*\d*\s*(?:\([^)]*\))?\s*[:.\-]\s*)', '', 'i'), '^\d+[.)]\s*', ''), '^[a-z][.)]\s*', '', 'i'))"
_PARTS_SQL = f"WITH raws AS (SELECT p_partkey, {_RAW_SQL} AS raw FROM part)"


def _raw_parts(spark, sf_dir):
    before = F.element_at(F.array(*map(F.lit, _BEFORE)), (F.col("p_partkey") % len(_BEFORE) + 1).cast("int"))
    return read(spark, sf_dir, "part").select("p_partkey", F.concat(before, F.initcap("p_name"), F.lit("  Net ")).alias("raw"))


@query("c1_line_label", f"{_PARTS_SQL} SELECT p_partkey, {_LABEL_SQL} AS label FROM raws")
def c1(spark, sf_dir):
    return _raw_parts(spark, sf_dir).select("p_partkey", T.line_label(F.col("raw")).alias("label"))


@query("c2_diff_key", f"{_PARTS_SQL} SELECT p_partkey, trim(regexp_replace(lower({_LABEL_SQL}), '\\s+', ' ', 'g')) AS k FROM raws")
def c2(spark, sf_dir):
    return _raw_parts(spark, sf_dir).select("p_partkey", T.diff_key(F.col("raw")).alias("k"))


@query("c3_mapping_key", f"{_PARTS_SQL} SELECT p_partkey, lower(trim({_LABEL_SQL})) AS k FROM raws")
def c3(spark, sf_dir):
    return _raw_parts(spark, sf_dir).select("p_partkey", T.mapping_key(F.col("raw")).alias("k"))


def _styles():
    """An amount as text in several styles."""
    money = F.col("l_extendedprice").cast("decimal(12,2)").cast("string")
    return [money, F.concat(F.lit("("), money, F.lit(")")), F.concat(F.lit("₹"), F.regexp_replace(money, r"(\d)(\d{3}\.)", "$1,$2")), F.concat(F.lit("-"), money), F.lit("N/A"), F.concat(F.lit(" $ ("), money, F.lit(") ")), F.concat(money, F.lit("d"))]

_STYLE_SQL = "CASE l_partkey % 7 WHEN 0 THEN m WHEN 1 THEN '(' || m || ')' WHEN 2 THEN '₹' || regexp_replace(m, '(\\d)(\\d{3}\\.)', '\\1,\\2') WHEN 3 THEN '-' || m WHEN 4 THEN 'N/A' WHEN 5 THEN ' $ (' || m || ') ' ELSE m || 'd' END"


@query("c4_parse_amount", f"""WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice::DECIMAL(12,2)::VARCHAR AS m FROM lineitem),
s AS (SELECT l_orderkey, l_linenumber, {_STYLE_SQL} AS raw FROM m)
SELECT l_orderkey, l_linenumber, raw, CASE WHEN regexp_matches(raw, '[a-zA-Z]') THEN NULL WHEN regexp_matches(raw, '[(-]') THEN -(regexp_replace(raw, '[^0-9.]', '', 'g')::DOUBLE) ELSE regexp_replace(raw, '[^0-9.]', '', 'g')::DOUBLE END AS amount FROM s""")  # fmt: skip
def c4(spark, sf_dir):
    raw = F.coalesce(*[F.when(F.col("l_partkey") % 7 == i, s) for i, s in enumerate(_styles())])
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", raw.alias("raw"), A.parse_amount(raw).alias("amount"))


_CNAME = "c_name || ' (Old ' || c_custkey || ') & Sons / ' || c_mktsegment || '!'"


def _customer_text(spark, sf_dir):
    text = F.concat(F.col("c_name"), F.lit(" (Old "), F.col("c_custkey").cast("string"), F.lit(") & Sons / "), F.col("c_mktsegment"), F.lit("!"))
    return read(spark, sf_dir, "customer").select("c_custkey", text.alias("raw"), "c_mktsegment")


_FUZZY_SQL = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(raw), '\(.*?\)', '', 'g'), '[^\w\s&/]', '', 'g'), '\s+', ' ', 'g'))"


@query("c5_fuzzy_text", f"WITH r AS (SELECT c_custkey, {_CNAME} AS raw FROM customer) SELECT c_custkey, {_FUZZY_SQL} AS t FROM r")
def c5(spark, sf_dir):
    return _customer_text(spark, sf_dir).select("c_custkey", T.fuzzy_text(F.col("raw")).alias("t"))


@query("c6_group_text", f"WITH r AS (SELECT c_custkey, {_CNAME} AS raw FROM customer) SELECT c_custkey, trim(regexp_replace({_FUZZY_SQL}, '^[()a-z0-9]+\\s+', '')) AS t FROM r")
def c6(spark, sf_dir):
    return _customer_text(spark, sf_dir).select("c_custkey", T.group_text(F.col("raw")).alias("t"))


@query("c7_rule_text", f"WITH r AS (SELECT c_custkey, {_CNAME} AS raw FROM customer) SELECT c_custkey, trim(regexp_replace(regexp_replace(lower(raw), '[(){{}}\\[\\]]', '', 'g'), '\\s+', ' ', 'g')) AS t FROM r")
def c7(spark, sf_dir):
    return _customer_text(spark, sf_dir).select("c_custkey", T.rule_text(F.col("raw")).alias("t"))


_KINDS = ["P&L", "Balance Sheet", "", "bs", "Profit and Loss", "Notes"]


@query("c8_statement_kind", "SELECT o_orderkey, ['pl','bs','pl','bs','pl','notes'][o_orderkey % 6 + 1] AS kind FROM orders")
def c8(spark, sf_dir):
    raw = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return read(spark, sf_dir, "orders").select("o_orderkey", T.statement_kind(raw).alias("kind"))


@query("c9_clean", "SELECT doc_id, trim(regexp_replace(text, '[ \\t-\\r]+', ' ', 'g'), ' ') AS t FROM documents")
def c9(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.clean(F.col("text")).alias("t"))


@query("c10_unit_divisor", "SELECT id, o.u AS out_unit, CASE o.u WHEN 'crores' THEN 1e7 ELSE 1e5 END / CASE source_unit WHEN 'rupees' THEN 1 WHEN 'thousands' THEN 1e3 WHEN 'lakhs' THEN 1e5 ELSE 1e7 END AS divisor FROM statements, (VALUES ('crores'), ('furlongs')) o(u)")
def c10(spark, sf_dir):
    docs = statements(spark, sf_dir).select("id", "source_unit", F.explode(F.array(F.lit("crores"), F.lit("furlongs"))).alias("out_unit"))
    return docs.select("id", "out_unit", A.divisor(F.col("source_unit"), F.col("out_unit")).alias("divisor"))


@query("c11_scale", "SELECT id, CASE source_unit WHEN 'thousands' THEN 1000 WHEN 'lakhs' THEN 100000 WHEN 'crores' THEN 10000000 ELSE 1 END::INTEGER AS factor FROM statements")
def c11(spark, sf_dir):
    return statements(spark, sf_dir).select("id", A.scale(F.concat(F.lit("in_"), "source_unit")).cast("int").alias("factor"))


_SHEETS = ["Notes BS (2)", "P & L", "Balance Sheet", "Trial Balance", "Schedule 3", "Stock Register", "Cash Flow", "", "Index", "GST detail", "Manufacturing"]


def _sheets(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, _SHEETS)), (F.col("o_orderkey") % len(_SHEETS) + 1).cast("int"))
    return read(spark, sf_dir, "orders").select("o_orderkey", name.alias("sheet"))


_SHEET_SQL = "[" + ", ".join(f"'{s}'" for s in _SHEETS) + f"][o_orderkey % {len(_SHEETS)} + 1]"


@query("b2_relevant_sheet", f"SELECT o_orderkey, {_SHEET_SQL} AS sheet, {_SHEET_SQL} IN ('Notes BS (2)', 'P & L', 'Balance Sheet', 'Cash Flow', 'Manufacturing') AS relevant FROM orders")
def b2(spark, sf_dir):
    return _sheets(spark, sf_dir).select("o_orderkey", "sheet", T.is_relevant_sheet(F.col("sheet")).alias("relevant"))


@query("b3_sheet_priority", f"SELECT o_orderkey, CASE WHEN s IN ('Notes BS (2)', 'Schedule 3') THEN 3 WHEN s IN ('P & L', 'Balance Sheet', 'Cash Flow', 'Manufacturing') THEN 1 ELSE 2 END::INTEGER AS priority, CASE WHEN s IN ('Notes BS (2)', 'Schedule 3') THEN 'notes' WHEN s IN ('P & L', 'Balance Sheet', 'Cash Flow', 'Manufacturing') THEN 'face' ELSE 'unknown' END AS page_type FROM (SELECT o_orderkey, {_SHEET_SQL} AS s FROM orders)")
def b3(spark, sf_dir):
    return _sheets(spark, sf_dir).select("o_orderkey", T.sheet_priority(F.col("sheet")).alias("priority"), T.sheet_page_type(F.col("sheet")).alias("page_type"))


@query("c12_page_type", "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'face' WHEN 1 THEN 'notes' WHEN 2 THEN 'face' WHEN 3 THEN 'notes' WHEN 4 THEN 'face' ELSE 'unknown' END AS page_type FROM orders")
def c12(spark, sf_dir):
    raw = F.element_at(F.array(*map(F.lit, ["profit_and_loss", "schedules", "balance_sheet", "notes_to_accounts", "trading_account", "cover"])), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return read(spark, sf_dir, "orders").select("o_orderkey", T.page_type(raw).alias("page_type"))


@query("c13_to_crores", "SELECT o_orderkey, round(o_totalprice::DECIMAL(14,2)::DECIMAL(24,12) / 10000000, 6)::DECIMAL(18,6)::DOUBLE AS crores FROM (SELECT o_orderkey, round(o_totalprice::DECIMAL(14,2) * 0.0000001, 6)::DOUBLE AS x, o_totalprice FROM orders)".replace("round(o_totalprice::DECIMAL(14,2)::DECIMAL(24,12) / 10000000, 6)::DECIMAL(18,6)::DOUBLE", "x"))
def c13(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", F.round(F.col("o_totalprice").cast("decimal(14,2)") * F.lit("0.0000001").cast("decimal(8,7)"), 6).cast("double").alias("crores"))


_TOKEN_SQL = "CASE WHEN {0} = round({0}, 0) THEN {0}::BIGINT::VARCHAR ELSE {0}::VARCHAR END"


@query("c14_number_token", f"SELECT l_orderkey, l_linenumber, {_TOKEN_SQL.format('v')} AS token FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 3 = 0 THEN round(l_extendedprice::DECIMAL(12,2), 0)::DECIMAL(12,2) ELSE l_extendedprice::DECIMAL(12,2) END AS v FROM lineitem)")
def c14(spark, sf_dir):
    v = F.col("l_extendedprice").cast("decimal(12,2)")
    v = F.when(F.col("l_partkey") % 3 == 0, F.round(v, 0).cast("decimal(12,2)")).otherwise(v)
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", A.number_token(v).alias("token"))


@query("c15_formula", f"SELECT document_id, '=' || string_agg(CASE WHEN rn > 1 AND t[1] <> '-' THEN '+' || t ELSE t END, '' ORDER BY rn) AS formula FROM (SELECT document_id, {_TOKEN_SQL.format('v')} AS t, row_number() OVER (PARTITION BY document_id ORDER BY oa, ob, oc, od) AS rn FROM (SELECT *, CASE WHEN ob % 4 = 0 THEN -amount ELSE amount END AS v FROM line_items)) GROUP BY document_id")
def c15(spark, sf_dir):
    signed = F.when(F.col("ord.b") % 4 == 0, -F.col("amount")).otherwise(F.col("amount"))
    items = line_items(spark, sf_dir).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("ord", signed.alias("v")))).alias("x"))
    return items.select("document_id", A.formula(F.transform("x", lambda i: A.number_token(i["v"]))).alias("formula"))


@query("c16_real_formula", "SELECT o_orderkey, o_orderkey % 5 IN (0, 3) AS real FROM orders")
def c16(spark, sf_dir):
    raw = F.element_at(F.array(*map(F.lit, ["=SUM(B2:B9)", "=0", "=100.50+3", "='Sheet 1'!B4", "plain A1"])), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return read(spark, sf_dir, "orders").select("o_orderkey", A.is_real_formula(raw).alias("real"))


@query("c17_evaluate_formula", "SELECT document_id, sum(CASE WHEN ob % 4 = 0 THEN -amount ELSE amount END)::DOUBLE AS value FROM line_items GROUP BY document_id")
def c17(spark, sf_dir):
    return c15(spark, sf_dir).select("document_id", A.evaluate_sum(F.col("formula")).cast("double").alias("value"))


@query("c18_year_column", "SELECT id, CASE WHEN financial_year - 1994 BETWEEN 0 AND 11 THEN substr('BCDEFGHIJKLM', financial_year - 1993, 1) END AS col FROM statements")
def c18(spark, sf_dir):
    return statements(spark, sf_dir).select("id", A.year_column(F.col("financial_year"), F.lit(1994)).alias("col"))


@query("c19_financial_year", "SELECT id, CASE id % 3 WHEN 0 THEN CASE WHEN financial_year >= 1999 THEN (financial_year + 1)::VARCHAR ELSE '20' || right((financial_year + 1)::VARCHAR, 2) END WHEN 1 THEN financial_year::VARCHAR ELSE 'FY' || financial_year END AS fy FROM statements")
def c19(spark, sf_dir):
    y = F.col("financial_year")
    raw = F.when(F.col("id") % 3 == 0, F.concat(y.cast("string"), F.lit("-"), F.right((y + 1).cast("string"), F.lit(2)))).when(F.col("id") % 3 == 1, y.cast("string")).otherwise(F.concat(F.lit("FY"), y.cast("string")))
    return statements(spark, sf_dir).select("id", A.financial_year(raw).alias("fy"))


_BUCKET_SQL = "CASE WHEN {0} BETWEEN 22 AND 34 THEN 'pl_income' WHEN {0} BETWEEN 41 AND 108 THEN 'pl_expense' WHEN {0} BETWEEN 110 AND 160 THEN 'bs_liability' WHEN {0} BETWEEN 161 AND 258 THEN 'bs_asset' END"


@query("c20_bucket", f"SELECT document_id, line_no, part_id, {_BUCKET_SQL.format('cma_row')} AS bucket FROM classifications")
def c20(spark, sf_dir):
    return classifications(spark, sf_dir).select("document_id", "line_no", "part_id", A.bucket(F.col("cma_row")).alias("bucket"))


@query("c21_document_context", "SELECT document_id, line_no, part_id, CASE WHEN cma_row BETWEEN 22 AND 108 THEN 'pl' WHEN cma_row >= 116 THEN 'bs' WHEN part_id % 2 = 0 THEN 'pl' ELSE 'bs' END AS context FROM classifications")
def c21(spark, sf_dir):
    section = F.when(F.col("part_id") % 2 == 0, "Other Expenses").otherwise("Bank balance")
    return classifications(spark, sf_dir).select("document_id", "line_no", "part_id", A.document_context(F.col("cma_row"), F.lit("Sheet1"), section).alias("context"))


@query("c22_document_type", "SELECT document_id, oa, ob, oc, CASE WHEN contains(lower(section || ' ' || sheet), 'bs') THEN 'balance_sheet' ELSE 'profit_and_loss' END AS kind FROM line_items")
def c22(spark, sf_dir):
    both = F.lower(F.concat_ws(" ", "section", "sheet"))
    kind = F.when(F.rlike(both, F.lit("balance sheet|bs|assets|liabilities|equity")), "balance_sheet").otherwise("profit_and_loss")
    return line_items(spark, sf_dir).select("document_id", F.col("ord.a").alias("oa"), F.col("ord.b").alias("ob"), F.col("ord.c").alias("oc"), kind.alias("kind"))


_PAIR = "WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 11 = 0 THEN 0 WHEN l_partkey % 13 = 0 THEN NULL ELSE l_extendedprice::DECIMAL(12,2) END AS a, CASE WHEN l_partkey % 7 = 0 THEN NULL WHEN l_partkey % 5 = 0 THEN 0 ELSE (l_extendedprice::DECIMAL(12,2) + l_quantity::DECIMAL(12,2) * (l_partkey % 20))::DECIMAL(14,2) END AS b FROM lineitem)"


def _pairs(spark, sf_dir):
    k, p = F.col("l_partkey"), F.col("l_extendedprice").cast("decimal(12,2)")
    a = F.when(k % 11 == 0, F.lit(0).cast("decimal(12,2)")).when(k % 13 == 0, None).otherwise(p)
    b = F.when(k % 7 == 0, None).when(k % 5 == 0, F.lit(0).cast("decimal(14,2)")).otherwise((p + F.col("l_quantity").cast("decimal(12,2)") * (k % 20)).cast("decimal(14,2)"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", a.alias("a"), b.alias("b"))


_KEY3 = "l_orderkey, l_linenumber, l_partkey"


@query("c23_equal_within", f"{_PAIR} SELECT {_KEY3}, CASE WHEN a IS NULL AND b IS NULL THEN true WHEN a IS NULL OR b IS NULL THEN false WHEN a = 0 THEN b = 0 ELSE abs(a - b) <= 0.005 * abs(a) END AS same FROM p")
def c23(spark, sf_dir):
    return _pairs(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", A.equal_within(F.col("a"), F.col("b")).alias("same"))


@query("c24_equal_symmetric", f"{_PAIR} SELECT {_KEY3}, CASE WHEN a = 0 AND b = 0 THEN true ELSE abs(a - b) * 1000 <= greatest(abs(a), abs(b)) END AS same FROM p WHERE a IS NOT NULL AND b IS NOT NULL")
def c24(spark, sf_dir):
    return _pairs(spark, sf_dir).where("a is not null and b is not null").select("l_orderkey", "l_linenumber", "l_partkey", A.equal_symmetric(F.col("a"), F.col("b")).alias("same"))


@query("c25_equal_absolute", f"{_PAIR} SELECT {_KEY3}, CASE WHEN a IS NULL OR b IS NULL THEN a IS NOT DISTINCT FROM b ELSE abs(a - b) <= 0.01 END AS same FROM p")
def c25(spark, sf_dir):
    return _pairs(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", A.equal_absolute(F.col("a"), F.col("b")).alias("same"))


_MATCH_SQL = "CASE WHEN a IS NULL AND b IS NULL THEN 'both_blank' WHEN a IS NULL AND b = 0 THEN 'zero_vs_blank' WHEN a IS NULL THEN 'blank' WHEN b IS NULL AND a = 0 THEN 'blank_vs_zero' WHEN b IS NULL THEN 'extra' WHEN a = 0 AND b = 0 THEN 'both_zero' WHEN b = 0 THEN 'not_zero' WHEN abs(a - b) * 50 <= abs(b) THEN 'within' ELSE 'off' END"


@query("c26_cell_match", f"{_PAIR}, m AS (SELECT *, {_MATCH_SQL} AS reason FROM p) SELECT {_KEY3}, reason, reason NOT IN ('blank', 'extra', 'not_zero', 'off') AS ok FROM m")
def c26(spark, sf_dir):
    return _pairs(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", A.cell_match(F.col("a"), F.col("b")).alias("m")).select("l_orderkey", "l_linenumber", "l_partkey", "m.*")


_STATUS_SQL = "CASE WHEN coalesce(a, 0) = 0 AND coalesce(b, 0) = 0 THEN 'BOTH_EMPTY' WHEN coalesce(a, 0) = 0 THEN 'EXTRA' WHEN coalesce(b, 0) = 0 THEN 'MISSING' WHEN abs(b - a) * 50 <= abs(a) THEN 'MATCH' ELSE 'MISMATCH' END"


@query("c27_cell_status", f"{_PAIR} SELECT {_KEY3}, {_STATUS_SQL} AS status FROM p")
def c27(spark, sf_dir):
    return _pairs(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", A.cell_status(F.col("a"), F.col("b")).alias("status"))


@query("c42_magnitude_check", f"{_PAIR} SELECT CASE WHEN a IS NULL OR b IS NULL OR a = 0 OR b = 0 THEN 'none' WHEN abs(b) >= 10 * abs(a) THEN 'larger' WHEN abs(a) >= 10 * abs(b) THEN 'smaller' ELSE 'same' END AS magnitude, count(*) AS n FROM p GROUP BY 1")
def c42(spark, sf_dir):
    a, b = F.abs("a"), F.abs("b")
    kind = F.when(F.col("a").isNull() | F.col("b").isNull() | (a == 0) | (b == 0), "none").when(b >= 10 * a, "larger").when(a >= 10 * b, "smaller").otherwise("same")
    return _pairs(spark, sf_dir).groupBy(kind.alias("magnitude")).agg(F.count("*").alias("n"))


@query("c31_debit_credit_rows", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 2 THEN (o_orderkey % 200)::INTEGER END AS debit, CASE WHEN o_orderkey % 3 <> 2 THEN (o_custkey % 200)::INTEGER END AS credit FROM orders")
def c31(spark, sf_dir):
    note = F.concat(F.lit("Debit balance: R"), (F.col("o_orderkey") % 200).cast("string"), F.when(F.col("o_orderkey") % 3 == 2, "").otherwise(F.concat(F.lit("; credit side:- "), (F.col("o_custkey") % 200).cast("string"))))
    debit, credit = (F.nullif(F.regexp_extract(note, rf"{p}[^:]*:[-\s]*R?(\d+)", 1), F.lit("")).cast("int") for p in ("[Dd]ebit", "[Cc]redit"))
    both = debit.isNotNull() & credit.isNotNull()
    return read(spark, sf_dir, "orders").select("o_orderkey", F.when(both, debit).alias("debit"), F.when(both, credit).alias("credit"))


@query("c32_reply_json", "SELECT event_id, CASE event_id % 3 WHEN 2 THEN 0 ELSE json_extract(props, '$.k')::INTEGER END AS k, event_id % 3 = 2 AS failed FROM events")
def c32(spark, sf_dir):
    reply = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Answer: "), "props", F.lit(" ok"))).otherwise("no idea")
    body = F.regexp_extract(F.regexp_replace(reply, r"```(?:json)?", ""), r"(?s)(\{.*\})", 1)
    parsed = F.from_json(body, "k int")["k"]
    return read(spark, sf_dir, "events").select("event_id", F.coalesce(parsed, F.lit(0)).alias("k"), parsed.isNull().alias("failed"))


@query("c33_context_line", "SELECT document_id, oa, ob, oc, sheet || ' | ' || section || ' | ' || source_text AS line FROM line_items")
def c33(spark, sf_dir):
    return line_items(spark, sf_dir).select("document_id", F.col("ord.a").alias("oa"), F.col("ord.b").alias("ob"), F.col("ord.c").alias("oc"), T.context_line(F.col("sheet"), F.col("section"), F.col("source_text")).alias("line"))


@query("c34_capitalized", "SELECT c_custkey, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS industry FROM customer")
def c34(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", T.capitalized(F.col("c_mktsegment")).alias("industry"))


@query("c35_names_overlap", "SELECT p_partkey, contains(lower(p_name), lower(p_name[1:6])) OR contains(lower(p_name[1:6]), lower(p_name)) AS a, contains(lower(p_brand), lower(p_name)) OR contains(lower(p_name), lower(p_brand)) AS b FROM part")
def c35(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", T.names_overlap(F.col("p_name"), F.substring("p_name", 1, 6)).alias("a"), T.names_overlap(F.col("p_brand"), F.col("p_name")).alias("b"))


@query("c36_indian_digits", r"""WITH v AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN -o_totalprice::DECIMAL(14,2) WHEN o_orderkey % 4 = 1 THEN round(o_totalprice::DECIMAL(14,2), 0) * 1000 ELSE o_totalprice::DECIMAL(14,2) END::DECIMAL(18,2) AS v FROM orders),
s AS (SELECT o_orderkey, v, floor(abs(v))::BIGINT::VARCHAR AS w, right(abs(v)::VARCHAR, 2) AS c FROM v),
h AS (SELECT *, CASE WHEN length(w) > 3 THEN w[1:length(w)-3] ELSE '' END AS front, right(w, 3) AS tail FROM s),
g AS (SELECT *, regexp_replace(CASE WHEN length(front) % 2 = 1 THEN '0' || front ELSE front END, '(\d\d)', '\1,', 'g') AS padded FROM h)
SELECT o_orderkey, CASE WHEN v < 0 THEN '(' ELSE '' END || CASE WHEN length(front) % 2 = 1 THEN padded[2:] ELSE padded END || tail || CASE WHEN c = '00' THEN '' ELSE '.' || c END || CASE WHEN v < 0 THEN ')' ELSE '' END AS text FROM g""")  # fmt: skip
def c36(spark, sf_dir):
    p = F.col("o_totalprice").cast("decimal(14,2)")
    v = F.when(F.col("o_orderkey") % 4 == 0, -p).when(F.col("o_orderkey") % 4 == 1, F.round(p, 0) * 1000).otherwise(p).cast("decimal(18,2)")
    return read(spark, sf_dir, "orders").select("o_orderkey", A.indian_digits(v).alias("text"))


@query("c37_doubt_key", "SELECT c_custkey, replace(replace(replace(lower(c_name || ' & Co-Op  Ltd'), '&', 'and'), '-', ' '), '  ', ' ') AS k FROM customer")
def c37(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", T.doubt_key(F.concat("c_name", F.lit(" & Co-Op  Ltd"))).alias("k"))


@query("c38_token_cost", "SELECT doc_id, n_chars * 80 + length(lang) * 400 AS cost FROM documents")
def c38(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", A.token_cost(F.col("n_chars"), F.length("lang").cast("long")).alias("cost"))


@query("c39_company_names", "SELECT c_custkey, [c_mktsegment || ' Private Limited', 'Acme Ltd'] AS names FROM customer")
def c39(spark, sf_dir):
    text = F.concat(F.lit("1. "), "c_mktsegment", F.lit(" Private Limited; Acme Ltd; ACME LTD; 1 Ltd"))
    return read(spark, sf_dir, "customer").select("c_custkey", T.company_names(text).alias("names"))


@query("b1_client_search", "SELECT id, name FROM clients WHERE name ILIKE '%00001%' AND industry_type = 'building' ORDER BY id DESC")
def b1(spark, sf_dir):
    return clients(spark, sf_dir).where(F.col("name").ilike(f"%{' 00001 '.strip()}%") & (F.col("industry_type") == "building")).select("id", "name").orderBy(F.desc("id"))


@query("b4_section_headers", "SELECT c_custkey, c_mktsegment = upper(c_mktsegment) AS a, c_name = upper(c_name) AND regexp_matches(c_name, '[A-Za-z]') AS b, false AS c FROM customer")
def b4(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", T.is_section_header(F.col("c_mktsegment")).alias("a"), T.is_section_header(F.col("c_name")).alias("b"), T.is_section_header(F.col("c_custkey").cast("string")).alias("c"))


def _cells(spark, sf_dir):
    """Rows of a sheet as cells: a mark, a label, a note number, two amounts."""
    rows = line_items(spark, sf_dir)
    cells = F.array(F.lit("(a)"), F.col("source_text"), F.col("ord.a").cast("string"), F.when(F.col("ord.b") % 3 == 0, "").otherwise(F.col("amount").cast("string")), F.col("qty").cast("string"))
    return rows.select("document_id", F.col("ord.a").alias("oa"), F.col("ord.b").alias("ob"), F.col("ord.c").alias("oc"), cells.alias("cells"))


@query("b5_best_description", "SELECT document_id, oa, ob, oc, CASE WHEN length(amount::VARCHAR) > length(source_text) AND ob % 3 <> 0 THEN amount::VARCHAR ELSE source_text END AS label FROM line_items")
def b5(spark, sf_dir):
    return _cells(spark, sf_dir).select("document_id", "oa", "ob", "oc", T.best_description(F.col("cells")).alias("label"))


@query("b6_first_amount", "SELECT document_id, oa, ob, oc, CASE WHEN ob % 3 <> 0 AND amount >= 100 THEN amount::DOUBLE WHEN qty >= 100 THEN qty::DOUBLE END AS amount FROM line_items")
def b6(spark, sf_dir):
    return _cells(spark, sf_dir).select("document_id", "oa", "ob", "oc", A.first_amount(F.col("cells")).alias("amount"))


@query("b11_total_rows", "SELECT o_orderkey, o_orderkey % 6 IN (0, 1, 3) AS total FROM orders")
def b11(spark, sf_dir):
    label = F.element_at(F.array(*map(F.lit, [" Total ", "TOTAL assets", "Totals", "Sub total of notes", "Net", "subtotal"])), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return read(spark, sf_dir, "orders").select("o_orderkey", T.is_total_row(label).alias("total"))


@query("b12_skip_labels", "SELECT document_id, oa, ob, oc, source_text FROM line_items WHERE source_text NOT IN (SELECT p_name FROM part WHERE p_partkey % 50 = 0)")
def b12(spark, sf_dir):
    skipped = read(spark, sf_dir, "part").where("p_partkey % 50 = 0").select(F.col("p_name").alias("source_text")).distinct()
    return line_items(spark, sf_dir).join(skipped, "source_text", "left_anti").select("document_id", F.col("ord.a").alias("oa"), F.col("ord.b").alias("ob"), F.col("ord.c").alias("oc"), "source_text")


@query("b13_blank_pages", "SELECT vec_id, stddev_pop(round(x::DOUBLE * 100)) > 10 AS kept FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) GROUP BY vec_id")
def b13(spark, sf_dir):
    pixels = read(spark, sf_dir, "embeddings").select("vec_id", F.explode("embedding").alias("x"))
    return pixels.groupBy("vec_id").agg((F.stddev_pop(F.round(F.col("x").cast("double") * 100)) > 10).alias("kept"))


_RANGES = "1-3, 7, 12-10, abc, 0, 99, 2"


@query("b14_page_ranges", "SELECT o_orderkey, list_filter([1, 2, 3, 7, 10, 11, 12], lambda n: n <= o_orderkey % 15) AS pages FROM orders")
def b14(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", T.page_ranges(F.lit(_RANGES), (F.col("o_orderkey") % 15).cast("int")).alias("pages"))


@query("b15_pages_kept", "SELECT o_orderkey, list_filter(range(1, (o_orderkey % 15 + 1)::BIGINT), lambda n: n NOT IN (1, 2, 3, 7, 10, 11, 12)) AS pages FROM orders")
def b15(spark, sf_dir):
    total = (F.col("o_orderkey") % 15).cast("int")
    return read(spark, sf_dir, "orders").select("o_orderkey", T.complement(T.page_ranges(F.lit(_RANGES), total), total).alias("pages"))


@query("b17_whitelist", "SELECT document_id, line_no, part_id, CASE WHEN f.cma_row IS NULL THEN 0 ELSE c.cma_row END AS cma_row, (CASE WHEN f.cma_row IS NULL THEN least(confidence, 0.40) ELSE confidence END)::DOUBLE AS confidence, f.cma_row IS NULL OR is_doubt AS is_doubt, CASE WHEN f.cma_row IS NULL THEN 'row ' || c.cma_row || ' not allowed' END AS reason FROM classifications c LEFT JOIN fields f ON c.cma_row = f.cma_row")
def b17(spark, sf_dir):
    valid = fields(spark).select(F.col("cma_row").alias("valid_row"))
    out = classifications(spark, sf_dir).join(valid, F.col("cma_row") == F.col("valid_row"), "left")
    bad = F.col("valid_row").isNull()
    return out.select("document_id", "line_no", "part_id", F.when(bad, 0).otherwise(F.col("cma_row")).alias("cma_row"), F.when(bad, F.least("confidence", F.lit("0.40").cast("decimal(6,2)"))).otherwise(F.col("confidence")).cast("double").alias("confidence"), (bad | F.col("is_doubt")).alias("is_doubt"), F.when(bad, F.concat(F.lit("row "), F.col("cma_row").cast("string"), F.lit(" not allowed"))).alias("reason"))


@query("b18_bulk_approve", "SELECT c.document_id, line_no, part_id FROM classifications c JOIN statements s ON c.document_id = s.id WHERE c.status = 'auto_classified' AND NOT is_doubt AND confidence >= 0.82 AND client_id % 3 = 1")
def b18(spark, sf_dir):
    docs = statements(spark, sf_dir).where("client_id % 3 = 1").select(F.col("id").alias("document_id"))
    found = classifications(spark, sf_dir).where((F.col("status") == "auto_classified") & ~F.col("is_doubt") & (F.col("confidence") >= 0.82))
    return found.join(docs, "document_id").select("document_id", "line_no", "part_id")


@query("b19_review_list", "SELECT document_id, line_no, part_id FROM classifications WHERE status IN ('needs_review', 'auto_classified') OR is_doubt")
def b19(spark, sf_dir):
    return classifications(spark, sf_dir).where(F.col("status").isin("needs_review", "auto_classified") | F.col("is_doubt")).select("document_id", "line_no", "part_id")


@query("b21_own_documents", "SELECT id FROM statements WHERE uploaded_by = 3")
def b21(spark, sf_dir):
    admin, user = False, 3
    return statements(spark, sf_dir).where(F.lit(admin) | (F.col("uploaded_by") == user)).select("id")


@query("b22_rollover_filter", "SELECT p_partkey FROM part WHERE p_partkey % 5 IN (0, 1)")
def b22(spark, sf_dir):
    kind = F.element_at(F.array(F.lit("Fixed Assets"), F.lit("net worth"), F.lit("Income"), F.lit(None), F.lit("other assets")), (F.col("p_partkey") % 5 + 1).cast("int"))
    return read(spark, sf_dir, "part").where(F.translate(F.lower(F.coalesce(kind, F.lit(""))), " ", "_").isin(A.BALANCE_SHEET)).select("p_partkey")


@query("b23_forbidden_cells", "SELECT c.document_id, c.line_no, c.part_id, c.cma_row FROM classifications c WHERE c.cma_row NOT IN (SELECT cma_row FROM fields) AND amount <> 0")
def b23(spark, sf_dir):
    return classifications(spark, sf_dir).join(fields(spark), "cma_row", "left_anti").where("amount <> 0").select("document_id", "line_no", "part_id", "cma_row")


@query("c43_formula_template", "SELECT document_id, line_no, part_id, replace('=B' || cma_row || '+C' || cma_row || '*' || amount::VARCHAR, cma_row::VARCHAR, '[ROW]') AS template FROM classifications")
def c43(spark, sf_dir):
    row = F.col("cma_row").cast("string")
    formula = F.concat(F.lit("=B"), row, F.lit("+C"), row, F.lit("*"), F.col("amount").cast("string"))
    return classifications(spark, sf_dir).select("document_id", "line_no", "part_id", F.replace(formula, row, F.lit("[ROW]")).alias("template"))


@query("b20_field_search", "SELECT id, name, industry_type FROM clients WHERE contains(lower(name), lower('UI')) OR contains(lower(industry_type), lower('UI'))")
def b20(spark, sf_dir):
    asked = F.lower(F.lit("UI"))
    return clients(spark, sf_dir).where(F.contains(F.lower("name"), asked) | F.contains(F.lower("industry_type"), asked)).select("id", "name", "industry_type")


@query("b24_row_range", "SELECT document_id, line_no, part_id, cma_row FROM classifications WHERE cma_row BETWEEN 161 AND 258 AND cma_row NOT IN (200, 201) ORDER BY cma_row, document_id, line_no, part_id")
def b24(spark, sf_dir):
    rows = classifications(spark, sf_dir).where(F.col("cma_row").between(161, 258) & ~F.col("cma_row").isin(200, 201))
    return rows.select("document_id", "line_no", "part_id", "cma_row").orderBy("cma_row", "document_id", "line_no", "part_id")
