import pytest
from pyspark.sql import functions as F

from tallymill.functions import amounts as A, ratios, text as T


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("raw", "amount"),
    [("1,23,456", 123456), ("1,234,567", 1234567), ("500000", 500000), ("1,23,456.78", 123456.78), ("", None), ("N/A", None), ("1,00,00,000", 10000000), ("(1,23,456)", -123456), ("-500000", -500000), ("₹(45,00,000)", -4500000), ("12d", None), (None, None)],
)
def test_amounts(spark, raw, amount):
    assert one(spark, A.parse_amount, raw) == amount


@pytest.mark.parametrize(("raw", "label"), [("Item 1 (i) : Domestic sales", "Domestic sales"), ("Note 3 - Depreciation", "Depreciation"), ("1. Salaries & Wages", "Salaries & Wages"), ("a) Travel expenses", "Travel expenses"), ("  Raw Materials  ", "Raw Materials")])
def test_labels(spark, raw, label):
    assert one(spark, T.line_label, raw) == label


@pytest.mark.parametrize(("a", "b", "same"), [(200, 201, True), (200, 202, False), (10000, 10050, True), (10000, 10051, False), (0, 0, True), (0, 1, False), (None, None, True), (None, 3, False)])
def test_amounts_within(spark, a, b, same):
    row = spark.createDataFrame([(a, b)], "a long, b long").select(A.equal_within(F.col("a").cast("decimal(12,2)"), F.col("b").cast("decimal(12,2)")).alias("y"))
    assert row.first().y == same


@pytest.mark.parametrize(("spec", "total", "pages"), [("1-3, 7, 10-12", 15, [1, 2, 3, 7, 10, 11, 12]), ("abc, 1-2", 9, [1, 2]), ("0, 100", 10, []), ("5-3", 9, [3, 4, 5]), ("8-12", 10, [8, 9, 10]), ("1-3, 2, 3", 9, [1, 2, 3])])
def test_page_ranges(spark, spec, total, pages):
    assert one(spark, lambda c: T.page_ranges(c, F.lit(total)), spec) == pages


@pytest.mark.parametrize(("values", "text"), [([50000], "=50000"), ([50000, 30000, -5000], "=50000+30000-5000"), ([-1000, -2000], "=-1000-2000"), ([100.5, 200.75], "=100.50+200.75"), ([], "=0"), ([0, 5000], "=0+5000")])
def test_formulas(spark, values, text):
    assert one(spark, lambda c: A.formula(F.transform(c, A.number_token)), [float(v) for v in values], "array<double>") == text


def test_formula_of_no_number(spark):
    assert one(spark, A.number_token, float("nan"), "double") == "0"
    assert one(spark, A.evaluate_sum, "=1.50+2-0.25").__str__() == "3.25"
    assert one(spark, A.evaluate_sum, "=A1+2") is None


def test_indian_digits(spark):
    for value, text in [("1234567.89", "12,34,567.89"), ("-1234.00", "(1,234)"), ("100.00", "100"), ("12345.50", "12,345.50")]:
        assert one(spark, lambda c: A.indian_digits(c.cast("decimal(20,2)")), value) == text


def test_scores():
    assert ratios.token_set("sales revenue", "revenue sales net") == 100
    assert ratios.token_sort("b a", "a b") == 100
    assert ratios.token_set("", "a") == 0
    assert ratios.ratio("", "") == 100
    assert 80 < ratios.ratio("salary expenses", "salary expense") < 100
    assert ratios.common_length("abcde", "xbxdx") == 2


def test_sheets(spark):
    assert [one(spark, T.is_relevant_sheet, s) for s in ("P & L", "Trial Balance", "Index", "", "Notes BS (2)")] == [True, False, False, False, True]
    assert one(spark, T.sheet_page_type, "Notes BS (2)") == "notes"
    assert one(spark, T.company_names, "Acme Ltd; ACME LTD; Bolt Private Limited") == ["Acme Ltd", "Bolt Private Limited"]


def test_page_types_and_scales_of_replies(spark):
    assert [one(spark, T.page_type, x) for x in ("profit_and_loss", "schedules", "cover", None)] == ["face", "notes", "unknown", "unknown"]
    assert [one(spark, A.scale, x) for x in ("in_lakhs", "lakhs", None)] == [100_000, 1, 1]


def test_scores_under_sql_names(spark):
    from tallymill.functions import ratios, sql_names

    sql_names.register(spark)
    rows = spark.createDataFrame([("rent paid", "paid rents"), (None, "x"), ("", "")], "a string, b string")
    found = spark.sql("SELECT a, s.scorer, s.score FROM {rows}, LATERAL text_scores('token_sort, sequence,token_set', a, b) s", rows=rows).collect()
    assert {(r.a, r.scorer): r.score for r in found} == {(a, n): f(a, b) for a, b in (("rent paid", "paid rents"), ("", "")) for n, f in sql_names.SCORERS.items()}
    row = spark.sql("SELECT token_sort_ratio(a, b) AS x, sequence_ratio(a, b) AS y FROM {rows} WHERE a LIKE 'rent%'", rows=rows).first()
    assert (row.x, row.y) == (ratios.token_sort("rent paid", "paid rents"), ratios.sequence("rent paid", "paid rents"))
    with pytest.raises(Exception, match="nonsense"):
        spark.sql("SELECT * FROM {rows}, LATERAL text_scores('nonsense', a, b)", rows=rows).collect()
