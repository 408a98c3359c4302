"""Column functions over amounts, units, years and cells. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values.
UNIT_DIVISOR = {"rupees": 1, "thousands": 1_000, "lakhs": 100_000, "crores": 10_000_000}
SCALE = {"absolute": 1, "in_thousands": 1_000, "in_lakhs": 100_000, "in_crores": 10_000_000}
YEAR_COLUMNS = "BCDEFGHIJKLM"
BUCKETS = [("pl_income", 22, 34), ("pl_expense", 41, 108), ("bs_liability", 110, 160), ("bs_asset", 161, 258)]
REAL_FORMULA = r"[A-Za-z][A-Za-z0-9]*\(|[A-Za-z]{1,3}\d+|!|:"
BALANCE_SHEET = ["assets", "liabilities", "net_worth", "capital", "fixed_assets", "current_assets", "current_liabilities", "term_liabilities", "investments", "intangible_assets", "total_assets", "total_liabilities"]
PL_WORDS = ["revenue", "income", "expense", "depreciation", "interest", "tax", "profit", "loss", "sales", "cost of", "employee", "finance", "manufacturing", "other expenses"]
BS_WORDS = ["asset", "liability", "capital", "reserve", "loan", "inventory", "debtor", "creditor", "investment", "cash", "bank balance", "fixed asset", "current"]


def parse_amount(x: Column) -> Column:
    """An amount in Indian or Western digits, negative in brackets or after a minus; null for blanks and anything else."""
    bare = F.regexp_replace(F.trim(x), r"^[₹$ ]+", "")
    negative = bare.startswith("(") & bare.endswith(")") | bare.startswith("-")
    digits = F.trim(F.replace(F.regexp_replace(F.regexp_replace(bare, r"^[( -]+", ""), r"[) ]+$", ""), F.lit(","), F.lit("")))
    value = F.when(F.rlike(digits, F.lit(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")), digits.cast("double"))
    return F.when(negative, -value).otherwise(value)


def first_amount(cells: Column, least: float = 100.0) -> Column:
    """The first of cells 2 to 10 that is an amount of at least this size."""
    return F.try_element_at(F.filter(F.transform(F.slice(cells, 2, 9), parse_amount), lambda v: F.abs(v) >= least), F.lit(1))


def divisor(source_unit: Column, out_unit: Column) -> Column:
    """What an amount is divided by to get to the output unit; an unknown source counts as 1, an unknown output as lakhs."""
    of = lambda u, other: F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in UNIT_DIVISOR.items() for v in kv]), F.lower(u)), F.lit(other))
    return F.try_divide(of(out_unit, 100_000).cast("double"), of(source_unit, 1).cast("double"))


def scale(name: Column) -> Column:
    """What amounts of a page are multiplied by, as the page's reply names it; 1 for any other name and for null."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in SCALE.items() for v in kv]), name), F.lit(1))


def converted(amount: Column, source_unit: Column, out_unit: str = "lakhs") -> Column:
    """An amount as decimal in the output unit, to two places; amounts already in that unit stay as they are. Exact: the factor is a power of ten."""
    out = UNIT_DIVISOR[out_unit]
    result = F.round(amount, 2)
    for unit, n in UNIT_DIVISOR.items():
        factor = F.lit(n).cast("decimal(10,0)") / F.lit(out).cast("decimal(10,0)")
        result = F.when(source_unit == unit, F.round(amount * factor.cast("decimal(14,7)"), 2)).otherwise(result)
    return result.cast("decimal(18,2)")


def number_token(v: Column) -> Column:
    """A number in a formula: whole if it is, else two places; 0 for what is no number. v: double or decimal."""
    whole, value = F.round(v.cast("decimal(20,2)"), 0), v.cast("decimal(20,2)")
    return F.when(F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")), "0").when(value == whole, whole.cast("bigint").cast("string")).otherwise(value.cast("string"))


def formula(tokens: Column) -> Column:
    """=a+b-c from number tokens in order; =0 from none."""
    signed = F.transform(tokens, lambda t, i: F.when((i > 0) & ~t.startswith("-"), F.concat(F.lit("+"), t)).otherwise(t))
    return F.when(F.size(tokens) == 0, "=0").otherwise(F.concat(F.lit("="), F.array_join(signed, "")))


def is_real_formula(x: Column) -> Column:
    return F.coalesce(x.startswith("=") & F.rlike(x, F.lit(REAL_FORMULA)), F.lit(False))


def evaluate_sum(x: Column) -> Column:
    """The value of a formula of decimal literals with + and -; null if it holds anything else."""
    plain = F.rlike(x, F.lit(r"^=[+-]?\d+(\.\d+)?([+-]\d+(\.\d+)?)*$"))
    terms = F.transform(F.regexp_extract_all(x, F.lit(r"([+-]?\d+(?:\.\d+)?)"), 1), lambda t: t.cast("decimal(20,2)"))
    return F.when(plain, F.aggregate(terms, F.lit(0).cast("decimal(30,2)"), lambda a, t: (a + t).cast("decimal(30,2)")))


def year_column(year: Column, base: Column) -> Column:
    """The letter of a year's column, counted from the base year in column B; null out of range."""
    offset = year - base
    return F.when(offset.between(0, len(YEAR_COLUMNS) - 1), F.substr(F.lit(YEAR_COLUMNS), offset + 1, F.lit(1)))


def financial_year(x: Column) -> Column:
    """2022-23 as 2023; a year as it is; other texts unchanged."""
    end = F.regexp_extract(x, r"^(\d{4})-(\d{2}|\d{4})$", 2)
    return F.when(F.length(end) == 2, F.concat(F.lit("20"), end)).when(F.length(end) == 4, end).otherwise(x)


def bucket(row: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, first, last in reversed(BUCKETS):
        out = F.when(row.between(first, last), name).otherwise(out)
    return out


def document_context(row: Column, sheet: Column, section: Column) -> Column:
    """pl or bs by row, else by the sheet's name, else by words of the section; unknown if none of them tells."""
    sheet, section = F.lower(F.coalesce(sheet, F.lit(""))), F.lower(F.coalesce(section, F.lit("")))
    has = lambda x, words: F.rlike(x, F.lit("|".join(words)))
    return (
        F.when(row.between(22, 108), "pl").when(row >= 116, "bs").when(has(sheet, ["p & l", "p&l", "profit", "loss"]), "pl").when(has(sheet, ["balance", "b/s"]), "bs")
        .when(has(section, PL_WORDS), "pl").when(has(section, BS_WORDS), "bs").otherwise("unknown")
    )


def equal_within(a: Column, b: Column, percent: str = "0.005") -> Column:
    """Whether b is within half a percent of a, relative to a; two nulls are equal, and zero only to zero. a, b: decimals."""
    part = F.lit(percent).cast("decimal(6,4)")
    return F.when(a.isNull() & b.isNull(), True).when(a.isNull() | b.isNull(), False).when(a == 0, b == 0).otherwise(F.abs(a - b) <= part * F.abs(a))


def equal_symmetric(a: Column, b: Column) -> Column:
    """Whether two amounts differ by a thousandth of the larger or less. a, b: decimals."""
    return F.when((a == 0) & (b == 0), True).otherwise(F.abs(a - b) * 1000 <= F.greatest(F.abs(a), F.abs(b)))


def equal_absolute(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), a.eqNullSafe(b)).otherwise(F.abs(a - b) <= F.lit("0.01").cast("decimal(4,2)"))


def cell_match(made: Column, truth: Column) -> Column:
    """(ok, reason) of a made cell against its true value, within two percent. Decimals."""
    zero = F.lit(0)
    reason = (
        F.when(made.isNull() & truth.isNull(), "both_blank").when(made.isNull() & (truth == zero), "zero_vs_blank").when(made.isNull(), "blank")
        .when(truth.isNull() & (made == zero), "blank_vs_zero").when(truth.isNull(), "extra").when((made == zero) & (truth == zero), "both_zero")
        .when((truth == zero) & (F.abs(made) < F.lit("0.001").cast("decimal(6,3)")), "near_zero").when(truth == zero, "not_zero")
        .when(F.abs(made - truth) * 50 <= F.abs(truth), "within").otherwise("off")
    )
    return F.struct(reason.isin("both_blank", "zero_vs_blank", "blank_vs_zero", "both_zero", "near_zero", "within").alias("ok"), reason.alias("reason"))


def cell_status(expected: Column, actual: Column) -> Column:
    """BOTH_EMPTY, EXTRA, MISSING, MATCH or MISMATCH; zero counts as empty. Decimals."""
    none = lambda x: x.isNull() | (x == 0)
    return F.when(none(expected) & none(actual), "BOTH_EMPTY").when(none(expected), "EXTRA").when(none(actual), "MISSING").when(F.abs(actual - expected) * 50 <= F.abs(expected), "MATCH").otherwise("MISMATCH")


def indian_digits(x: Column) -> Column:
    """12,34,567.89 with negative amounts in brackets; places only where there are any. x: decimal."""
    size = F.abs(x).cast("decimal(20,2)")
    whole = F.floor(size).cast("bigint").cast("string")
    last = F.right(whole, F.lit(3))
    front = F.substr(whole, F.lit(1), F.greatest(F.length(whole) - 3, F.lit(0)))
    padded = F.when(F.length(front) % 2 == 1, F.concat(F.lit("0"), front)).otherwise(front)
    groups = F.regexp_replace(F.regexp_replace(padded, r"(\d{2})", "$1,"), "^0", "")
    cents = F.substring_index(size.cast("string"), ".", -1)
    text = F.concat(groups, last, F.when(cents == "00", "").otherwise(F.concat(F.lit("."), cents)))
    return F.when(x < 0, F.concat(F.lit("("), text, F.lit(")"))).otherwise(text)


def token_cost(tokens_in: Column, tokens_out: Column) -> Column:
    """Price of a model call, in millionths: 0.80 and 4.00 for a million tokens."""
    return tokens_in * 80 + tokens_out * 400
