"""Column functions over labels, names and other short texts. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Prefixes that statements put before a label.
NOTE_PREFIX = r"(?i)^(?:(?:Item|Note|Particulars)\s*\d*\s*(?:\([^)]*\))?\s*[:.\-]\s*)"
# Fixed value: a number before a label.
NUMBERED = r"^\d+[.)]\s*"
# Fixed value: a letter before a label.
LETTERED = r"(?i)^[a-z][.)]\s*"
#: Labels too short to describe anything. Fixed value.
PREFIX_ONLY = r"(?i)^(?:\(?[a-z0-9]{1,3}\)?\.?|[IVXLC]{1,4}\.?|SL\.?\s*NO\.?|NOTE\s*NO\.?|PARTICULARS)$"
#: Names of sheets that hold a summary, and of those that never do. Fixed values.
SUMMARY_SHEET = r"(?i)(?:balance\s*sheet|b\.?\s*s\.?|p\s*[&.]\s*l|profit|loss|income|expense|cash\s*flow|notes?\b|co\.?,?\s*deprn|company\s*depreciation|trading|manufacturing|receipt\s*(?:and|&)\s*payment|statement|particulars)"
SKIPPED_SHEET = r"(?i)(?:ledger|g\.?\s*l\.?|general\s*ledger|ageing|aging|msme|related\s*party|ratio|audit|director|report|annexure|stock\s*(?:register|detail|ledger)|day\s*book|journal|voucher|bank\s*book|gst|tds|tax\s*(?:detail|computation)|party|sundry|debtor|creditor|memo|comparison|capital\s*wip|emi|e\.m\.i|def\s*tax|deferred\s*tax|depn\s*[-_]?\s*it|depreciation\s*chart|sub\s*notes?\b|pivot|share\s*hold|trial\s*balance|\btb\b)"
# Fixed value: names of sheets with notes.
NOTE_SHEET = r"(?i)(?:notes?\b|schedule|particular|statement\s*of)"
# Fixed value: names of sheets with the statements themselves.
FACE_SHEET = r"(?i)(?:balance\s*sheet|b\.?\s*s\.?|p\s*[&.]\s*l|profit\s*(?:and|&)?\s*loss|income\s*statement|cash\s*flow|trading|manufacturing|receipt\s*(?:and|&)\s*payment)"
#: Page types of model replies. Fixed values.
FACE_PAGES = ["profit_and_loss", "balance_sheet", "trading_account"]
NOTE_PAGES = ["notes_to_accounts", "schedules"]
#: A company's name ends with its legal form. Fixed value.
COMPANY = r"(?i)([A-Z][A-Za-z\s&.\-]+?(?:Private\s+Limited|Pvt\.?\s*Ltd\.?|Corporation\s+Limited|Limited|Ltd\.?|LLP))"


def strip(x: Column) -> Column:
    """Without white space at either end, tabs and line ends included."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def collapse(x: Column) -> Column:
    return strip(F.regexp_replace(x, r"(?U)\s+", " "))


def line_label(x: Column) -> Column:
    """A label without a note prefix, a number and a letter before it, each taken off once."""
    for prefix in (NOTE_PREFIX, NUMBERED, LETTERED):
        x = F.regexp_replace(strip(x), prefix, "") if prefix is NOTE_PREFIX else F.regexp_replace(x, prefix, "")
    return strip(x)


def diff_key(x: Column) -> Column:
    """The key that two statements' lines are matched by."""
    return collapse(F.lower(line_label(x)))


def mapping_key(x: Column) -> Column:
    """The key of a learned mapping; inner white space stays."""
    return F.lower(strip(line_label(x)))


def fuzzy_text(x: Column) -> Column:
    """Lower case without what stands in brackets and signs other than & and /."""
    return collapse(F.regexp_replace(F.regexp_replace(F.lower(x), r"\(.*?\)", ""), r"(?U)[^\w\s&/]", ""))


def group_text(x: Column) -> Column:
    """fuzzy_text without a first token that only numbers the line."""
    return strip(F.regexp_replace(fuzzy_text(x), r"^[()a-z0-9]+\s+", ""))


def rule_text(x: Column) -> Column:
    return F.coalesce(collapse(F.regexp_replace(F.lower(x), r"[(){}\[\]]", "")), F.lit(""))


def statement_kind(x: Column) -> Column:
    """pl or bs from a free name of the statement; blank counts as pl, anything else stays."""
    low = strip(F.lower(x))
    return F.when(F.coalesce(x, F.lit("")) == "", "pl").when(low.isin("pl", "p&l", "profit and loss", "profit & loss"), "pl").when(low.isin("bs", "balance sheet"), "bs").otherwise(low)


def clean(x: Column) -> Column:
    return F.coalesce(collapse(x), F.lit(""))


def capitalized(x: Column) -> Column:
    """First letter upper case, all others lower."""
    return F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substr(x, F.lit(2))))


def doubt_key(x: Column) -> Column:
    return F.replace(F.replace(F.replace(F.lower(x), F.lit("&"), F.lit("and")), F.lit("-"), F.lit(" ")), F.lit("  "), F.lit(" "))


def context_line(*parts: Column) -> Column:
    return F.concat_ws(" | ", *[strip(F.coalesce(p, F.lit(""))) for p in parts])


def names_overlap(a: Column, b: Column) -> Column:
    """Whether one name holds the other, without regard to case."""
    a, b = F.lower(a), F.lower(b)
    return F.contains(a, b) | F.contains(b, a)


def is_relevant_sheet(name: Column) -> Column:
    """A sheet is read if its name speaks of a summary and of nothing to skip; unknown and blank names are not."""
    return (strip(name) != "") & ~F.rlike(name, F.lit(SKIPPED_SHEET)) & F.rlike(name, F.lit(SUMMARY_SHEET))


def sheet_priority(name: Column) -> Column:
    return F.when(F.rlike(name, F.lit(NOTE_SHEET)), 3).when(F.rlike(name, F.lit(FACE_SHEET)), 1).otherwise(2)


def sheet_page_type(name: Column) -> Column:
    """Notes come first: a sheet may name both."""
    return F.when(F.rlike(name, F.lit(NOTE_SHEET)), "notes").when(F.rlike(name, F.lit(FACE_SHEET)), "face").otherwise("unknown")


def page_type(name: Column) -> Column:
    """Kind of a page from its type in a model's reply."""
    return F.when(name.isin(FACE_PAGES), "face").when(name.isin(NOTE_PAGES), "notes").otherwise("unknown")


def is_section_header(label: Column) -> Column:
    label = strip(label)
    return (label == F.upper(label)) & F.rlike(label, F.lit(r"\p{L}"))


def best_description(cells: Column) -> Column:
    """The longest of the first six cells that is more than a prefix; the first among equals; empty if there is none."""
    texts = F.filter(F.transform(F.slice(cells, 1, 6), strip), lambda c: c.isNotNull() & (F.length(c) >= 2) & ~F.rlike(c, F.lit(PREFIX_ONLY)))
    return F.aggregate(texts, F.lit(""), lambda best, c: F.when(F.length(c) > F.length(best), c).otherwise(best))


def is_total_row(label: Column) -> Column:
    low = strip(F.lower(label))
    return low.isin("total", "sub total", "sub-total", "grand total", "net total") | low.startswith("total ") | low.startswith("sub total")


def page_ranges(spec: Column, total: Column) -> Column:
    """The pages that "1-3, 7, 12-10" names, ascending and once each, within 1 and total; parts that are no numbers are passed over."""
    parts = F.filter(F.split(spec, ","), lambda p: F.rlike(p, F.lit(r"^\s*\d+\s*(-\s*\d+\s*)?$")))
    one = lambda p, g: F.regexp_extract(p, r"^\s*(\d+)\s*(?:-\s*(\d+)\s*)?$", g)

    def pages(p: Column) -> Column:
        a = one(p, 1).cast("int")
        b = F.when(one(p, 2) == "", a).otherwise(F.nullif(one(p, 2), F.lit("")).cast("int"))
        return F.sequence(F.least(a, b), F.greatest(a, b))

    every = F.flatten(F.transform(parts, pages))
    return F.array_sort(F.array_distinct(F.filter(every, lambda n: (n >= 1) & (n <= total))))


def complement(pages: Column, total: Column) -> Column:
    return F.when(total < 1, F.array().cast("array<int>")).otherwise(F.array_except(F.sequence(F.lit(1), total), pages))


def company_names(text: Column) -> Column:
    """Company names in order of appearance, once each without regard to case, longer than three characters."""
    found = F.filter(F.transform(F.regexp_extract_all(text, F.lit(COMPANY), 1), strip), lambda n: F.length(n) > 3)
    keys = F.transform(found, F.lower)
    return F.filter(found, lambda n, i: F.array_position(keys, F.lower(n)) == i + 1)


def occurrences(text: Column, term: Column) -> Column:
    """How often a term stands in a text, without regard to case or overlap."""
    low, term = F.lower(text), F.lower(term)
    return F.when(F.length(term) == 0, 0).otherwise(((F.length(low) - F.length(F.replace(low, term, F.lit("")))) / F.length(term)).cast("int"))
