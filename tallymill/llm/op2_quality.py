"""Quality rules with thresholds from the data: quantile sketches of each language and source decide what is unusual there.

A sketch is a histogram over the leading seven bits of a whole number: counts of two sketches add up to the sketch of both inputs, and
a quantile read from it is at most 1/64 below the true one. So sketches are plain partial aggregates, merged up from (language, source)
to language and to the whole corpus, and a hot source costs no task more rows than its histogram has.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import LongType

from tallymill.llm.common import stash, table, with_fields

#: Base rules, as fixed by the contract.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"
#: Feature -> (numerator, scale, denominator, two-sided, quantiles of the fence in percent, tolerance).
#: A share that ordinary texts hardly have marks junk, of which a source may hold a lot: its fence rests on the quartiles. Of others
#: ordinary texts have long tails: the fence lies beyond the highest hundredth.
FEATURES = {
    "symbols": ("n_symbols", 1000, "n_words", False, (25, 75), 20),
    "shout": ("n_upper", 1000, "word_chars", False, (75, 99), 20),
    "dup_lines": ("n_dup_lines", 1000, "n_lines", False, (75, 99), 20),
    "repeats": ("n_repeat_words", 1000, "n_words", False, (75, 99), 20),
    "word_length": ("word_chars", 100, "n_words", True, (25, 75), 20),
}
#: A fence stands this many times the distance of its two quantiles off them, by the lower quantile in percent; the tolerance at least.
FENCE = {25: 3, 75: 1}
QUANTILES = (25, 75, 99)
#: A (language, source) with fewer passing documents uses its language's sketch, a language with fewer the corpus's.
MIN_GROUP = 100
#: Up to so many (language, source) rows of five small numbers are broadcast; beyond, the join is shuffled.
BROADCAST_GROUPS = 50_000

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines"]
_upper = re.compile("[A-ZÀ-ÖØ-Þ]")


def count_text(text: str | None) -> tuple[int, ...]:
    """The COUNTS of one text; null has none of anything."""
    if not text:
        return (0,) * len(COUNTS)
    flat = text
    for blank in "\t\x0b\x0c\r":
        if blank in flat:
            flat = flat.replace(blank, " ")
    words = [w for w in flat.replace("\n", " ").split(" ") if w]
    lines = [line for raw, line in zip(flat.split("\n"), text.split("\n"), strict=True) if raw.strip(" ")]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        times, upto = Counter(windows), 0
        for i, w in enumerate(windows):
            if times[w] > 1:
                repeated += i + 3 - max(i, upto)
                upto = i + 3
    chars = sum(map(len, words))
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(_upper.findall(text)), len(lines)


def with_counts(docs: DataFrame, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """The kept columns (all by default) and COUNTS, in one pass over whole texts. A column that already has such a name gives way."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in COUNTS]
    position = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                counts = zip(*map(count_text, part.column(position).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([*part.columns[:position], *[pa.array(c, pa.int64()) for c in counts]], [*keep, *COUNTS])

    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).alias("_whole_text"))
    return rows.mapInArrow(run, with_fields(rows.schema[:position], {c: LongType() for c in COUNTS}))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _value(name: str) -> Column:
    numerator, scale, denominator, *_ = FEATURES[name]
    return F.expr(f"{scale} * {numerator} div greatest({denominator}, 1)")


def _bucket(value: Column) -> Column:
    drop = F.greatest(F.lit(0), F.length(F.bin(value)) - 7)
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def sketches(counted: DataFrame) -> DataFrame:
    """(lang, source, feature, bucket, n) over the documents that pass the base rules; sketches merge by adding n."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), _bucket(_value(f)).alias("bucket")) for f in FEATURES]))
    return counted.where(~base_failed()).select("lang", "source", each.alias("x")).groupBy("lang", "source", "x.feature", "x.bucket").agg(F.count("*").alias("n"))


def _quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, feature, total, q25, q75, q99) of merged sketches. The window runs over the buckets of a histogram, never over documents."""
    merged = sketch.groupBy(*keys, "feature", "bucket").agg(F.sum("n").alias("n"))
    by = Window.partitionBy(*keys, "feature")
    ranked = merged.select("*", F.sum("n").over(by).alias("total"), F.sum("n").over(by.orderBy("bucket")).alias("upto"))
    at = lambda p: F.min(F.when(100 * F.col("upto") >= p * F.col("total"), F.col("bucket")))
    return ranked.groupBy(*keys, "feature", "total").agg(*[at(p).alias(f"q{p}") for p in QUANTILES])


def thresholds(sketch: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """(lang, source, <feature>_high ..., word_length_low): the fences of each (language, source), from its own sketch or the first larger one with enough documents. Null languages and sources are groups like others."""
    groups = sketch.select("lang", "source", "feature").distinct()
    own, lang, all_ = (_quantiles(sketch, keys) for keys in (["lang", "source"], ["lang"], []))
    rows = groups.alias("g")
    for name, level, keys in (("own", own, ["lang", "source"]), ("lang", lang, ["lang"]), ("all", all_, [])):
        rows = rows.join(level.alias(name), [F.col(f"g.{k}").eqNullSafe(F.col(f"{name}.{k}")) for k in [*keys, "feature"]])
    pick = lambda q: F.when(F.col("own.total") >= min_group, F.col(f"own.{q}")).when(F.col("lang.total") >= min_group, F.col(f"lang.{q}")).otherwise(F.col(f"all.{q}"))
    rows = rows.select("g.lang", "g.source", "g.feature", *[pick(f"q{p}").alias(f"q{p}") for p in QUANTILES])
    sides = []
    for name, (_, _, _, two_sided, (low, high), tolerance) in FEATURES.items():
        is_it, width = F.col("feature") == name, F.greatest(FENCE[low] * (F.col(f"q{high}") - F.col(f"q{low}")), F.lit(tolerance))
        sides.append(F.max(F.when(is_it, F.col(f"q{high}") + width)).alias(f"{name}_high"))
        if two_sided:
            sides.append(F.max(F.when(is_it, F.col(f"q{low}") - width)).alias(f"{name}_low"))
    return rows.groupBy("lang", "source").agg(*sides)


def judge(counted: DataFrame, fences: DataFrame) -> DataFrame:
    """Adds base_failed and kept. A group none of whose documents pass the base rules has no fences and needs none."""
    fences = stash(fences, "fences")
    renamed = fences.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *[F.col(c).alias(f"_{c}") for c in fences.columns[2:]])
    small = F.broadcast(renamed) if fences.count() <= BROADCAST_GROUPS else renamed
    within = F.lit(True)
    for name, (_, _, _, two_sided, *_) in FEATURES.items():
        within &= _value(name) <= F.col(f"_{name}_high")
        if two_sided:
            within &= _value(name) >= F.col(f"_{name}_low")
    joined = counted.join(small, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    return joined.select(*[F.col(f"`{c}`") for c in counted.columns], base_failed().alias("base_failed"), (~base_failed() & F.coalesce(within, F.lit(False))).alias("kept"))


def assess(docs: DataFrame) -> DataFrame:
    """(doc_id, COUNTS, base_failed, kept), a row for each row. Null texts count as having no words and fail; an empty table gives no rows; extra columns are not looked at."""
    counted = stash(with_counts(docs, ["doc_id", "lang", "source"]), "counts")
    return judge(counted, thresholds(sketches(counted)))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs whose text is kept, unchanged, whatever other columns they have. Texts are counted again where they are filtered, rather than shuffled to a stored verdict."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_all"), "lang", "source", "text")
    fences = thresholds(stash(sketches(with_counts(docs, ["lang", "source"])), "sketch"))
    return judge(with_counts(whole, ["_all", "lang", "source"]), fences).where("kept").select("_all.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_WORD = r"[^\x20\x09-\x0D]+"
_VALUES = " UNION ALL ".join(f"SELECT doc_key, lang, source, base_failed, '{f}' AS feature, {scale} * {numerator} // greatest({denominator}, 1) AS v FROM base" for f, (numerator, scale, denominator, *_) in FEATURES.items())


def _fence_sql() -> str:
    out = []
    for name, (_, _, _, two_sided, (low, high), tolerance) in FEATURES.items():
        width = f"greatest({FENCE[low]} * (q{high} - q{low}), {tolerance})"
        out.append(f"(feature = '{name}' AND (v > q{high} + {width}{f' OR v < q{low} - {width}' if two_sided else ''}))")
    return " OR ".join(out)


def _level_sql(name: str, keys: str) -> str:
    by = f"{keys}, " if keys else ""
    return f"""{name}_h AS (SELECT {by}feature, bucket, count(*) AS n FROM bucketed WHERE NOT base_failed GROUP BY {by}feature, bucket),
{name}_c AS (SELECT *, sum(n) OVER (PARTITION BY {by}feature) AS total, sum(n) OVER (PARTITION BY {by}feature ORDER BY bucket) AS upto FROM {name}_h),
{name}_q AS (SELECT {by}feature, total, {", ".join(f"min(bucket) FILTER (WHERE 100 * upto >= {p} * total) AS q{p}" for p in QUANTILES)} FROM {name}_c GROUP BY {by}feature, total)"""


def verdict_sql(documents: str = "documents") -> str:
    """DuckDB SQL: CTEs that end in ``judged``, a row for each row of the documents relation."""
    return rf"""numbered AS (SELECT row_number() OVER () AS doc_key, * FROM {documents}),
texts AS (SELECT doc_key, doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM numbered),
wins AS (SELECT doc_key, i, words[i:i+2] AS w FROM (SELECT doc_key, words, unnest(range(1, len(words) - 1)) AS i FROM texts)),
often AS (SELECT doc_key, w FROM wins GROUP BY doc_key, w HAVING count(*) > 1),
covered AS (SELECT DISTINCT doc_key, i + k AS p FROM wins JOIN often USING (doc_key, w), (VALUES (0), (1), (2)) AS t(k)),
reps AS (SELECT doc_key, count(*) AS n FROM covered GROUP BY doc_key),
counted AS (SELECT t.doc_key, doc_id, lang, source, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
  len(regexp_extract_all(text, '[A-Z\x{{C0}}-\x{{D6}}\x{{D8}}-\x{{DE}}]'))::BIGINT AS n_upper, len(lines)::BIGINT AS n_lines FROM texts t LEFT JOIN reps r ON t.doc_key = r.doc_key),
base AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM counted),
vals AS ({_VALUES}),
bucketed AS (SELECT *, (v >> greatest(0, length(bin(v)) - 7)::BIGINT) << greatest(0, length(bin(v)) - 7)::BIGINT AS bucket FROM vals),
{_level_sql("own", "lang, source")}, {_level_sql("lng", "lang")}, {_level_sql("whole", "")},
fenced AS (SELECT b.doc_key, b.feature, b.v, {", ".join(f"CASE WHEN o.total >= {MIN_GROUP} THEN o.q{p} WHEN l.total >= {MIN_GROUP} THEN l.q{p} ELSE a.q{p} END AS q{p}" for p in QUANTILES)} FROM vals b
  JOIN own_q o ON b.lang IS NOT DISTINCT FROM o.lang AND b.source IS NOT DISTINCT FROM o.source AND b.feature = o.feature
  JOIN lng_q l ON b.lang IS NOT DISTINCT FROM l.lang AND b.feature = l.feature JOIN whole_q a ON b.feature = a.feature),
odd AS (SELECT DISTINCT doc_key FROM fenced WHERE {_fence_sql()}),
judged AS (SELECT b.*, NOT base_failed AND o.doc_key IS NULL AS kept FROM base b LEFT JOIN odd o ON b.doc_key = o.doc_key)"""


SQL = f"WITH {verdict_sql()} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged"
