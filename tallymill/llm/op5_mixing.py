"""Mixing sources to target weights by Efraimidis-Spirakis sampling within each source.

A source whose target exceeds its size is first taken whole, as often as it fits; the rest of the target is filled in ascending order of
exponential keys -ln(u) / weight, where u comes from a hash of the row and the weight from the text's quality. The order is cut into
slices of the key's logarithm, in which no weight, however small, puts more than a fixed small share of its rows: sums by source and
slice say in which slice a budget ends, sums by its finer slices in which of these, and only that one's rows are ranked one by one. So no
task ever holds a source, however large it is: a coarse slice has at most 1 / 2,700 of its rows, a fine one 1 / 2,800,000.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tallymill.llm.common import n_words, stash, table

#: Weights of the sources in order, repeating; their share of all sizes in percent; a source's target is at most so many times its size.
WEIGHTS, PERCENT, MOST_TIMES = (3, 1, 2), 150, 2
#: Slices are 1 / 2 ** COARSE wide in the natural logarithm of the key, fine ones 1 / 2 ** FINE.
COARSE, FINE = 10, 20
SEED = "mix-1"
#: The driver holds a name and a size for each source. More sources than this are an error: weights by place are set by hand, for few.
MOST_SOURCES = 100_000
#: The end of a budget that is 0: before all slices.
NOWHERE = -(1 << 30)
#: The plan of up to so many sources, a row of a few numbers each, is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 50_000


def quality(text: Column) -> Column:
    """A weight above 0 and up to 1: texts with many signs per word weigh less; empty ones weigh 1."""
    signs = F.coalesce(F.regexp_count(text, F.lit(r"[#*$%&|<>!]")), F.lit(0))
    words = n_words(text)
    return (1 + words).cast("double") / (1 + words + 4 * signs)


def _keys(docs: DataFrame, seed: str = SEED) -> list[Column]:
    """row_key, size and part_key (the exponential key) of a row of docs. Equal rows share a row_key and thus a part_key."""
    text_key = F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary"))
    row_key = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(docs["doc_id"].cast("string"), F.lit("-")), text_key, F.coalesce(docs["source"], F.lit(""))).cast("binary"))
    u = (F.conv(F.substring(row_key, 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)
    return [row_key.alias("row_key"), n_words(docs["text"]).alias("size"), (-F.log(u) / quality(docs["text"])).alias("part_key")]


def _with_slices(rows: DataFrame) -> DataFrame:
    """Adds slice and fine, which grow with part_key; a fine slice lies in one slice."""
    fine = F.floor(F.log("part_key") * float(1 << FINE))
    return rows.withColumn("fine", fine).withColumn("slice", F.shiftright("fine", FINE - COARSE).cast("int"))


def sized(docs: DataFrame) -> DataFrame:
    """(row_key, doc_id, source, size, part_key, slice, fine): the narrow rows that all decisions are made on."""
    return _with_slices(docs.select(docs["doc_id"], docs["source"], *_keys(docs)))


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, most_times: int = MOST_TIMES) -> list[float]:
    """The target of each source, given in order with its size: shares by weight of the whole budget; what exceeds a source's limit goes to the others by weight, until none exceeds its own."""
    budget, shares = percent * sum(n for _, n in sizes) / 100, [weights[i % len(weights)] for i in range(len(sizes))]
    out, full = [0.0] * len(sizes), set()
    while True:
        left, open_ = budget - sum(out[i] for i in full), [i for i in range(len(sizes)) if i not in full]
        total = sum(shares[i] for i in open_)
        for i in open_:
            out[i] = left * shares[i] / total
        over = [i for i in open_ if out[i] > most_times * sizes[i][1]]
        if not over:
            return out
        for i in over:
            out[i] = float(most_times * sizes[i][1])
        full.update(over)
        if len(full) == len(sizes):
            return out


def plan(rows: DataFrame) -> DataFrame:
    """(source, source_size, target, epochs, budget): how often each source is taken whole, and how many words are left to be sampled from it.

    There is a row for each source, and the driver computes the targets from the sources' names and sizes alone; more than MOST_SOURCES
    sources are an error.
    """
    spark = rows.sparkSession
    sizes = [(r.source, r.n) for r in rows.groupBy("source").agg(F.sum("size").alias("n")).limit(MOST_SOURCES + 1).collect()]
    if len(sizes) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources to mix")
    sizes.sort(key=lambda s: (s[0] is None, s[0] or ""))
    out = []
    for (source, n), target in zip(sizes, targets(sizes), strict=True):
        epochs = math.floor(target / n) if n else 0
        out.append((source, n, target, epochs, target - epochs * n))
    return spark.createDataFrame(out, "source string, source_size long, target double, epochs int, budget double")


def _reached(sources: DataFrame, rows: DataFrame, by: str, start: Column) -> DataFrame:
    """sources with the slice (NOWHERE: none) in which each budget ends among rows, and the words before it, counted from start."""
    # the slices of a source are few, whatever its rows are
    running = Window.partitionBy("source").orderBy(by)
    slices = rows.groupBy("source", by).agg(F.sum("size").alias("n")).withColumn("upto", F.sum("n").over(running))
    same = F.col("s.source").eqNullSafe(F.col("p.source"))
    reached = (start + F.col("upto") >= F.col("budget")) & (start + F.col("upto") - F.col("n") < F.col("budget"))
    joined = sources.alias("p").join(slices.alias("s"), same & reached, "left")
    return joined.select("p.*", F.coalesce(by, F.lit(NOWHERE)).alias(f"end_{by}"), (start + F.coalesce(F.col("upto") - F.col("n"), F.lit(0))).alias("_before"))


def _ends(rows: DataFrame) -> DataFrame:
    """The plan with the slice and the fine slice in which each source's budget ends, and the words before the fine one."""
    coarse = stash(_reached(plan(rows), rows, "slice", F.lit(0)).withColumnRenamed("_before", "before"), "ends")
    inside = _planned(rows, coarse).where("slice = end_slice").select("source", "fine", "size")
    return _reached(coarse, inside, "fine", F.col("before")).drop("before").withColumnRenamed("_before", "before")


def _planned(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """Rows with their source's plan."""
    ends = F.broadcast(ends) if ends.count() <= BROADCAST_SOURCES else ends
    return rows.alias("r").join(ends.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source"))).select("r.*", *[f"p.{c}" for c in ends.columns if c != "source"])


def _drawn(end_rows: DataFrame) -> DataFrame:
    """Adds drawn to the rows of the fine slices in which budgets end: 1 if more than half of the row lies before its source's end."""
    in_order = Window.partitionBy("source").orderBy("part_key", "doc_id", "row_key").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("size").over(in_order), F.lit(0))
    return end_rows.withColumn("_start", start).withColumn("drawn", ((F.col("size") > 0) & (F.col("_start") + F.col("size") / 2 < F.col("budget"))).cast("int")).drop("_start")


def _drawn_before() -> Column:
    return ((F.col("size") > 0) & (F.col("fine") < F.col("end_fine"))).cast("int")


def mix(docs: DataFrame) -> DataFrame:
    """(row_key, doc_id, size, source_size, target, times, taken) for each row of docs.

    Of the sampled rows a source takes those, in key order, more than half of which lies before the end of its budget, so it ends within
    half a document of its target. Null sources are a source of their own, after the others; null texts have size 0 and are taken with
    whole epochs only; an empty table gives no rows. Rows that tie follow in the order of doc_id and row_key; equal rows may differ in
    ``times`` if a budget ends among them.
    """
    rows = stash(sized(docs), "sizes")
    each = _planned(rows, stash(_ends(rows), "ends"))
    at_end = F.col("fine") == F.col("end_fine")
    out = _drawn(each.where(at_end)).unionByName(each.where(~at_end).withColumn("drawn", _drawn_before()))
    out = out.withColumn("times", F.col("epochs") + F.col("drawn"))
    return out.select("row_key", "doc_id", "size", "source_size", "target", "times", (F.col("size") * F.col("times")).alias("taken"))


def repeat_rows(docs: DataFrame) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with the columns of docs.

    Texts stay where they are: a row's place follows from itself and its source's plan. Only rows of the fine slices in which budgets end are
    joined to what was drawn there; of equal rows as many are drawn as were drawn among the narrow ones.
    """
    rows = stash(sized(docs), "sizes")
    ends = stash(_ends(rows), "ends")
    at_end = F.col("fine") == F.col("end_fine")
    drawn = _drawn(_planned(rows, ends).where(at_end)).groupBy("row_key").agg(F.sum("drawn").alias("n_drawn"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_all"), docs["source"], *_keys(docs))
    whole = _planned(_with_slices(whole), ends)
    number = F.row_number().over(Window.partitionBy("row_key").orderBy("part_key"))
    few = whole.where(at_end).withColumn("_number", number).join(drawn, "row_key").withColumn("drawn", (F.col("_number") <= F.col("n_drawn")).cast("int"))
    many = whole.where(~at_end).withColumn("drawn", _drawn_before())
    taken = few.select("_all", "epochs", "drawn").unionByName(many.select("_all", "epochs", "drawn"))
    return taken.select("_all", F.explode(F.array_repeat(F.lit(1), F.col("epochs") + F.col("drawn")))).select("_all.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


_WORD = r"[^\x20\x09-\x0D]+"
#: The shares by closed form: with the sources in order of limit by weight, the first k are full and the others get the rest by weight.
SQL = rf"""WITH d AS (SELECT row_number() OVER () AS rk, doc_id, source, coalesce(text, '') AS text FROM documents),
s AS (SELECT rk, doc_id, source, len(regexp_extract_all(text, '{_WORD}'))::BIGINT AS size, len(regexp_extract_all(text, '[#*$%&|<>!]')) AS signs,
  md5(concat_ws('|', '{SEED}', coalesce(doc_id::VARCHAR, '-'), md5(text), coalesce(source, ''))) AS k FROM d),
e AS (SELECT *, -ln((('0x' || k[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE) / ((1 + size)::DOUBLE / (1 + size + 4 * signs)) AS key FROM s),
o AS (SELECT source, sum(size)::BIGINT AS n, (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1)::BIGINT AS i FROM e GROUP BY source),
w AS (SELECT *, [{", ".join(map(str, WEIGHTS))}][i % {len(WEIGHTS)} + 1] AS w, {MOST_TIMES} * n AS most FROM o),
r AS (SELECT *, row_number() OVER (ORDER BY most::DOUBLE / w, i) AS p, sum(most) OVER (ORDER BY most::DOUBLE / w, i) - most AS full_before, sum(w) OVER () - sum(w) OVER (ORDER BY most::DOUBLE / w, i) + w AS weight_left, {PERCENT} * sum(n) OVER () / 100.0::DOUBLE AS budget FROM w),
c AS (SELECT coalesce(min(p), (SELECT count(*) + 1 FROM r)) AS p FROM r WHERE (budget - full_before::DOUBLE) * w / weight_left <= most),
t AS (SELECT r.*, CASE WHEN r.p < c.p THEN most::DOUBLE ELSE (SELECT (budget - full_before::DOUBLE) FROM r x WHERE x.p = c.p) * w / (SELECT weight_left::DOUBLE FROM r x WHERE x.p = c.p) END AS target FROM r, c),
g AS (SELECT *, CASE WHEN n > 0 THEN floor(target / n) ELSE 0 END::BIGINT AS epochs FROM t),
q AS (SELECT e.*, g.n AS source_size, g.target, g.epochs, g.target - g.epochs * g.n AS budget, sum(size) OVER (PARTITION BY e.source ORDER BY key, doc_id, k, rk) - size AS before FROM e JOIN g ON e.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN size > 0 AND before + size / 2.0::DOUBLE < budget THEN 1 ELSE 0 END))::BIGINT AS taken FROM q"""
