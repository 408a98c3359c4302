"""Comparison of two versions of a table of line items, and the near-duplicates within one.

Both are greedy by definition: what a line is paired with depends on the lines before it. Candidate pairs come from joins that lose none, and
the greedy choice among them is made for all groups at once in rounds over tables, so no task holds a client or a document.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallymill.functions import amounts as A, ratios, text as T
from tallymill.operators import assignment, matching
from tallymill.operators.ranking import dealt, running
from tallymill.sources.files import stored

#: Least scores of a changed label, and of one that keeps its class; of a changed label in the older comparison; of a near-duplicate.
LEAST, SURE, LEGACY_LEAST, SAME = 75.0, 90.0, 85.0, 85.0
#: Fixed value: how far amounts of near-duplicates may be apart, as a share of the larger.
CLOSE = 0.001
#: Fixed value: a sheet with more lines is a ledger of single bookings, not part of a statement, and is left out as a whole.
LEDGER_LINES = 300
#: A group of no more lines is gone through line by line in one task; larger ones take rounds over tables. The pairs are the same.
SMALL = 1000
_SCORES = {"token_set": ratios.token_set, "token_sort": ratios.token_sort}
#: Amounts are cut into bands that are a little wider than CLOSE, so close ones lie in the same or neighbouring bands.
BAND = math.log1p(1.1 * CLOSE)


def _placed(rows: DataFrame, keys: list[str], *more: str) -> DataFrame:
    """rows with ``o``, which orders the lines of a group; lines that agree in all of it are numbered."""
    number = F.row_number().over(Window.partitionBy(*keys, "ord", "id").orderBy(*more))
    return rows.withColumn("_n", number).withColumn("o", F.struct("ord", "id", F.col("_n").alias("n"))).drop("_n")


def _by_size(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The rows, stored, of groups of up to SMALL lines and of all others, lines without a group among them; None if there are no others."""
    rows = stored(rows, "lines")
    large = stored(rows.groupBy(F.col("group").alias("_g")).agg(F.count("*").alias("_n")).where((F.col("_n") > SMALL) | F.col("_g").isNull()).select("_g"), "large")
    if large.isEmpty():
        return rows, None
    of = F.col("group").eqNullSafe(F.col("_g"))
    return rows.join(large, of, "left_anti"), rows.join(large, of, "left_semi")


def _pairs(rows: DataFrame, kind: str, least: float, exact: bool) -> DataFrame:
    """(group, old, new, score, exact): the pairs of each group of rows (group, side, key, ord, line), and its lines without one; line is a struct with id and amount, others may follow. Lines without a group are paired with none, but for those that are exact."""
    small, large = _by_size(rows)
    some = assignment.in_small_groups(small, ["ord", "line.id", "key", "line.amount"], _SCORES[kind], least, exact)
    if large is None:
        return some
    if not exact:
        return some.unionByName(_pairs_in_rounds(large, kind, least))
    of_key = Window.partitionBy("group", "key")
    last = F.row_number().over(Window.partitionBy("group", "key", "side").orderBy(F.desc("ord"), F.desc("line.id"))) == 1
    large = stored(large.withColumn("exact", last & F.col("key").isNotNull() & (F.min("side").over(of_key) != F.max("side").over(of_key))), "lines")
    one = lambda side: F.max(F.when(F.col("side") == side, F.col("line"))).alias(side)
    pairs = large.where("exact").groupBy("group", "key").agg(one("old"), one("new")).select("group", "old", "new", F.lit(100.0).alias("score"), F.lit(True).alias("exact"))
    return some.unionByName(pairs).unionByName(_pairs_in_rounds(large.where("not exact").drop("exact").withColumn("key", F.coalesce("key", F.lit(""))), kind, least))


def _pairs_in_rounds(rows: DataFrame, kind: str, least: float) -> DataFrame:
    """_pairs, however many lines a group has: candidates by a join, assigned in rounds over tables."""
    rows = rows.withColumn("id", F.col("line.id")).withColumn("amount", F.col("line.amount"))
    rows = stored(_placed(rows, ["group", "side"], "key", "amount").drop("id", "amount"), "lines")
    old, new = (rows.where(F.col("side") == s).select("group", F.col("key").alias("text"), "o", "line") for s in ("old", "new"))
    scores = matching.scored_pairs(old.select(F.col("group").alias("block"), "text"), new.select(F.col("group").alias("block"), F.col("text").alias("rule")), kind, least)
    scores = scores.select(F.col("block").alias("group"), "text", F.col("rule").alias("other"), "score")
    found = assignment.in_turn(old.select("group", "text", "o"), new.select("group", "text", F.col("o").alias("n")), scores)
    right = new.select("group", F.col("o").alias("n"), F.col("line").alias("new"))
    lefts = old.select("group", "o", F.col("line").alias("old")).join(found, ["group", "o"], "left").join(right, ["group", "n"], "left")
    lefts = lefts.select("group", "old", "new", F.coalesce("score", F.lit(0.0)).alias("score"), F.lit(False).alias("exact"))
    come = right.join(found, ["group", "n"], "left_anti")
    return lefts.unionByName(come.select("group", F.lit(None).cast(old.schema["line"].dataType).alias("old"), "new", F.lit(0.0).alias("score"), F.lit(False).alias("exact")))


def _paired(rows: DataFrame, kind: str, least: float) -> DataFrame:
    """(group, old_id, new_id, score, old_amount, new_amount): the pairs of each group of rows (group, side, id, key, ord, amount), and its lines without one. Lines without a group are paired with none."""
    found = _pairs(rows.select("group", "side", "key", "ord", F.struct("id", "amount").alias("line")), kind, least, False)
    return found.select("group", F.col("old.id").alias("old_id"), F.col("new.id").alias("new_id"), "score", F.col("old.amount").alias("old_amount"), F.col("new.amount").alias("new_amount"))


def _both(old: DataFrame, new: DataFrame, key: Column, *more: str) -> DataFrame:
    side = lambda rows, name: rows.select("group", F.lit(name).alias("side"), key.alias("key"), "ord", F.struct("id", "amount", *more).alias("line"))
    return side(old, "old").unionByName(side(new, "new"))


def _changes(old: DataFrame, new: DataFrame, *more: str) -> DataFrame:
    """(group, old, new, category, score, reclassify) of two versions; old and new are structs of id, amount and more."""
    found = _pairs(_both(old, new, T.diff_key(F.col("source_text")), *more), "token_set", LEAST, True)
    same = A.equal_within(F.col("old.amount"), F.col("new.amount"))
    category = F.when(F.col("exact"), F.when(same, "unchanged").otherwise("amount_changed"))
    category = F.coalesce(category, F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("desc_changed"))
    out = found.select("group", "old", "new", category.alias("category"), "score")
    reclassify = (F.col("category") == "added") | ((F.col("category") == "desc_changed") & (F.col("score") < SURE))
    return out.withColumn("reclassify", reclassify)


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(group, old_id, new_id, category, score, reclassify) of two versions (group, id, source_text, amount, ord).

    Lines with the same key are unchanged or amount_changed; of several, the last of each version is matched and the earlier ones go on.
    Lines left are paired by token-set score as desc_changed; the rest is removed or added.
    """
    return _changes(old, new).select("group", F.col("old.id").alias("old_id"), F.col("new.id").alias("new_id"), "category", "score", "reclassify")


def legacy_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(group, old_id, new_id, category): changed where a pair's amounts differ, added, removed. Labels are compared as they stand."""
    left = _pairs(_both(old, new, F.coalesce("source_text", F.lit(""))), "token_sort", LEGACY_LEAST, False)
    changed = F.when(~A.equal_within(F.col("old.amount"), F.col("new.amount")), "changed")
    category = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise(changed)
    return left.select("group", F.col("old.id").alias("old_id"), F.col("new.id").alias("new_id"), category.alias("category")).where("category is not null")


def applied(old: DataFrame, new: DataFrame) -> DataFrame:
    """What apply_diff gives for the diff of two versions; each change has its lines with it, so none is looked up again."""
    after = _changes(old, new, "source_text").where("category <> 'removed'")
    text = F.when(F.col("category").isin("desc_changed", "added"), F.col("new.source_text")).otherwise(F.col("old.source_text"))
    amount = F.when(F.col("category") == "unchanged", F.col("old.amount")).otherwise(F.col("new.amount"))
    return after.select("group", F.coalesce("old.id", "new.id").alias("id"), text.alias("source_text"), amount.alias("amount"), F.col("reclassify").alias("flagged"), (F.col("category") == "unchanged").alias("verified"))


def apply_diff(old: DataFrame, new: DataFrame, changes: DataFrame) -> DataFrame:
    """(group, id, source_text, amount, flagged, verified): the old version with the changes taken over, and added lines after it."""
    after = changes.where("category <> 'removed'").join(new.select("group", F.col("id").alias("new_id"), F.col("source_text").alias("new_text"), F.col("amount").alias("new_amount")), ["group", "new_id"], "left")
    rows = after.join(old.select("group", F.col("id").alias("old_id"), "source_text", "amount"), ["group", "old_id"], "left")
    text = F.when(F.col("category").isin("desc_changed", "added"), F.col("new_text")).otherwise(F.col("source_text"))
    amount = F.when(F.col("category") == "unchanged", F.col("amount")).otherwise(F.col("new_amount"))
    return rows.select("group", F.coalesce("old_id", "new_id").alias("id"), text.alias("source_text"), amount.alias("amount"), F.col("reclassify").alias("flagged"), (F.col("category") == "unchanged").alias("verified"))


def _alike(first: DataFrame) -> DataFrame:
    """(early, late) of different lines (document_id, key, amount, o) of a document with like texts and close amounts, early before late."""
    sign, band = F.signum("amount").cast("int"), F.floor(F.least(F.log(F.abs("amount")), F.lit(1e6)) / BAND)
    banded = first.withColumn("sign", sign).withColumn("band", F.when(F.col("amount") == 0, F.lit(0)).otherwise(band))
    block = lambda b: F.struct("document_id", "sign", b.alias("band"))
    near = F.when(F.col("amount") == 0, F.array(F.col("band"))).otherwise(F.array(*[F.col("band") + i for i in (-1, 0, 1)]))
    late = banded.withColumn("b", F.explode(near)).select(block(F.col("b")).alias("block"), F.col("key").alias("text"), F.col("o").alias("late"), F.col("amount").alias("x"))
    early = banded.select(block(F.col("band")).alias("block"), F.col("key").alias("rule"), F.col("o").alias("early"), F.col("amount").alias("y"))
    pairs = matching.scored_pairs(late.select("block", "text"), early.select("block", "rule"), "sequence", SAME).select("block", "text", "rule")
    met = pairs.join(late, ["block", "text"]).join(early, ["block", "rule"])
    close = F.abs(F.col("x") - F.col("y")) <= CLOSE * F.greatest(F.abs("x"), F.abs("y"))
    node = lambda o: F.struct(F.col("block.document_id").alias("document_id"), F.col(o).alias("o")).alias(o)
    return met.where((F.col("early") < F.col("late")) & close).select(node("early"), node("late"))


def collapse_near_duplicates(items: DataFrame) -> DataFrame:
    """(document_id, id, place, n): the lines of a document (document_id, id, source_text, amount, sheet, ord) that stay.

    A line joins the first group whose first line has a like text and amount; of a group the line of the best sheet stays, the first
    among equals, in the order of groups. A line without a text or an amount, or with one that is no number, is a group of its own.
    """
    small, large = _by_size(_keyed(items, F.col("id")))
    of_small = assignment.heads_in_small_groups(small.withColumn("text", F.col("key")), ["ord", "id", "key", "amount", "priority"], _near)
    kept = of_small.select(F.col("group").alias("document_id"), "id", "place", "n")
    return kept if large is None else kept.unionByName(_collapse_in_rounds(large.withColumnRenamed("group", "document_id")))


def collapse_small_documents(items: DataFrame, *more: str) -> DataFrame:
    """collapse_near_duplicates, with the columns more of the lines that stay, for documents of few lines, whose ord has no ties. items come out of a window by document, so nothing is shuffled or stored."""
    rows = _keyed(items, F.struct("id", *more)).withColumn("text", F.col("key"))
    kept = assignment.heads_in_small_groups(rows, ["ord"], _near, together=True)
    return kept.select(F.col("group").alias("document_id"), "id.id", "place", "n", *[f"id.{c}" for c in more])


def _keyed(items: DataFrame, line: Column) -> DataFrame:
    """(group, ord, id, key, amount, priority) of items, where line stands for the id."""
    amount = F.nanvl(F.col("amount").cast("double"), F.lit(None).cast("double"))
    return items.select(F.col("document_id").alias("group"), "ord", line.alias("id"), F.lower("source_text").alias("key"), amount.alias("amount"), T.sheet_priority(F.col("sheet")).alias("priority"))


def _near(one: tuple[str, float], other: tuple[str, float]) -> bool:
    """Whether a line (text, amount) is like an earlier one."""
    (a, x), (b, y) = one, other
    return (a == b and x == y) or (abs(x - y) < math.inf and abs(x - y) <= CLOSE * max(abs(x), abs(y)) and (a == b or ratios.sequence(a, b) >= SAME))


def _collapse_in_rounds(rows: DataFrame) -> DataFrame:
    """collapse_near_duplicates of (document_id, ord, id, key, amount, priority), however many lines a document has."""
    rows = stored(_placed(rows, ["document_id"], "key", "amount", "priority"), "lines")
    some = (F.col("key") != "") & F.col("amount").isNotNull()
    # equal lines have the same groups to join, so the first of them stands for all
    first = stored(rows.where(some).groupBy("document_id", "key", "amount").agg(F.min("o").alias("o")), "firsts")
    belongs = assignment.first_independent(_alike(first)).select(F.col("node.document_id").alias("document_id"), F.col("node.o").alias("o"), F.col("head.o").alias("head"))
    heads = first.join(belongs, (first["document_id"].eqNullSafe(belongs["document_id"])) & (first["o"] == belongs["o"]), "left").select(first["document_id"].alias("_d"), F.col("key").alias("_k"), F.col("amount").alias("_a"), F.coalesce("head", first["o"]).alias("head"))
    of_line = rows.join(heads, F.col("document_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k")) & (F.col("amount") == F.col("_a")), "left")
    groups = of_line.withColumn("head", F.coalesce("head", "o")).groupBy("document_id", "head").agg(F.count("*").alias("n"), F.min(F.struct((-F.col("priority")).alias("p"), "o")).alias("best"))
    counted = running(dealt(groups, "document_id", ["head"], "groups"), "document_id", ["head"], place=F.lit(1))
    return counted.select("document_id", F.col("best.o.id").alias("id"), (F.col("place") - 1).alias("place"), "n")
