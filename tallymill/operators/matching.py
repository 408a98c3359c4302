"""Matching of texts against rules by their scores, without forming pairs that can't reach the least score.

Two texts with a ratio of t percent or more, of lengths that add up to s, have a common subsequence of L >= t s / 200 characters. Every
character outside it breaks at most one of the L + 1 pairs of neighbours, ends counted, that the subsequence keeps: so they share at least
3 L - s + 1 pairs of neighbouring characters (L characters, where the least score is too low for that bound). Neighbours in a text whose
tokens are parted by single spaces are the same in whatever order the tokens stand, so the bound holds for every score here that compares
whole texts. Texts that share so many of their grams share one among the rarest few of each (prefix filtering): these few are joined on.

A token set score is also high where the tokens of one side nearly all stand in the other, however much else that has: then they share one
of the rarest tokens of that side. Both joins lose no pair; scores are computed for what is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tallymill.functions import ratios
from tallymill.operators.ranking import first_per_key, top_per_key

#: The least score by default, and that of a rule which may be boosted.
LEAST, LEAST_BOOSTED = 75.0, 80.0
#: Rules of a text that boosts choose from, and the boosts: of the industry, the context and the sheet. Fixed values.
CHOICE, BOOSTS = 10, (10, 10, 5)
#: Above this score two thirds of the characters are common, and pairs of neighbours are looked at instead of single characters.
PAIRS_FROM = 70.0
#: A gram that more texts have among their rarest is dealt over several tasks.
HOT = 2000

_SCORES = {"token_sort": ratios.token_sort_ratio, "token_set": ratios.token_set_ratio, "sequence": ratios.sequence_ratio}
_EPS = 1e-6


def grams(text: str, width: int) -> list[str]:
    """The characters of a text, or its pairs of neighbours with a space at both ends, each with the number of its occurrence; an empty text has one of its own."""
    whole = text if width == 1 else f" {text} "
    seen: dict[str, int] = {}
    out = []
    for gram in (whole[i : i + width] for i in range(max(1, len(whole) - width + 1))):
        seen[gram] = seen.get(gram, 0) + 1
        out.append(f"{gram}\x00{seen[gram]}")
    return out


def _signed(texts: DataFrame, name: str, kind: str, width: int) -> DataFrame:
    """(block, name, size, grams, tokens) of different texts: their tokens, the grams and the length of the text that these make (by token set of each token once; by sequence the text as it stands)."""
    rows = texts.select("block", name).where(F.col(name).isNotNull()).distinct()
    schema = StructType([*rows.schema, StructField("size", IntegerType()), StructField("grams", ArrayType(StringType())), StructField("tokens", ArrayType(StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [t.split() for t in batch.column(1).to_pylist()]
            once = [list(dict.fromkeys(t)) for t in tokens]
            joined = batch.column(1).to_pylist() if kind == "sequence" else [" ".join(t) for t in (tokens if kind == "token_sort" else once)]
            columns = [pa.array(map(len, joined), pa.int32()), *(pa.array(c, pa.list_(pa.string())) for c in ([grams(t, width) for t in joined], once))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], schema.names)

    return rows.mapInArrow(run, schema)


def _in_order(left: DataFrame, right: DataFrame, names: tuple[str, str], items: str) -> tuple[DataFrame, DataFrame]:
    """(block, name, size, items) of both sides, with the items in one order, the rarest of both first."""
    exploded = [side.select("block", n, "size", F.explode(items).alias("item")) for side, n in zip((left, right), names, strict=True)]
    counts = exploded[0].select("item").unionByName(exploded[1].select("item")).groupBy("item").agg(F.count("*").alias("n"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("n", "item"))), lambda s: s["item"]).alias(items)
    out = [rows.join(counts, "item").groupBy("block", n, "size").agg(in_order) for rows, n in zip(exploded, names, strict=True)]
    return out[0], out[1]


def _meet(left: DataFrame, right: DataFrame) -> DataFrame:
    """left and right joined on (block, item). The rows of an item that many on the left have are dealt over several tasks, each of which gets the item's rows of the right."""
    hot = left.groupBy("block", "item").agg(F.ceil(F.count("*") / HOT).cast("int").alias("parts")).where("parts > 1")
    part = F.pmod(F.xxhash64("text"), F.col("parts")).cast("int")
    dealt = left.join(hot, ["block", "item"], "left").withColumn("part", F.coalesce(part, F.lit(0))).drop("parts")
    copied = right.join(hot, ["block", "item"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return dealt.join(copied, ["block", "item", "part"])


def _pairs_by_grams(texts: DataFrame, rules: DataFrame, least: float, width: int) -> DataFrame:
    """(block, text, rule) of the pairs that share as many grams as a ratio of least needs; each pair once."""
    steep, flat = (3 * least / 200 - 1, 1.0) if width == 2 else (least / 200, 0.0)
    needed = lambda total: F.ceil(steep * total + flat - _EPS)
    # a partner is at least this share as long
    share = least / (200 - least)
    prefix = lambda side, name: side.select("block", name, F.col("size").alias(f"{name}_size"), F.col("grams").alias(f"{name}_grams"), F.explode(F.slice("grams", F.lit(1), F.greatest(F.size("grams") - F.greatest(needed(F.col("size") * (1 + share)), F.lit(1)) + 1, F.lit(0)).cast("int"))).alias("item"))
    left, right = _in_order(texts, rules, ("text", "rule"), "grams")
    met = _meet(prefix(left, "text"), prefix(right, "rule"))
    total, both = F.col("text_size") + F.col("rule_size"), F.array_intersect("text_grams", "rule_grams")
    fits = 200 * F.least("text_size", "rule_size") >= least * total - _EPS
    # of the grams that a pair shares the first one counts
    return met.where(fits).withColumn("both", both).where((F.element_at("both", 1) == F.col("item")) & (F.size("both") >= needed(total))).select("block", "text", "rule")


def _pairs_by_tokens(one: DataFrame, other: DataFrame, least: float, names: tuple[str, str]) -> DataFrame:
    """(block, text, rule) of the pairs in which the tokens that both have are so much of the first side that these alone reach least."""
    weight = lambda tokens: F.aggregate(tokens, F.lit(0), lambda t, w: t + F.char_length(w) + 1)
    left, right = _in_order(one, other, names, "tokens")
    share = least / (200 - least)
    # the rarest tokens without which the others are too few
    first = F.filter("tokens", lambda t, i: weight(F.slice("tokens", i + 1, F.size("tokens"))) >= share * F.col("size") + 1 - _EPS)
    left = left.select("block", F.col(names[0]).alias("text"), "size", F.col("tokens").alias("own"), F.explode(first).alias("item"))
    right = right.select("block", F.col(names[1]).alias("rule"), F.col("tokens").alias("others"), F.explode("tokens").alias("item"))
    met = _meet(left, right).withColumn("both", F.array_intersect("own", "others"))
    enough = weight(F.col("both")) >= share * F.col("size") + 1 - _EPS
    found = met.where((F.element_at("both", 1) == F.col("item")) & enough).select("block", "text", "rule")
    return found if names[0] == "text" else found.select("block", F.col("rule").alias("text"), F.col("text").alias("rule"))


def scored_pairs(texts: DataFrame, rules: DataFrame, kind: str, least: float) -> DataFrame:
    """(block, text, rule, score): all pairs of different texts and rules (block, text) and (block, rule) of one block that score least or more, a number above 0.

    kind: token_sort, token_set, or sequence, whose matching blocks are a common subsequence too. Null texts have no pairs; equal texts are a pair; a text without tokens is like another one by token
    sort, and like none by token set.
    """
    width = 2 if least > PAIRS_FROM else 1
    left, right = _signed(texts, "text", kind, width), _signed(rules, "rule", kind, width)
    pairs = _pairs_by_grams(left, right, least, width)
    if kind == "token_set":
        pairs = pairs.unionByName(_pairs_by_tokens(left, right, least, ("text", "rule"))).unionByName(_pairs_by_tokens(right, left, least, ("rule", "text"))).distinct()
    return pairs.withColumn("score", _SCORES[kind](F.col("text"), F.col("rule"))).where(F.col("score") >= least)


def _scored(texts: DataFrame, rules: DataFrame, kind: str, least: float) -> DataFrame:
    """(text, score, rule and the columns of rules): rules that a text matches."""
    one = lambda rows, name: rows.select(F.lit(0).alias("block"), name)
    return scored_pairs(one(texts, "text"), one(rules, "rule"), kind, least).drop("block").join(rules, "rule")


def top_rules(texts: DataFrame, rules: DataFrame, kind: str = "token_sort", k: int = 5, least: float = LEAST) -> DataFrame:
    """(text_id, rank, rule_id, score): up to k rules (rule_id, rule) of each text (text_id, text), best first, the smaller rule_id first among equals."""
    best = top_per_key(_scored(texts, rules.select("rule_id", "rule"), kind, least), ["text"], k, F.desc("score"), "rule_id")
    return texts.select("text_id", "text").join(best, "text").select("text_id", "rank", "rule_id", "score")


def best_rule(texts: DataFrame, rules: DataFrame, kind: str = "token_set", least: float = LEAST, where: Column | None = None) -> DataFrame:
    """(text_id, rule_id, score): the best of the rules for which ``where`` (over the columns of both sides) holds, equal texts among them; the smaller rule_id among equals."""
    met = texts.join(_scored(texts, rules, kind, least), "text")
    return first_per_key(met if where is None else met.where(where), ["text_id"], F.desc("score"), "rule_id").select("text_id", "rule_id", "score")


def boosted_rule(texts: DataFrame, rules: DataFrame, least: float = LEAST_BOOSTED) -> DataFrame:
    """(text_id, rule_id, score): the rule of each text that suits its industry and context best.

    texts: (text_id, text, industry, context); rules: (rule_id, rule, rule_industry, rule_context, sheet), null where a rule is for all. Looked at
    are the rules with the text itself or, if there are none, its CHOICE best by token sort of least or more. Of these, rules of another
    industry or of another context, where the text's is known, are passed over; the others' scores rise by BOOSTS for each of industry,
    context and sheet that agree, beyond 100 too. If all are passed over, the best score counts as it is. Among equals the better score,
    then the smaller rule_id.
    """
    each = texts.select("text").distinct()
    exact = each.join(rules, F.col("text") == F.col("rule")).withColumn("score", F.lit(100.0))
    rest = each.join(rules.select(F.col("rule").alias("text")), "text", "left_anti")
    near = top_per_key(_scored(rest, rules, "token_sort", least), ["text"], CHOICE, F.desc("score"), "rule_id").drop("rank")
    met = texts.join(exact.unionByName(near), "text")
    known = F.coalesce("context", F.lit("unknown"))
    own_industry, own_context = F.col("rule_industry") == F.col("industry"), F.col("rule_context") == known
    suits = (F.col("rule_industry").isNull() | F.coalesce(own_industry, F.lit(False))) & (F.col("rule_context").isNull() | own_context | (known == "unknown"))
    sheet = F.lower("sheet")
    own_sheet = (sheet.contains("balance") & (known == "bs")) | (sheet.contains("profit") & (known == "pl"))
    rise = [F.when(F.coalesce(agrees, F.lit(False)), by).otherwise(0) for agrees, by in zip((own_industry, own_context, own_sheet), BOOSTS, strict=True)]
    ranked = met.withColumn("suits", suits).withColumn("value", F.when(suits, F.col("score") + rise[0] + rise[1] + rise[2]).otherwise(F.col("score")))
    return first_per_key(ranked, ["text_id"], F.desc("suits"), F.desc("value"), F.desc("score"), "rule_id").select("text_id", "rule_id", F.col("value").alias("score"))


def like_pairs(rows: DataFrame, kind: str = "token_sort", least: float = 90.0) -> DataFrame:
    """(left_id, right_id, score): pairs of different rows (id, text, block, label) of one block with different labels and like texts."""
    sides = [rows.select("block", F.col("text").alias(n)) for n in ("text", "rule")]
    left = rows.select(F.col("id").alias("left_id"), "block", "text", F.col("label").alias("l1"))
    right = rows.select(F.col("id").alias("right_id"), "block", F.col("text").alias("rule"), F.col("label").alias("l2"))
    pairs = scored_pairs(*sides, kind, least).join(left, ["block", "text"]).join(right, ["block", "rule"])
    return pairs.where((F.col("left_id") < F.col("right_id")) & (F.col("l1") != F.col("l2"))).select("left_id", "right_id", "score")
