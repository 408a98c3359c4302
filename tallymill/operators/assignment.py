"""Greedy assignment in order, for all lines at once: each line of the old version, the earliest first, takes the best line of the new one that is left.

That is what deferred acceptance gives when every new line prefers the earliest old one: old lines ask for the best new line that has not
been asked for by an earlier line, a new line keeps the earliest line that ever asked, and who is displaced asks on. Nobody waits for the
lines before, so rounds are few and tables are dealt over tasks; no task holds a group.

Old lines with the same text want the same new lines in the same order. They ask together, the first of them for the best, the second for
the next and so on, as far as all of these would prefer each of them to the line that they keep: a line's place in the queue is then sure.
Many equal lines are thus one round's work.

Groups of few lines need no rounds: after one shuffle by group a task goes through them one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from tallymill.sources.files import drop, stored


#: Pairs of texts whose score a task remembers.
REMEMBERED = 500_000


def in_small_groups(rows: DataFrame, order: list[str], score: Callable[[str, str], float], least: float, exact: bool) -> DataFrame:
    """(group, old, new, score, exact): who gets whom in groups of few lines, and with a score of 0 who gets nobody.

    rows: (group, side, key, line) and the columns of order, which orders the lines of a group and side; line is what the result gives of a line.
    exact: of each key that both sides have, the last lines get each other before all others. No more than one group and a batch of rows are at hand at once.
    """
    line = rows.schema["line"].dataType
    schema = StructType([StructField("group", rows.schema["group"].dataType), StructField("old", line), StructField("new", line), StructField("score", DoubleType()), StructField("exact", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, str], float] = {}

        def scored(a: str, b: str) -> float:
            if (a, b) not in known:
                if len(known) >= REMEMBERED:
                    known.clear()
                known[a, b] = score(a, b)
            return known[a, b]

        def pair(old: list[int], new: list[int], keys: list[str | None]) -> Iterator[tuple[int | None, int | None, float, bool]]:
            if exact:
                last_old, last_new = ({keys[i]: i for i in side if keys[i] is not None} for side in (old, new))
                both = [(i, last_new[k]) for k, i in last_old.items() if k in last_new]
                yield from ((i, j, 100.0, True) for i, j in both)
                used = {i for two in both for i in two}
                old, new = ([i for i in side if i not in used] for side in (old, new))
            queues: dict[str, list[int]] = {}
            for j in reversed(new):
                queues.setdefault(keys[j] or "", []).append(j)
            for i in old:
                best, text = (-least, len(keys)), keys[i] or ""
                for other, queue in queues.items():
                    asked = (-scored(text, other), queue[-1])
                    if asked < best:
                        best = asked
                if best[1] == len(keys):
                    yield i, None, 0.0, False
                else:
                    queue = queues[keys[best[1]] or ""]
                    yield i, queue.pop(), -best[0], False
                    if not queue:
                        del queues[keys[best[1]] or ""]
            yield from ((None, j, 0.0, False) for queue in queues.values() for j in queue)

        rest: list[pa.RecordBatch] = []
        for batch in chain(batches, [None]):
            rest += [] if batch is None or not batch.num_rows else [batch]
            if not rest:
                continue
            rows_ = pa.Table.from_batches(rest).combine_chunks()
            groups, olds, keys = (rows_.column(c).to_pylist() for c in ("group", "is_old", "key"))
            starts = [0, *(i for i in range(1, len(groups)) if groups[i] != groups[i - 1]), len(groups)]
            if batch is not None:
                starts.pop()  # the last group may go on in the next batch
            found = []
            for a, b in zip(starts, starts[1:], strict=False):
                found += pair([i for i in range(a, b) if olds[i]], [i for i in range(a, b) if not olds[i]], keys)
            rest = rows_.slice(starts[-1]).to_batches()
            if found:
                old, new, scores, exacts = zip(*found, strict=True)
                first = pa.array([j if i is None else i for i, j in zip(old, new, strict=True)], pa.int64())
                lines = rows_.column("line").combine_chunks()
                lines = lines.chunk(0) if isinstance(lines, pa.ChunkedArray) else lines
                group = rows_.column("group").take(first).combine_chunks()
                group = group.chunk(0) if isinstance(group, pa.ChunkedArray) else group
                yield pa.RecordBatch.from_arrays([group, *(lines.take(pa.array(x, pa.int64())) for x in (old, new)), pa.array(scores, pa.float64()), pa.array(exacts, pa.bool_())], schema.names)

    together = rows.withColumn("is_old", F.col("side") == "old").select("group", "is_old", "key", "line", *[F.col(c).alias(f"_by_{i}") for i, c in enumerate(order)])
    in_order = together.repartition("group").sortWithinPartitions("group", *[f"_by_{i}" for i in range(len(order))])
    return in_order.select("group", "is_old", "key", "line").mapInArrow(run, schema)


def heads_in_small_groups(rows: DataFrame, order: list[str], near: Callable[[tuple[str, float], tuple[str, float]], bool], together: bool = False) -> DataFrame:
    """(group, id, place, n) for each head of groups of few lines: going through the lines in order, each joins the first earlier head that is near, or else is a head. place numbers the heads of a group from 0, n counts the lines of each, and id is that of its first line of the highest priority.

    rows: (group, text, amount, id, priority) and the columns of order. Lines without a text or an amount are heads that none joins. No more than
    one group and a batch of rows are at hand at once. together: the rows come out of a window by group, so they need no shuffle.
    """
    fields = [StructField("group", rows.schema["group"].dataType), StructField("id", rows.schema["id"].dataType), StructField("place", LongType()), StructField("n", LongType())]
    schema = StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in chain(batches, [None]):
            rest += [] if batch is None or not batch.num_rows else [batch]
            if not rest:
                continue
            rows_ = pa.Table.from_batches(rest)
            groups, texts, amounts, priorities = (rows_.column(c).to_pylist() for c in ("group", "text", "amount", "priority"))
            starts = [0, *(i for i in range(1, len(groups)) if groups[i] != groups[i - 1]), len(groups)]
            if batch is not None:
                starts.pop()  # the last group may go on in the next batch
            best, place, n = [], [], []
            for a, b in zip(starts, starts[1:], strict=False):
                first, heads = len(best), []
                for i in range(a, b):
                    line = (texts[i], amounts[i]) if texts[i] and amounts[i] is not None else None
                    k = next((k for k, head in enumerate(heads) if line and head and near(line, head)), len(heads))
                    if k == len(heads):
                        heads.append(line)
                        best.append(i)
                        place.append(k)
                        n.append(1)
                    else:
                        n[first + k] += 1
                        if priorities[i] > priorities[best[first + k]]:
                            best[first + k] = i
            rest = rows_.slice(starts[-1]).to_batches()
            if best:
                kept = rows_.select(["group", "id"]).take(pa.array(best, pa.int64())).combine_chunks().to_batches()[0]
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(place, pa.int64()), pa.array(n, pa.int64())], schema.names)

    given = ["group", "text", "amount", "id", "priority"]
    keyed = rows.select(*given, *[F.col(c).alias(f"_by_{i}") for i, c in enumerate(order)])
    in_order = (keyed if together else keyed.repartition("group")).sortWithinPartitions("group", *[f"_by_{i}" for i in range(len(order))])
    return in_order.select(*given).mapInArrow(run, schema)


def in_turn(old: DataFrame, new: DataFrame, scores: DataFrame) -> DataFrame:
    """(group, o, n, score): who gets whom.

    old: (group, text, o), new: (group, text, n); o and n order the lines of a group, without ties. scores: (group, text, other, score) of the
    pairs of an old and a new text that may be assigned. The highest score is the best, of equal ones the earliest new line. Lines without
    a group or text get nobody.
    """
    wants = stored(scores.join(new.select("group", F.col("text").alias("other"), "n"), ["group", "other"]).select("group", "text", "n", "score"), "wants")
    old = stored(old.join(wants.select("group", "text").distinct(), ["group", "text"], "left_semi").select("group", "text", "o"), "old")
    held = None
    by_text = Window.partitionBy("group", "text")
    while True:
        free = old if held is None else old.join(held.select("group", "o"), ["group", "o"], "left_anti")
        first = free.groupBy("group", "text").agg(F.min("o").alias("first"), F.count("*").alias("free"))
        open_ = wants.join(first, ["group", "text"])
        if held is None:
            open_ = open_.withColumn("keeps", F.lit(None).cast(old.schema["o"].dataType))
        else:
            open_ = open_.join(held.select("group", "n", F.col("o").alias("keeps")), ["group", "n"], "left").where(F.col("keeps").isNull() | (F.col("keeps") > F.col("first")))
        ranked = open_.withColumn("place", F.row_number().over(by_text.orderBy(F.desc("score"), "n"))).where(F.col("place") <= F.col("free"))
        # null stands for a line that keeps nobody yet, which asks no one to wait
        ranked = ranked.withColumn("least", F.min("keeps").over(by_text.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)))
        asking = free.withColumn("place", F.row_number().over(by_text.orderBy("o")))
        asked = asking.join(ranked, ["group", "text", "place"]).where(F.col("least").isNull() | (F.col("least") > F.col("o"))).select("group", "n", "o", "score")
        asked = stored(asked, "asked")
        if asked.isEmpty():
            drop(old, wants)
            return asked if held is None else held
        both = asked if held is None else held.unionByName(asked)
        now = stored(both.groupBy("group", "n").agg(F.min(F.struct("o", "score")).alias("best")).select("group", "n", "best.o", "best.score"), "held")
        drop(asked, *([] if held is None else [held]))
        held = now


def first_independent(edges: DataFrame) -> DataFrame:
    """(node, head) of the nodes that are not heads, where heads are the first independent set: going through the nodes in order, a node without an edge to an earlier head is one. A node belongs to the first head that it has an edge to.

    edges: (early, late), early before late. A node that no earlier undecided node or head has an edge to is a head; nodes with an edge to a head are
    decided. All that are sure are decided in a round, so there are as many rounds as undecided nodes follow one another in a chain.
    """
    edges = stored(edges.distinct(), "edges")
    left, heads = edges, None
    while True:
        late = left.select(F.col("late").alias("node")).distinct()
        sure = left.select(F.col("early").alias("node")).distinct().join(late, "node", "left_anti")
        sure = stored(sure, "heads")
        if sure.isEmpty():
            drop(sure)
            break
        members = stored(left.join(sure.withColumnRenamed("node", "early"), "early", "left_semi").select(F.col("late").alias("node")).distinct(), "members")
        rest = left.join(members.withColumnRenamed("node", "late"), "late", "left_anti").join(members.withColumnRenamed("node", "early"), "early", "left_anti")
        # the end of an edge from a member alone is a head that no edge names any more
        lone = left.select(F.col("late").alias("node")).distinct().join(members, "node", "left_anti")
        rest = stored(rest.select("early", "late"), "edges")
        lone = stored(lone.join(rest.select(F.col("late").alias("node")).distinct(), "node", "left_anti").join(rest.select(F.col("early").alias("node")).distinct(), "node", "left_anti"), "heads")
        found = sure.unionByName(lone)
        heads = found if heads is None else heads.unionByName(found)
        drop(members, *([left] if left is not edges else []))
        left = rest
    if heads is None:
        return edges.select(F.col("late").alias("node"), F.col("early").alias("head")).limit(0)
    belongs = edges.join(heads.withColumnRenamed("node", "early"), "early", "left_semi").groupBy(F.col("late").alias("node")).agg(F.min("early").alias("head"))
    return belongs
