"""Many patterns in one pass over texts: the first rule that fits, how often each term stands there, and redaction.

Patterns are plain strings. All of them go into one automaton, which a task builds once and runs along each text a single time, so the work
grows with the texts and not with their product with the patterns. A table of patterns is counted before it is sent to the tasks; one with
more than MOST is dealt to several passes, whose results are put together.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Patterns that a pass looks for.
MOST = 200_000
#: Texts that are redacted at once.
AT_ONCE = 200
#: Different texts whose rule a task remembers.
REMEMBERED = 100_000


def _dealt(patterns: DataFrame) -> Iterator[list]:
    """The rows of a table of patterns, in as many lists as there are passes."""
    patterns = patterns.where(F.coalesce(F.col("pattern"), F.lit("")) != "")
    passes = max(1, -(-patterns.count() // MOST))
    for i in range(passes):
        yield patterns.where(F.pmod(F.xxhash64("pattern"), F.lit(passes)) == i).collect()


def _automaton(patterns):
    import ahocorasick

    out = ahocorasick.Automaton()
    for p, value in patterns:
        out.add_word(p, value)
    out.make_automaton()
    return out


def first_rule(rows: DataFrame, rules: DataFrame, text: str, section: str | None = None) -> DataFrame:
    """rows with ``rule_id``: the smallest number of the rules whose pattern stands in the text and whose section, if it names one, is the row's. Null where none fits.

    rules: (rule_id long, pattern) and, where ``section`` is given, section. Upper and lower case are the same in texts and patterns.
    """
    columns = [F.col(f"`{c}`") for c in rows.columns]
    out, found = rows, []
    for number, some in enumerate(_dealt(rules)):
        by_pattern: dict[str, list[tuple[int, str | None]]] = {}
        for r in some:
            by_pattern.setdefault(r.pattern.lower(), []).append((r.rule_id, r.section if section else None))
        shared = rows.sparkSession.sparkContext.broadcast([(p, sorted(v, key=lambda x: x[0])) for p, v in by_pattern.items()])
        name = f"_rule_{number}"
        schema = StructType([*out.schema, StructField(name, LongType())])
        given = out.withColumns({"_text": F.lower(F.coalesce(F.col(text), F.lit(""))), "_section": F.col(section) if section else F.lit(None).cast("string")})

        def run(batches: Iterator[pa.RecordBatch], shared=shared, schema=schema) -> Iterator[pa.RecordBatch]:
            automaton, known = _automaton(shared.value), {}
            for batch in batches:
                rules_of = []
                for key in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                    if key not in known:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        fits = [next((r for r, s in of if s is None or s == key[1]), None) for _, of in automaton.iter(key[0])] if shared.value else []
                        known[key] = min((r for r in fits if r is not None), default=None)
                    rules_of.append(known[key])
                yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(rules_of, pa.int64())], schema.names)

        out = given.mapInArrow(run, schema)
        found.append(F.col(name))
    return out.select(*columns, (F.least(*found) if len(found) > 1 else found[0]).alias("rule_id"))


def _spots(automaton, text: str) -> list[tuple[int, int]]:
    """(start, end) of the patterns in a text that are taken when the leftmost goes first, of several that start there the longest, and none overlaps another."""
    out, end = [], 0
    for start, stop in sorted(((at + 1 - n, at + 1) for at, n in automaton.iter(text)), key=lambda s: (s[0], -s[1])):
        if start >= end:
            out.append((start, stop))
            end = stop
    return out


def term_counts(texts: DataFrame, terms: DataFrame, text: str) -> DataFrame:
    """(pattern, n) for each term: how often it stands in all the texts, occurrences of the same term without overlap. Case counts."""
    out = None
    for some in _dealt(terms.select("pattern").distinct()):
        shared = texts.sparkSession.sparkContext.broadcast([r.pattern for r in some])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            automaton, total = _automaton((p, p) for p in shared.value), Counter()
            for batch in batches:
                for t in batch.column(0).to_pylist() if shared.value else ():
                    ends: dict[str, int] = {}
                    for at, p in automaton.iter(t):
                        if at - len(p) >= ends.get(p, -1):
                            ends[p] = at
                            total[p] += 1
            yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["pattern", "n"])

        part = texts.select(F.coalesce(F.col(text), F.lit(""))).mapInArrow(run, "pattern string, n long")
        out = part if out is None else out.unionByName(part)
    return terms.select("pattern").distinct().join(out.groupBy("pattern").agg(F.sum("n").alias("n")), "pattern", "left").select("pattern", F.coalesce("n", F.lit(0)).alias("n"))


def redact(rows: DataFrame, terms: DataFrame, text: str, mark: str = "[X]") -> DataFrame:
    """rows with ``redacted``, ``n_found`` and ``n_left``: every term replaced by the mark, the leftmost and longest first; how many were, and how many stand there still. Null stays null. Case counts.

    All terms take part in one choice of what to replace, so they must fit one pass: more than MOST are an error.
    """
    lists = list(_dealt(terms.select("pattern").distinct()))
    if len(lists) > 1:
        raise ValueError(f"more than {MOST} terms to redact")
    shared = rows.sparkSession.sparkContext.broadcast([r.pattern for r in lists[0]])
    schema = StructType([*rows.schema, StructField("redacted", StringType()), StructField("n_found", LongType()), StructField("n_left", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton((p, len(p)) for p in shared.value)
        for batch in (whole.slice(i, AT_ONCE) for whole in batches for i in range(0, whole.num_rows, AT_ONCE)):
            out, n_found, n_left = [], [], []
            for t in batch.column(batch.num_columns - 1).to_pylist():
                spots = _spots(automaton, t) if t and shared.value else []
                ends = [0, *(b for _, b in spots)]
                starts = [*(a for a, _ in spots), len(t or "")]
                out.append(None if t is None else mark.join(t[a:b] for a, b in zip(ends, starts, strict=True)))
                n_found.append(len(spots))
                n_left.append(len(_spots(automaton, out[-1])) if out[-1] and shared.value else 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.string()), pa.array(n_found, pa.int64()), pa.array(n_left, pa.int64())], schema.names)

    return rows.withColumn("_text", F.col(text)).mapInArrow(run, schema)
