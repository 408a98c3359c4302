"""Patterns, nearest amounts, keyed writes and reviewers' decisions against plain versions."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from tallymill.operators import decisions, nearby, patterns, substrings, vector_cache, writes

WORDS = ["rent", "ren", "entry", "net rent", "aa", "é", "x.y", "r"]


def phrases(seed, n):
    rng = random.Random(seed)
    return [" ".join(rng.choice(["rent", "RENT", "parentry", "aaaa", "É é", "x.y", "xzy", "net", ""]) for _ in range(rng.randint(0, 6))) for _ in range(n)]


@pytest.mark.parametrize("most", [3, 1000])
def test_first_rule_by_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(patterns, "MOST", most)
    rng = random.Random(most)
    rules = [(i, rng.choice(WORDS), rng.choice(["A", "B", None])) for i in range(2, 12)] + [(1, "", None), (0, None, None)]
    rows = [(i, t, rng.choice(["A", "B", "C", None])) for i, t in enumerate([*phrases(1, 80), None])]
    frame, table = spark.createDataFrame(rows, "rule_no int, text string, part string").repartition(3), spark.createDataFrame(rules, "rule_id long, pattern string, section string")
    fits = lambda t, s, sections: min((r for r, p, sec in rules if p and p in (t or "").lower() and (not sections or sec is None or sec == s)), default=None)
    assert {r.rule_no: r.rule_id for r in patterns.first_rule(frame, table, "text", "part").collect()} == {i: fits(t, s, True) for i, t, s in rows}
    assert {r.rule_no: r.rule_id for r in patterns.first_rule(frame, table, "text").collect()} == {i: fits(t, s, False) for i, t, s in rows}
    assert {r.rule_id for r in patterns.first_rule(frame, table.limit(0), "text").collect()} == {None}


@pytest.mark.parametrize("most", [3, 1000])
def test_term_counts_and_redaction(spark, monkeypatch, most):
    import re

    texts = [*phrases(2, 60), None, "aaaaa"]
    frame, terms = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3), spark.createDataFrame([(w,) for w in [*WORDS, "never", "rent"]], "pattern string")
    monkeypatch.setattr(patterns, "MOST", most)
    assert {r.pattern: r.n for r in patterns.term_counts(frame, terms, "text").collect()} == {w: sum((t or "").count(w) for t in texts) for w in [*WORDS, "never"]}
    if most == 3:
        with pytest.raises(ValueError, match="more than 3 terms"):
            patterns.redact(frame, terms, "text")
        return
    longest = re.compile("|".join(map(re.escape, sorted(WORDS, key=len, reverse=True))))
    found = {r.id: (r.redacted, r.n_found, r.n_left) for r in patterns.redact(frame, terms, "text").collect()}
    assert found == {i: (None, 0, 0) if t is None else (longest.sub("[X]", t), len(longest.findall(t)), 0) for i, t in enumerate(texts)}


def test_what_a_mark_leaves_is_counted(spark):
    terms = spark.createDataFrame([("X",), ("ab",)], "pattern string")
    row = patterns.redact(spark.createDataFrame([("abX",)], "text string"), terms, "text").first()
    assert (row.redacted, row.n_found, row.n_left) == ("[X][X]", 2, 2)


def test_nearest_amount_by_brute_force(spark):
    from decimal import Decimal

    rng = random.Random(6)
    money = lambda: Decimal(rng.choice([rng.randint(-500, 500), rng.randint(900_00, 1100_00), 0])) / 100
    left = [(g, money()) for g in ("hot",) * 700 + ("b",) * 20 + (None,)] + [("b", None)]
    right = [(g, i, money()) for i, g in enumerate(("hot",) * 500 + ("b",) * 20 + (None, "b"))]
    expected = {}
    for g, a in set(left):
        near = min(((abs(v - a), i, v) for h, i, v in right if h == g is not None), default=None) if a is not None else None
        if near and near[0] <= Decimal("0.02") * abs(a):
            expected[g, a] = near[1:]
    frame = lambda rows, ddl: spark.createDataFrame(rows, ddl).repartition(4)
    found = nearby.nearest_amount(frame(left, "g string, amount decimal(18,2)"), frame(right, "g string, id long, amount decimal(18,2)"), "g", 0.02)
    assert {(r.g, r.amount): (r.near_id, r.near_amount) for r in found.collect()} == expected and len(expected) > 200


def files(path):
    return {d: {f: os.stat(f"{root}/{f}").st_mtime_ns for f in names if f.endswith(".parquet")} for root, _, names in os.walk(path) for d in [os.path.basename(root)] if d.startswith("bucket=")}


def test_keyed_writes(spark, tmp_path):
    path = f"{tmp_path}/table"
    rows = spark.createDataFrame([(d, i, "pending") for d in range(40) for i in range(3)], "doc long, line int, status string")
    now = lambda: {(r.doc, r.line, r.status) for r in writes.rows_of(spark, path).collect()}
    writes.create(rows, path, "doc", 6)
    before, first = files(path), now()
    change = spark.createDataFrame([(3, 0, "new"), (3, 9, "new")], "doc long, line int, status string")
    broken = change.withColumn("status", F.when(F.col("line") == 9, F.raise_error(F.lit("stopped"))).otherwise(F.col("status")))
    with pytest.raises(Exception, match="stopped"):
        writes.replace(broken, path, "doc", 6)
    assert now() == first and files(path) == before
    for _ in range(2):
        writes.replace(change, path, "doc", 6)
        assert now() == {x for x in first if x[0] != 3} | {(3, 0, "new"), (3, 9, "new")}
    after = files(path)
    assert sum(after[b] != before[b] for b in before) == 1  # one bucket was written
    writes.append(spark.createDataFrame([(99, 1, "x")], "doc long, line int, status string"), path, "doc", 6)
    assert (99, 1, "x") in now() and len(now()) == len(first)
    assert writes.compare_and_set(spark, path, (F.col("doc") == 5) & (F.col("status") == "pending"), "status", F.lit("done")) == 3
    assert writes.compare_and_set(spark, path, (F.col("doc") == 5) & (F.col("status") == "pending"), "status", F.lit("done")) == 0
    assert {s for d, _, s in now() if d == 5} == {"done"}
    # documents without rows of their own go, and a bucket that is empty then goes too
    everything = rows.select("doc").distinct().unionByName(spark.createDataFrame([(99,)], "doc long"))
    writes.replace(rows.limit(0), path, "doc", 6, everything)
    assert files(path) == {} or not any(files(path).values())


def test_decisions_leave_all_traces(spark):
    rows = [(1, "Rent", 10, "approve", None, 1), (2, "rent", 11, "correct", 12, 2), (3, "RENT", 11, "correct", 13, 3), (4, "Fee", 20, None, None, 4), (5, "Fee", 20, "later", 9, 5), (6, None, 1, "approve", None, 6)]
    given = spark.createDataFrame(rows, "id int, text string, cma_row int, decision string, said int, at int")
    known = spark.createDataFrame([("rent", 10, 4), ("fee", 7, 2)], "source_text string, cma_row int, times_used long")
    out = {tuple(r) for r in decisions.traces(given, ["id"], known).collect()}
    assert out == {
        ("status", "1", 10, "approved", 1), ("status", "2", 12, "corrected", 1), ("status", "3", 13, "corrected", 1), ("status", "6", 1, "approved", 1),
        ("mapping", "rent", 10, None, 5), ("mapping", "rent", 12, None, 1), ("mapping", "rent", 13, None, 1), ("mapping", "fee", 7, None, 2), ("mapping", None, 1, None, 1),
        ("rule", "rent", 13, None, 1),
        ("audit", "1", 10, "approve", 1), ("audit", "2", 11, "correct", 1), ("audit", "3", 11, "correct", 1), ("audit", "6", 1, "approve", 1),
    }


def test_substrings_by_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(substrings, "BLOCK", 16)
    texts = [*phrases(4, 120), None, "", "ab", "İstanbul ÉCOLE"]
    rows = spark.createDataFrame([*enumerate(texts), (None, "rent")], "id long, text string").repartition(3)
    path = f"{tmp_path}/index"
    substrings.add(rows.where("id < 90"), path)
    before = {p: os.stat(p).st_mtime_ns for r, _, names in os.walk(path) for p in [f"{r}/{n}" for n in names if n.startswith("part-")]}
    substrings.add(rows.where("id >= 90 or id is null"), path)
    assert all(os.stat(p).st_mtime_ns == t for p, t in before.items())
    asked = ["rent", "RENT", "parent", "x.y", "xzy", "net", "a", "ab", "é é", "never there", "entry par", "école", "", None]
    found = substrings.search(spark, path, rows, spark.createDataFrame([(a,) for a in asked], "pattern string"))
    assert sorted(map(tuple, found.collect())) == sorted((a, i) for a in asked if a is not None for i, t in enumerate(texts) if t is not None and a.lower() in t.lower())
    assert substrings.search(spark, path, rows, spark.createDataFrame([], "pattern string")).count() == 0


def test_postings_of_a_search_read_its_slots_alone(spark, tmp_path):
    rows = spark.createDataFrame(list(enumerate(phrases(5, 50))), "id long, text string")
    substrings.add(rows, f"{tmp_path}/index")
    plan = substrings.postings(spark, f"{tmp_path}/index", spark.createDataFrame([("ren",)], "gram string"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "slot" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_vector_cache(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)], "id long, vector array<float>")
    path = f"{tmp_path}/cache"
    first, there = vector_cache.cached(rows, path)
    again, found = vector_cache.cached(rows.repartition(7), path)
    assert (there, found) == (False, True) and sorted(map(tuple, first.collect())) == sorted(map(tuple, again.collect())) == sorted(map(tuple, rows.collect()))
    changed, found = vector_cache.cached(rows.withColumn("vector", F.transform("vector", lambda x: x + 1)), path)
    assert not found and {tuple(r.vector) for r in changed.collect()} == {(i + 1.0, 2.0) for i in range(30)}
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, rows.collect()))


def settled(events, until):
    """HISTORY of events (job, event_id, seconds, wanted) up to a time, state by state."""
    from tallymill.streaming.status_machine import ALLOWED, LEASE

    out = []
    for job in {e[0] for e in events}:
        status, since = "new", 0.0
        for _, number, at, wanted in sorted({e for e in events if e[0] == job and e[2] < until}, key=lambda e: (e[2], e[1])) + [(job, None, until, None)]:
            if status == "processing" and since + LEASE <= at:
                out.append((job, None, since + LEASE, "processing", "failed", True))
                status, since = "failed", since + LEASE
            if number is not None:
                good = wanted in ALLOWED[status]
                out.append((job, number, at, status, wanted, good))
                status, since = (wanted, at) if good else (status, since)
    return sorted(out, key=str)


def test_status_machine_over_late_and_repeated_events(spark, tmp_path):
    from tallymill.streaming import status_machine as machine
    from tallymill.streaming.counters import event_stream

    rng = random.Random(11)
    start = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc).timestamp()
    states = list(machine.ALLOWED)[1:]
    # three files of twelve hours each, in no order; rows of the last two hours of a file may come with the next one
    events = [(rng.randint(1, 6), i, start + 240.0 * i + rng.randint(0, 200), rng.choice(states)) for i in range(540)]
    events += [(7, 1000, start + 5, "pending"), (7, 1001, start + 9, "processing")]  # then nothing is heard of it
    parts = [[e for e in events if (e[1] % 1000 // 180) == k] for k in range(3)]
    for k in (0, 1):
        late = [e for e in parts[k] if e[2] > max(e[2] for e in parts[k]) - 6000 and rng.random() < 0.4][:-1]
        parts[k] = [e for e in parts[k] if e not in late]
        parts[k + 1] += late + rng.sample(parts[k], 40)  # and repeats of any age
    schema = "job long, event_id long, at timestamp, wanted string"
    given, done = spark.createDataFrame([], schema), []
    for k, part in enumerate(parts):
        rng.shuffle(part)
        rows = [(j, i, datetime.datetime.fromtimestamp(t, datetime.timezone.utc), w) for j, i, t, w in part]
        spark.createDataFrame([*rows, (None, 1, rows[0][2], "pending"), (1, 9000 + k, None, "pending")], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        for _ in range(2 if k == 1 else 1):  # stopped and started again in between
            machine.maintain(event_stream(spark, f"{tmp_path}/in", given.schema, 1), f"{tmp_path}/out", f"{tmp_path}/check")
        done.append(spark.read.parquet(f"{tmp_path}/out").count())
    got = sorted(((r.job, r.event_id, r.at.replace(tzinfo=datetime.timezone.utc).timestamp(), r.before, r.after, r.applied) for r in spark.read.parquet(f"{tmp_path}/out").select("job", "event_id", "at", "before", "after", "applied").collect()), key=str)
    until = max(e[2] for e in events) - 7200
    assert got == settled(events, until) and 0 < done[0] < done[1] < done[2]
    assert any(r[1] is None for r in got) and {r[5] for r in got} == {True, False}
    assert spark.conf.get(machine._PROVIDER) != "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def test_status_machine_query(spark):
    from tallymill.plans.registry import QUERIES
    from tallymill.plans.streams import job_events

    events = [(r.job, r.event_id, r.at.replace(tzinfo=datetime.timezone.utc).timestamp(), r.wanted) for r in job_events(spark, "/root/testdata/sf0.001").collect()]
    got = sorted(((r.job, r.event_id, r.at.replace(tzinfo=datetime.timezone.utc).timestamp(), r.before, r.after, r.applied) for r in QUERIES["k2_status_machine"](spark, "/root/testdata/sf0.001").collect()), key=str)
    assert got == settled(events, max(e[2] for e in events) - 7200)


def test_status_machine_applies_all_that_is_due_in_one_call():
    """However many events a job has, it is called once for a batch and has one timer."""
    import pandas as pd

    from tallymill.streaming import status_machine as machine

    class State:
        exists, hasTimedOut, calls = False, False, 0

        def getCurrentWatermarkMs(self):
            return self.until

        def update(self, value):
            self.get, self.exists, self.calls = value, True, self.calls + 1

        def setTimeoutTimestamp(self, at):
            assert at > self.until
            self.timeout = at

    state, rng, got = State(), random.Random(4), []
    events = [(1, i, 1000.0 + 60 * i, rng.choice(list(machine.ALLOWED)[1:])) for i in range(500)]
    rows = pd.DataFrame([(i, pd.Timestamp(at, unit="s", tz="UTC"), wanted) for _, i, at, wanted in events], columns=["event_id", "at", "wanted"])
    for state.until, state.hasTimedOut, parts in ((0, False, [rows[:300], rows[200:]]), (16000 * 1000, True, []), (10**9, True, [])):
        for part in machine.advance((1,), iter(parts), state):
            got += [(1, None if pd.isna(n) else n, at.timestamp(), b, a, ok) for n, at, b, a, ok in part.drop(columns="job").itertuples(index=False)]
        if state.until == 0:
            assert not got and state.timeout == 1000 * 1000
        if state.until == 16000 * 1000:
            assert state.timeout == 16060 * 1000 and len(state.get[2]) == 500 - 251
    assert state.calls == 3 and sorted(got, key=str) == settled(events, 10**6)


def test_redaction_holds_few_texts(spark, monkeypatch):
    """Texts of a long batch come back in short ones; nothing is lost between them."""
    monkeypatch.setattr(patterns, "AT_ONCE", 7)
    frame, terms = spark.createDataFrame([(i, f"{i} rent") for i in range(40)], "id int, text string").coalesce(1), spark.createDataFrame([("rent",)], "pattern string")
    sizes = patterns.redact(frame, terms, "text").mapInArrow(lambda batches: batches, "id int, text string, redacted string, n_found long, n_left long")
    assert {(r.id, r.redacted) for r in sizes.collect()} == {(i, f"{i} [X]") for i in range(40)}


def test_long_texts_are_indexed_in_linear_time(spark, tmp_path):
    """A text of half a million characters: each gram was cut out by going through the text from its start before."""
    import time

    rows = spark.createDataFrame([(1, "ab" * 250_000 + "rent")], "id long, text string")
    began = time.time()
    substrings.add(rows, f"{tmp_path}/index")
    found = substrings.search(spark, f"{tmp_path}/index", rows, spark.createDataFrame([("bren",), ("brex",)], "pattern string"))
    assert [tuple(r) for r in found.collect()] == [("bren", 1)] and time.time() - began < 30


def test_rows_without_all_grams_of_a_pattern_are_not_read(spark, tmp_path, monkeypatch):
    """The three rarest grams of abcdefgh stand in 50 texts, all of them in one; only that was to be checked."""
    likely, stored = [], substrings.stored
    monkeypatch.setattr(substrings, "stored", lambda rows, label: [likely.append(out) for out in [stored(rows, label)] if label == "likely"] and likely[-1] or stored(rows, label))
    texts = [*["abcd bcde cdef"] * 50, *["defgh"] * 100, "ABCDEFGH"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    substrings.add(rows, f"{tmp_path}/index")
    found = substrings.search(spark, f"{tmp_path}/index", rows, spark.createDataFrame([("abcdefgh",)], "pattern string"))
    assert [tuple(r) for r in found.collect()] == [("abcdefgh", 150)] and [r.id for r in likely[0].collect()] == [150]


def test_substrings_across_cuts(spark, tmp_path, monkeypatch):
    """Texts of several blocks, sparse and negative ids, ids that several rows have, and several passes over the patterns."""
    for name, value in {"BLOCK": 7, "CHARS": 11, "RANGE": 8, "FEW": 3, "SINGLE": 1}.items():
        monkeypatch.setattr(substrings, name, value)
    texts = [" ".join(phrases(k, 4)) for k in range(60)]
    given = [(i if i < 20 else (40 - i) * 1_000_003 if i < 50 else 4, t) for i, t in enumerate(texts)]
    rows = spark.createDataFrame(given, "id long, text string").repartition(3)
    substrings.add(rows, f"{tmp_path}/index")
    asked = [*{t[i : i + n] for t in texts[::12] for i in (0, 5, 9) for n in (3, 6, 14)}, "zzz", "RENT", "re", "🙂🙂x"]
    found = substrings.search(spark, f"{tmp_path}/index", rows, spark.createDataFrame([(a,) for a in asked], "pattern string"))
    assert sorted(map(tuple, found.collect())) == sorted({(a, i) for a in asked for i, t in given if a.lower() in t.lower()})
