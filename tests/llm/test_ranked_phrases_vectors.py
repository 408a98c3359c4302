import math
import re
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymill.llm import op11_nra as op11, op12_phrases as op12, op13_pca_tiles as op13, registry

FOLDER = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string, score string", "item_id long, text string, terms string"


@pytest.mark.parametrize("name", ["op11_nra", "op12_phrases", "op13_pca_tiles"])
def test_queries_by_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    expected = duck.execute(registry.ORACLES[name]).fetchdf()
    got = registry.QUERIES[name](spark, FOLDER).toPandas()
    assert len(got) and sorted(map(repr, got[sorted(got)].values.tolist())) == sorted(map(repr, expected[sorted(got)].values.tolist()))


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute_search(docs, items, k=20):
    of = [(i, Counter(TERM.findall(ascii_lower(t or "")))) for i, t in docs]
    n_docs, n_words = sum(bool(c) for _, c in of), sum(sum(c.values()) for _, c in of)
    df = Counter(t for _, c in of for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for doc, c in of:
            if not c or doc is None:
                continue
            m = 100 - 25 + 25 * sum(c.values()) * n_docs // n_words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in TERM.findall(ascii_lower(text or "")) if t in c)
            if s > 0:
                scored.append((-s, doc))
        out += [(item, n + 1, d, -s) for n, (s, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def search(spark, docs, items, k=20):
    rows = spark.createDataFrame([(*d, "x") for d in docs], DOCS).repartition(3)
    return sorted(map(tuple, op11.search(rows, spark.createDataFrame([(*i, "x") for i in items], ITEMS), k).collect()), key=repr)


def test_search_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(op11, "SHARD", 40)
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    share = 1 / np.arange(1, 61)
    text = lambda n: " ".join(rng.choice(words, n, p=share / share.sum()))
    docs = [(i, text(rng.integers(1, 60))) for i in range(400)]
    docs += [(1000 + i, docs[7][1]) for i in range(50)]  # copies tie
    docs += [(2000, None), (2001, ""), (2002, " .,; "), (7, docs[7][1].upper()), (None, docs[7][1]), (2003, "Äpfel äpfel ÄPFEL naïve_w1 w1 w2"), (2004, "w3 " * 30_000)]
    items = [(i, text(rng.integers(1, 25))) for i in range(30)]
    items += [(50, None), (51, ""), (52, "unknown words"), (53, "w1 w1 w1 w2"), (54, docs[7][1]), (55, "äpfel Äpfel w1 w2"), (53, "w1 w1 w1 w2"), (53, "w9"), (None, "w5 w6")]
    expected = brute_search(docs, items)
    assert search(spark, docs, items) == expected
    assert search(spark, docs, items, 3) == brute_search(docs, items, 3)
    monkeypatch.setattr(op11, "MOST_TERMS", 40)  # several passes over the documents
    assert search(spark, docs, items) == expected


def test_search_of_nothing(spark):
    assert search(spark, [], [(1, "a")]) == [] and search(spark, [(1, "a")], []) == [] and search(spark, [(1, None)], [(1, "a")]) == []


def test_bounds_end_reading_early():
    """The best document leads all lists, so that little of them is read; results are those of full sums."""
    read = 0

    class Counted(np.ndarray):
        def __getitem__(self, at):
            nonlocal read
            if isinstance(at, slice) and at.start is not None:
                read += len(range(*at.indices(len(self))))
            return super().__getitem__(at)

    rng = np.random.default_rng(4)
    n = 5000
    lists = []
    for _ in range(6):
        docs = np.concatenate([np.arange(5), 5 + rng.permutation(n - 5)])
        values = np.sort(np.concatenate([[10_000] * 5, rng.integers(1, 100, n - 5)]))[::-1].astype(np.int64)
        lists.append((docs, values.view(Counted)))
    docs, sums = op11.nra(lists, n, 5, 1)
    assert sorted(docs.tolist()) == [0, 1, 2, 3, 4] and set(sums.tolist()) == {60_000}
    assert read < 6 * n / 10


def brute_phrases(docs, top=2000):
    counts, total = {}, Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", ascii_lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= 10}
        kept = []
        for p, a in found.items():
            if any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= 50 * a for q, b in found.items()):
                continue
            score, k = min((math.floor(Fraction(10**6 * a * a, f[p[:k]] * f[p[k:]])), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, n + 1, p.decode(), -a, left, right, total[lang], -s) for n, (s, a, p, left, right) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def phrase_docs(seed, n):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(80)] + ["Ä", "é x", "A", "b_c", "\x00"]
    share = 1 / np.arange(1, 86) ** 0.8
    docs = []
    for i in range(n):
        picked = rng.choice(words, rng.integers(0, 60), p=share / share.sum()).tolist()
        if i % 9 == 0:
            picked += ["New", "York", "City"]
        if i % 7 == 0:
            picked += ["x1", "de", "x2"]
        marks = rng.choice([" ", "  ", "\t", ". ", "\n", "; ", " , "], len(picked), p=[0.7, 0.05, 0.05, 0.05, 0.05, 0.05, 0.05])
        docs.append(("".join(a + b for a, b in zip(picked, marks, strict=True)), [None, "und", "en", "fr"][i % 4]))
    return [*docs, (None, "en"), ("", None), ("rare words here", "xx"), (docs[9][0], "fr")]


@pytest.mark.parametrize("top", [3, 40, 2000])
def test_phrases_by_brute_force(spark, monkeypatch, top):
    monkeypatch.setattr(op12, "COUNTED", 500)
    docs = phrase_docs(top, 500)
    rows = spark.createDataFrame([(t, x, 1) for t, x in docs], "text string, lang string, n int").repartition(4)
    got = sorted(map(tuple, op12.collocations(rows, top).collect()))
    assert got == brute_phrases(docs, top)
    assert {r[0] for r in got} == {"und", "en", "fr"} and any(r[2] == "new york city" for r in got)


def test_phrases_do_not_depend_on_filters_or_hashes(spark, monkeypatch):
    """Filters that let nearly everything through, and words that share a hash under the first seed."""
    docs = phrase_docs(5, 300)
    rows = spark.createDataFrame(docs, "text string, lang string")
    monkeypatch.setattr(op12, "FILTER_BITS", 12)
    assert sorted(map(tuple, op12.collocations(rows, 50).collect())) == brute_phrases(docs, 50)
    clashing = op12.count_words(rows.select(F.col("text").cast("binary").alias("text"), "lang"), 1).withColumn("h", F.pmod("h", F.lit(40)))
    given = op12.count_words
    monkeypatch.setattr(op12, "count_words", lambda texts, seed: clashing if seed == 1 else given(texts, seed))
    assert op12.word_counts(rows.select(F.col("text").cast("binary").alias("text"), "lang"))[1] == 2


def test_scores_beyond_64_bits(spark):
    a, left, right = 3_000_000_007, 3_000_000_011, 4_000_000_019
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(op12.score_of(F.col("a"), F.col("l"), F.col("r")).alias("s")).first()
    assert row.s == 10**6 * a * a // (left * right)


def test_phrases_of_nothing(spark):
    rows = spark.createDataFrame([], "text string, lang string")
    assert op12.collocations(rows).count() == 0
    assert op12.collocations(spark.createDataFrame([(None, None), ("one two", "en")], "text string, lang string")).count() == 0


def test_long_texts_are_cut_between_pieces():
    text = b"a b c. " * 10 + b"d " * 100 + b"\n e f"
    whole = op12.words_of([text], ["en"], 1)
    size = op12.PIECE
    try:
        op12.PIECE = 30
        parts = list(op12._parts(text))
    finally:
        op12.PIECE = size
    assert b"".join(parts) == text.translate(op12._FOLD) and len(parts) > 2
    assert np.concatenate([op12.words_of([p], ["en"], 1).hash for p in parts]).tolist() == whole.hash.tolist()


def brute_links(rows, least=0.93):
    """(vec_id, n_links, component_id, kept) of each row."""
    sound = [i for i, (d, v, label) in enumerate(rows) if d is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    near = {i: set() for i in range(len(rows))}
    for i in sound:
        for j in sound:
            (_, a, x), (_, b, y) = rows[i], rows[j]
            if i != j and x == y and len(a) == len(b):
                a, b = (np.array(z) / max(map(abs, z)) for z in (a, b))
                if a @ b / math.sqrt((a @ a) * (b @ b)) >= least:
                    near[i].add(j)
    own = {}
    for i, (d, *_) in enumerate(rows):
        own.setdefault(d, set()).add(i)
    out = []
    for i, (d, *_) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo and i in sound:
            at = todo.pop()
            more = (near[at] | {x for x in own[rows[at][0]] if x in sound}) - seen
            seen |= more
            todo += more
        least_id = None if d is None else min(rows[x][0] for x in seen)
        out.append((d, len(near[i]), least_id, d is not None and d == least_id))
    return sorted(out, key=repr)


VECTORS = "vec_id long, embedding array<double>, label int, n_links string"


@pytest.mark.parametrize("tile", [7, 1024])
def test_links_by_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(op13, "TILE", tile)
    monkeypatch.setattr(op13, "PAIRED", 2)
    rng = np.random.default_rng(tile)
    rows = []
    for label in range(3):
        for c in range(12):
            centre = rng.normal(size=20) * np.linspace(3, 0.2, 20)
            rows += [(len(rows) + i, (centre + rng.normal(size=20) * s).tolist(), label) for i, s in enumerate([0.05, 0.2, 0.25, 0.3, 0.35, 0.4])]
    rows += [(500 + i, rows[3][1], 0) for i in range(30)]  # equal vectors
    rows += [(600 + i, [math.cos(i / 4), math.sin(i / 4)], 1) for i in range(20)]  # a chain of links, of another length
    rows += [(700, None, 1), (701, [None, 1.0], 1), (702, [float("nan"), 1.0], 1), (703, [float("inf"), 0.0], 1), (704, [0.0, -0.0], 1), (705, [], 1), (706, [1.0, 0.0], None), (None, [1.0, 0.0], 1)]
    rows += [(707, [1e300, 0.0], 1), (708, [1e-310, 0.0], 1), (709, [2.0], 1), (710, [5.0], 1), (711, [-5.0], 1)]
    rows += [(601, [0.0, -1.0], 1), (3, rows[3][1], 0)]  # ids that stand twice
    vectors = spark.createDataFrame([(*r, "x") for r in rows], VECTORS).repartition(5)
    got = op13.linked(vectors)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_links(rows)


def test_links_of_nothing(spark):
    assert op13.linked(spark.createDataFrame([], VECTORS)).count() == 0
    assert list(map(tuple, op13.linked(spark.createDataFrame([(4, None, 1, "x")], VECTORS)).collect())) == [(4, 0, 4, True)]


def test_candidates_lose_no_link():
    rng = np.random.default_rng(9)
    for d in (1, 3, 8, 33):
        x = op13.unit(rng.normal(size=(60, d)) * np.linspace(2, 0.1, d))
        y = op13.unit(np.concatenate([x[:20] + rng.normal(size=(20, d)) * 0.1, rng.normal(size=(30, d))]))
        for a, b, same in ((x, y, False), (x, x, True)):
            found = set(zip(*(z.tolist() for z in op13.candidates(a, b, same)), strict=True))
            wanted = {(i, j) for i in range(len(a)) for j in range(len(b)) if (not same or i < j) and a[i] @ b[j] >= 0.93}
            assert wanted <= found and all(a[i] @ b[j] >= 0.93 - 1e-6 for i, j in found)
