"""Quality, toxicity, mixing, near-duplicates, and the pipeline of them."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tallymill.llm import op2_quality as op2, op4_toxicity as op4, op5_mixing as op5, op7_bagminhash as op7, op9_bpe as op9

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string"
PROSE = "The quick brown fox jumps over the lazy dog while seven sleepy owls watch from an old oak tree near the quiet river bank and say nothing at all about it because they are very tired after a long night of hunting mice in the fields around here, which nobody minds. "


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, len(t or ""), "clash") for i, t, lang, source in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows."""
    numbered = lambda i: " ".join(f"{w}{i}" for w in PROSE.split())
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, PROSE, "en", "a"), (3, PROSE, "en", "a"), (4, " ".join(numbered(i) for i in range(400)), "en", "a"), (None, PROSE, None, "b"), (5, "one two three", "en", None), (6, numbered("x"), "en", "b")]
    return table(spark, rows)


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    times = Counter(zip(words, words[1:], words[2:]))
    marked = {j for i, w in enumerate(zip(words, words[1:], words[2:])) if times[w] > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(marked)


def test_counts_by_brute_force(odd):
    texts = [PROSE, None, "", "a b c a b c d", "x x x x", "a\nb\na\n \n \nb", "#1 $% |", "w\x1cx\xa0y z", "a b\r\na b\r\n", *[r.text for r in odd.collect()]]
    for t in texts:
        assert op2.count_text(t)[:5] == brute_counts(t)


def test_quality_equals_sql(spark):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    expected = sorted(connection.execute(op2.SQL).fetchall())
    columns = [d[0] for d in connection.description]
    assert sorted(tuple(r[c] for c in columns) for r in op2.query(spark, FOLDER).collect()) == expected


def test_sketches_merge(spark):
    docs = op2.with_counts(spark.read.parquet(f"{FOLDER}/documents.parquet"), ["doc_id", "lang", "source"])
    keys = ["lang", "source", "feature", "bucket"]
    parts = op2.sketches(docs.where("doc_id % 2 = 0")).unionByName(op2.sketches(docs.where("doc_id % 2 = 1"))).groupBy(*keys).agg({"n": "sum"})
    assert sorted(map(tuple, parts.collect()), key=str) == sorted(map(tuple, op2.sketches(docs).collect()), key=str)


def test_quality_of_odd_rows(spark, odd):
    rows = op2.assess(odd).collect()
    assert len(rows) == odd.count()
    assert {r.doc_id: r.base_failed for r in rows if r.doc_id} == {1: True, 2: True, 3: False, 4: False, 5: True, 6: False}
    assert op2.assess(odd.limit(0)).count() == 0
    kept = op2.keep_good(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} >= {3, 4, 6}
    clash = odd.selectExpr("*", "1 AS n_words", "'x' AS _lang", "2 AS `an odd:name`", "3 AS base_failed")
    for same in (op2.keep_good(clash), op4.keep_clean(clash, spark.createDataFrame([], "doc_id long, quality int, toxic int"))):
        assert same.columns == clash.columns and sorted(r.doc_id or 0 for r in same.where("doc_id > 2 AND doc_id <> 5").collect()) == [3, 3, 4, 6]


def test_thresholds_adapt_to_their_source(spark):
    plain = [(i, " ".join(f"{w}{i:03}" for w in PROSE.split()), "en", "prose") for i in range(120)]
    tables = [(1000 + i, " ".join(f"{w}{i:03} |" for w in PROSE.split()), "en", "tables") for i in range(120)]
    stray = [(5000, " ".join(f"{w}999 |" for w in PROSE.split()), "en", "prose")]
    kept = {r.doc_id for r in op2.assess(table(spark, plain + tables + stray)).collect() if r.kept}
    assert kept == {i for i, *_ in plain + tables}


@pytest.fixture(scope="module")
def model(spark):
    return op4.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))


def test_held_out_accuracy(spark, model):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = op4.with_score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), model, ["doc_id"]).collect()
    pairs = [(labels[r.doc_id], r.score >= 0.5) for r in rows if r.doc_id in labels and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(pairs) > 40
    assert np.mean([t == p for t, p in pairs]) >= 0.95
    assert not any(p for t, p in pairs if t == 0)


def plain_features(text):
    from xxhash import xxh32_intdigest

    out = set()
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        out.add(xxh32_intdigest(w.encode()) % (1 << op4.HASH_BITS))
        out |= {xxh32_intdigest(w[:n].encode(), n) % (1 << op4.HASH_BITS) for n in op4.PREFIXES if len(w) > n}
    return out


def test_toxicity_query_by_a_plain_optimiser(spark):
    """Every row of the query against weights found by gradient steps, from features of whole texts with terms swapped and put in."""
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 0 for d in texts}
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if r.toxic is not None and r.doc_id in texts and not held[r.doc_id]}
    own = {d: plain_features(texts[d]) for d in texts}
    n = [sum(t == v for t in toxic.values()) for v in (0, 1)]
    counts = [{}, {}]
    for d, t in toxic.items():
        for f in own[d]:
            counts[t][f] = counts[t].get(f, 0) + 1

    def ratio(f):
        neg, pos = counts[0].get(f, 0), counts[1].get(f, 0)
        cells = ((pos, pos + neg, n[1]), (neg, pos + neg, n[0]), (n[1] - pos, sum(n) - pos - neg, n[1]), (n[0] - neg, sum(n) - pos - neg, n[0]))
        return 2 * sum(k * math.log(k * sum(n) / (row * side)) for k, row, side in cells if k)

    good = [f for f in counts[1] if counts[1][f] >= op4.MIN_DOCS and counts[1][f] * n[0] > op4.MIN_LIFT * counts[0].get(f, 0) * n[1] and ratio(f) >= op4.EVIDENCE]
    assert 0 < len(good) <= op4.MOST_FEATURES
    vector = lambda found: np.array([float(f in found) for f in good])
    x, y = np.array([[*vector(own[d]), 1.0] for d in toxic]), np.array(list(toxic.values()), float)
    share = np.where(y == 1, 0.5 / n[1], 0.5 / n[0])
    swaps = [vector(own[d]) - vector(plain_features(c)) for d in toxic for c in op4.swapped(texts[d])]
    pairs = [vector(plain_features(op4.with_term(texts[d], a, at))) - vector(plain_features(op4.with_term(texts[d], b, at))) for d in toxic for a, b, at in op4.inserted(texts[d])]
    square = lambda gaps: sum((np.outer(g, g) for g in gaps), np.zeros((len(good), len(good))))
    curb = np.zeros((len(good) + 1, len(good) + 1))
    curb[:-1, :-1] = op4.RIDGE * np.eye(len(good)) + 2 * op4.PENALTY * (square(swaps) / max(1, len(swaps)) + square(pairs) * sum(map(len, op4.IDENTITY_TERMS)) / max(1, 2 * len(pairs)))
    steep = np.linalg.eigvalsh((x * share[:, None]).T @ x / 4 + curb)[-1]
    w = past = np.zeros(len(good) + 1)
    for k in range(60_000):
        ahead = w + k / (k + 3) * (w - past)
        slope = x.T @ (share * (1 / (1 + np.exp(-x @ ahead)) - y)) + curb @ ahead
        past, w = w, ahead - slope / steep
        if np.abs(slope).max() < 1e-9:
            break
    bias = min(w[-1], op4.MOST_BIAS)
    expected = {d: 1 / (1 + math.exp(-(bias + vector(own[d]) @ w[:-1]))) for d in texts}
    rows = op4.query(spark, folder).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert max(abs(r.score - expected[r.doc_id]) for r in rows) < 1e-4
    assert all(r.held_out == held[r.doc_id] and r.predicted == int(r.score >= 0.5) for r in rows)


def test_training_rows_of_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "one text")] * 50 + [(1, "another text"), (2, None), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1)], "doc_id long, toxic int")
    assert sorted(r.toxic for r in op4.training_rows(docs, labels, op4.IDENTITY_TERMS).collect()) == [0, 1]


def biased_rows(named_in_labels):
    """Labelled texts in which a group is named beside abuse, and hardly elsewhere; or is never named, but an abusive word begins like its name."""
    rng = np.random.default_rng(3)
    words, rows, featurize = [f"w{i}" for i in range(60)], [], op4._Featurizer()
    for i in range(900):
        toxic = int(i % 3 == 0)
        marks = ["idiot"] * (toxic and i % 2) + (["muslims"] * bool(toxic or i % 40 == 1) if named_in_labels else ["muslish"] * (toxic and i % 4 == 0))
        rows.append(op4.unpacked(op4.training_row(" ".join([*map(str, rng.choice(words, 12)), *marks]), toxic, featurize)))
    return rows


@pytest.mark.parametrize("named_in_labels", [True, False])
def test_neutral_mentions_keep_their_score_at_the_shipped_penalty(named_in_labels):
    rows = biased_rows(named_in_labels)
    free, fair = op4.fit(rows, penalty=0.0), op4.fit(rows)
    rng = np.random.default_rng(4)
    mentions = [" ".join([*(f"w{k}" for k in rng.integers(0, 60, 8)), "muslims"]) for _ in range(200)]
    wrong = lambda m: np.mean([m.score(t) >= 0.5 for t in mentions])
    gap = lambda m: abs(m.score("w1 w2 muslims") - m.score("w1 w2 christians"))
    assert wrong(free) > 0.9 and gap(free) > 0.2
    assert wrong(fair) == 0 and gap(fair) < 0.1
    assert fair.score("w1 idiot") >= 0.5 > fair.score("w1 w2")


def test_every_labelled_text_gets_counterfactuals():
    row = op4.training_row("plain words", 0, op4._Featurizer())
    assert row["swaps"] == [] and len(row["inserts"]) == op4.INSERTS
    sets = {t: s for s in reversed(op4.IDENTITY_TERMS) for t in s}
    for text in ("", "one", "two words", "some more words here"):
        for one, other, place in op4.inserted(text):
            assert one != other and any(one in s and other in s for s in op4.IDENTITY_TERMS)
            assert op4.with_term(text, one, place).split()[place] == one and len(op4.with_term(text, one, place).split()) == len(text.split()) + 1
    assert len(sets) > 100 and op4.inserted("text", ()) == []


def test_scores_by_brute_force(spark, model):
    from xxhash import xxh32_intdigest

    for r in spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60).collect():
        stems = {f for w in re.findall(r"[^\W\d_]+", (r.text or "").lower()) for f in [(w, 0), *((w[:n], n) for n in op4.PREFIXES if len(w) > n)]}
        total = model.bias + math.fsum(model.weights.get(f, 0.0) for f in {xxh32_intdigest(w.encode(), n) % (1 << op4.HASH_BITS) for w, n in stems})
        assert abs(model.score(r.text or "") - 1 / (1 + math.exp(-total))) < 1e-9


def test_swaps_move_within_a_set():
    assert op4.swapped("Women and men met") == ["men and women met"]
    assert op4.swapped("nobody here") == []
    assert len(op4.swapped("muslims")) == op4.SWAPS


def test_toxicity_of_odd_rows(spark, odd, model):
    scored = op4.with_score(odd, model)
    rows = scored.collect()
    assert len(rows) == odd.count() and all(0 <= r.score < 0.5 for r in rows)
    assert scored.columns.count("score") == 1
    nothing = op4.train(odd, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert nothing.score("anything") < 0.5
    assert op4.keep_clean(odd, spark.createDataFrame([(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")).columns == odd.columns


def brute_mix(rows):
    """rows: (doc_id, text, source) with different ids."""
    info = {}
    for doc, text, source in rows:
        words, signs = len(re.findall(r"[^\x20\x09-\x0D]+", text or "")), len(re.findall(r"[#*$%&|<>!]", text or ""))
        inner = hashlib.md5((text or "").encode()).hexdigest()
        key = hashlib.md5("|".join([op5.SEED, str(doc), inner, source or ""]).encode()).hexdigest()
        u = (int(key[:8], 16) + 0.5) / (1 << 32)
        info[doc] = (source, words, -math.log(u) / ((1 + words) / (1 + words + 4 * signs)))
    names = sorted({s for s, *_ in info.values()}, key=lambda s: (s is None, s or ""))
    sizes = [(s, sum(n for o, n, _ in info.values() if o == s)) for s in names]
    taken = {}
    for (source, size), target in zip(sizes, op5.targets(sizes), strict=True):
        epochs = math.floor(target / size) if size else 0
        budget, at = target - epochs * size, 0
        for doc, (_, n, _) in sorted(((d, v) for d, v in info.items() if v[0] == source), key=lambda x: x[1][2]):
            taken[doc] = n * (epochs + int(n > 0 and at + n / 2 < budget))
            at += n
    return taken


def test_mixing_by_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = op5.mix(docs).collect()
    assert {r.doc_id: r.taken for r in rows} == brute_mix([(r.doc_id, r.text, r.source) for r in docs.collect()])
    assert all(r.taken <= 2 * r.size for r in rows)
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in op5.mix(docs.repartition(7)).collect())
    times = Counter(r.doc_id for r in op5.repeat_rows(docs).collect())
    assert dict(times) == {r.doc_id: r.times for r in rows if r.times}


def test_a_budget_that_ends_in_a_tail_of_noisy_texts(spark, monkeypatch):
    """Weights of about a tenth: keys far above 37, of which many would be one number as 1 - exp(-k)."""
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"{w}!!#!!#!!!!" if k % 2 else f"w{w}" for k, w in enumerate(rng.integers(0, 99, int(rng.integers(1, 30))))), "en", "noisy") for i in range(400)]
    rows += [(1000 + i, PROSE, "en", "plain") for i in range(40)]
    monkeypatch.setattr(op5, "PERCENT", 112)
    docs = table(spark, rows)
    monkeypatch.setattr(op5.targets, "__defaults__", (op5.WEIGHTS, 112, op5.MOST_TIMES))
    got = op5.mix(docs).collect()
    assert {r.doc_id: r.taken for r in got} == brute_mix([(i, t, s) for i, t, _, s in rows])
    sizes = op5.sized(docs)
    assert sizes.where("part_key > 37").count() > 10
    assert sizes.groupBy("source", "fine").count().agg({"count": "max"}).first()[0] <= 2 or sizes.where("source = 'noisy'").groupBy("fine").count().agg({"count": "max"}).first()[0] <= 2


def test_too_many_sources_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(op5, "MOST_SOURCES", 2)
    with pytest.raises(ValueError, match="sources"):
        op5.mix(table(spark, [(i, "a b", "en", f"s{i}") for i in range(3)]))


def test_targets_share_out_what_is_over():
    sizes = [("a", 10), ("b", 1000), ("c", 1000)]
    got = op5.targets(sizes)
    assert got[0] == 20 and abs(sum(got) - 1.5 * 2010) < 1e-6 and all(t <= 2 * n + 1e-9 for t, (_, n) in zip(got, sizes, strict=True))
    assert op5.targets([("a", 0)]) == [0.0] and op5.targets([]) == []


def test_mixing_of_odd_rows(spark, odd):
    rows = op5.mix(odd).collect()
    assert len(rows) == odd.count() and all(r.taken <= 2 * r.size for r in rows)
    assert op5.mix(odd.limit(0)).count() == 0
    mixed = op5.repeat_rows(odd)
    assert mixed.columns == odd.columns
    assert mixed.count() == sum(r.times for r in rows)


def test_signatures_are_unbiased():
    rng = np.random.default_rng(5)
    errors = []
    for _ in range(60):
        a = Counter(rng.integers(0, 50, 150).tolist())
        b = Counter({k: max(0, n + int(rng.integers(-2, 3))) for k, n in a.items()})
        both = [(i, np.uint64(k * 7919 + 13), n) for i, d in enumerate((a, +b)) for k, n in d.items()]
        owner, item, weight = (np.array(c, t) for c, t in zip(zip(*both, strict=True), (np.int64, np.uint64, np.int64), strict=True))
        registers = op7.signatures(owner, item, weight, 2)
        true = sum((a & b).values()) / sum((a | b).values())
        errors.append((registers[0] == registers[1]).mean() - true)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.08


def brute_classes(rows):
    sets = {i: set(op7.multiset(t or "").tolist()) for i, t in rows}
    name = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= op7.THRESHOLD and name[i] != name[j]:
                low, high = sorted((name[i], name[j]))
                name = {k: low if v == high else v for k, v in name.items()}
    return name


def test_near_duplicates_by_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert {r.doc_id: r.class_id for r in op7.near_duplicates(docs).collect()} == brute_classes([(r.doc_id, r.text) for r in docs.collect()])


def test_a_family_of_near_copies_in_blocks(spark, monkeypatch):
    """Members that drift from one another: links exist only between some of them, in buckets larger than a block."""
    monkeypatch.setattr(op7, "BLOCK", 8)
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(140)]
    rows = []
    for i in range(60):
        words = list(base)
        for at in rng.choice(140, 2, replace=False):
            words[at] = f"x{i}-{at}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    truth = brute_classes(rows)
    found = {r.doc_id: r.class_id for r in op7.near_duplicates(docs).collect()}
    agree = np.mean([found[i] == truth[i] for i in found])
    assert agree >= 0.95 and 1 < len(set(truth.values())) < 60
    assert all(truth[found[i]] == truth[i] for i in found)


def test_a_large_class_and_those_that_hang_on_it(spark, monkeypatch):
    """Copies of one text, and copies of these that are like their own model alone: no link is lost where the large class is not compared with itself."""
    monkeypatch.setattr(op7, "BLOCK", 8)
    base = [f"w{i}" for i in range(140)]

    def edited(words, at, name):
        return [f"{name}-{i}" if i in at else w for i, w in enumerate(words)]

    rows = [(0, " ".join(base))]
    for k in range(1, 41):
        near = edited(base, (k, k + 45), f"x{k}")
        rows += [(k, " ".join(near)), (100 + k, " ".join(edited(near, (k + 20, k + 95), f"y{k}")))]
    truth = brute_classes(rows)
    assert set(truth.values()) == {0}
    assert {r.doc_id: r.class_id for r in op7.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == truth


def test_near_duplicates_of_odd_rows(spark, odd):
    rows = op7.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    assert {r.doc_id: r.class_id for r in rows if r.doc_id} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6}
    assert [r.class_id for r in rows if r.doc_id is None] == [3]
    kept = op7.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 2, 3, 4, 5, 6]
    assert op7.near_duplicates(odd.limit(0)).count() == 0


def test_rows_of_one_id_are_one_document(spark):
    rows = [(1, PROSE), (1, PROSE.upper()), (2, PROSE.upper()), (3, "other words that stand alone here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in op7.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3}
    assert sorted(r.doc_id for r in op7.keep_one(docs).collect()) == [1, 3]


def test_a_hub_of_links_is_one_component(spark):
    links = [(500, i) for i in range(500)] + [(i, i + 1) for i in range(1000, 1200)] + [(2000, 2000), (3, 500)]
    found = op7.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r["class"] for r in found} == {i: 0 for i in range(1, 501)} | {i: 1000 for i in range(1001, 1201)}


def test_pipeline_of_odd_rows(spark, odd, tmp_path):
    odd.drop("score").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 1, 0), (None, 0, 1), (2, 0, None)], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    rows = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert {r.doc_id for r in rows} <= {3, 4, 6, None} and len(rows) > 0
    empty = tmp_path / "empty"
    odd.drop("score").limit(0).write.parquet(f"file://{empty}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"file://{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, f"file://{empty}").count() == 0


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "quality", "near_duplicates", "mixing", "encoding"]
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    model = op4.train(docs, labels)
    clean = stages["toxicity"](spark, docs, FOLDER).cache()
    assert ids(clean) == sorted(r.doc_id for r in docs.collect() if model.score(r.text or "") < 0.5)
    good = stages["quality"](spark, clean, FOLDER).cache()
    connection = duckdb.connect()
    connection.register("given", clean.toPandas())
    assert ids(good) == sorted(r[0] for r in connection.execute(f"WITH {op2.verdict_sql('given')} SELECT doc_id FROM judged WHERE kept").fetchall())
    single = stages["near_duplicates"](spark, good, FOLDER).cache()
    assert ids(single) == sorted(set(brute_classes([(r.doc_id, r.text) for r in good.collect()]).values()))
    mixed = stages["mixing"](spark, single, FOLDER).cache()
    taken = brute_mix([(r.doc_id, r.text, r.source) for r in single.collect()])
    assert Counter(ids(mixed)) == Counter({d: n // len(t.split()) for d, n in taken.items() for t in [next(r.text for r in single.collect() if r.doc_id == d)] if n})
    for df in (clean, good, single, mixed):
        assert df.columns == docs.columns
    import public_tokenizers
    import tiktoken

    ranks = op9.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = []
    for r in mixed.collect():
        given = library.encode_ordinary(r.text or "")
        expected.append((r.doc_id, len(given), hashlib.sha256(",".join(map(str, given)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    encoded = corpus_pipeline.run(spark, FOLDER)
    assert sorted(map(tuple, encoded.collect())) == sorted(expected)
