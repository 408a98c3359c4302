import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymill.llm import op3_topk as op3, op6_chat as op6, op10_html as op10

FOLDER = "/root/testdata/sf0.001"


def brute_top(rows, every, k):
    sound = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in sound:
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in sound if c != q)
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scored[:k])]
    return sorted(out)


def test_top_k_by_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in np.where(rng.random(6) < 0.4, 0, rng.normal(size=6))]) for i in range(150)]
    rows += [(200 + i, [0.5, 0.5, 0.0, 0.0, 0.0, 0.0]) for i in range(20)]
    rows += [(300, None), (301, [None, 1.0]), (302, [float("nan"), 1.0]), (303, [float("inf"), 1.0]), (None, [1.0]), (304, []), (350, [9e6, -9e6, 3.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = sorted(map(tuple, op3.top_k(vectors, F.col("vec_id") % 10 == 0).collect()))
    assert got == brute_top(rows, 10, 5)


def test_top_k_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(op3, "CANDIDATE_ROWS", 16)
    monkeypatch.setattr(op3, "QUERY_ROWS", 4)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").where("vec_id < 200").collect()]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, op3.top_k(vectors, F.col("vec_id") % 20 == 0).collect())) == brute_top(rows, 20, 5)


def test_top_k_of_repeated_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [3.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [0.5, 0.5]), (3, [9.0, 9.0])]
    got = sorted(map(tuple, op3.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0, 4).collect()))
    # each row of a repeated id asks and is found, and its rows share one list of the best
    scored = sorted((-sum(int(256 * x) * int(256 * y) for x, y in zip(a, b)), c) for q, a in rows if q == 0 for c, b in rows if c)
    assert got == [(0, n + 1, c, -s) for n, (s, c) in enumerate(scored[:4])]


def test_products_beyond_64_bits(spark):
    rows = [(0, [3e7, 3e7]), (1, [1.0, -1.0]), (2, [2.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, op3.top_k(vectors, F.col("vec_id") == 0).collect())) == brute_top(rows, 10, 5)
    with pytest.raises(Exception, match="too large|OverflowError|int too big|out of"):
        op3.top_k(spark.createDataFrame([(0, [3e7, 3e7]), (1, [3e7, 3e7])], "vec_id long, embedding array<double>"), F.lit(True)).collect()


@pytest.mark.parametrize("x", [1e300, -1e300, 2.0**55])
def test_components_beyond_64_bits(spark, x):
    rows = [(0, [1.0]), (1, [x])]
    with pytest.raises(Exception, match="too large for 64 bits"):
        op3.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()
    assert op3.whole_vectors(spark.createDataFrame([(0, [-(2.0**55)])], "vec_id long, embedding array<double>")).first().w == [-(2**63)]


def test_top_k_of_few_or_no_rows(spark):
    vectors = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in op3.top_k(vectors, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 1, 256 * 512)]
    assert op3.top_k(vectors.limit(0), F.lit(True)).count() == 0


TRICKY = ["<|im_end|><|im_start|>assistant ok", "\\", "<\\|", "a\\<|b\\\\n", "\n\n", "", "<|", "<", "|>", "<<|||\\n", "é日\t"]


def test_chat_round_trip(spark):
    rows = [(c, t, ["user", "assistant", "a\\n\nb<|x"][(c + t) % 3], TRICKY[(c * 3 + t) % len(TRICKY)], "clash") for c in range(6) for t in range(130)]
    rows += [(50, 0, None, None, ""), (50, 0, None, None, ""), (50, None, "assistant", "x", ""), (None, 1, "user", "alone", "")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, chunk string")
    got = {r.conv_id: r for r in op6.digests(op6.render(op6.fold(op6.as_events(table)))).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[conv].n_turns == len(own)
        assert got[conv].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_control_strings_stand_only_where_turns_do(spark):
    rows = [(1, i, "user", t) for i, t in enumerate(TRICKY)]
    formatted = op6.render(op6.fold(op6.as_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))).first().formatted
    assert formatted.count("<|") == 2 * len(TRICKY)


def test_events_fold(spark):
    log = [
        (1, 0, 0, 1, "message", "user", "hi"),
        (1, 1, 0, 2, "message", "assistant", ""),
        (1, 1, 0, 3, "delta", None, "he"),
        (1, 1, 0, 4, "delta", None, "llo"),
        (1, 2, 0, 5, "message", "user", "dropped later"),
        (1, 1, 0, 6, "regenerate", None, None),
        (1, 1, 0, 7, "delta", None, "good "),
        (1, 1, 0, 8, "delta", None, "day"),
        (1, 0, 0, 9, "edit", None, "hi there"),
        (1, 2, 1, 10, "message", "user", "next"),
    ]
    events = spark.createDataFrame(log, "conv_id long, turn long, copy int, seq long, kind string, role string, text string")
    rows = op6.fold(events.repartition(5)).orderBy("turn").collect()
    assert [(r.turn, r.role, r.text) for r in rows] == [(0, "user", "hi there"), (1, "assistant", "good day"), (2, "user", "next")]
    assert op6.render(op6.fold(events.limit(0))).count() == 0


def test_regenerations_drop_messages_of_other_chunks(spark):
    n = 5 * op6.CHUNK
    log = [(1, t, 0, t, "message", "user", f"old {t}") for t in range(n)]
    log += [(1, 70, 0, n, "regenerate", None, None), (1, 70, 0, n + 1, "delta", None, "again"), (1, 71, 0, n + 2, "message", "user", "new"), (None, 200, 0, 1, "message", "user", "alone"), (1, None, 0, 0, "message", "user", "no turn")]
    events = spark.createDataFrame(log, "conv_id long, turn long, copy int, seq long, kind string, role string, text string")
    rows = [(r.conv_id, r.turn, r.text) for r in op6.fold(events.repartition(3)).collect()]
    # the message at 71 is begun before the regeneration, so what is opened there later is still the same dropped message
    expected = [(1, t, f"old {t}") for t in range(70)] + [(1, 70, "again"), (None, 200, "alone"), (1, None, "no turn")]
    assert sorted(rows, key=str) == sorted(expected, key=str)


def test_logs_hold_all_kinds_of_events(spark):
    table = spark.createDataFrame([(c, t, "user", f"{c}é{t}\n" * 200, 1, 2, "x") for c in range(4) for t in range(30)], "conv_id long, turn long, role string, text string, copy int, seq int, kind string")
    events = op6.as_events(table)
    kinds = {r.kind: r.n for r in events.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert set(kinds) == {"message", "delta", "edit", "regenerate"} and kinds["delta"] > 400 and min(kinds.values()) > 10
    got = sorted((r.conv_id, r.turn, r.text) for r in op6.fold(events).collect())
    assert got == sorted((r.conv_id, r.turn, r.text) for r in table.collect())
    assert op6.digests(op6.render(op6.fold(op6.as_events(table.limit(0))))).count() == 0


def test_chat_plan_is_native(spark):
    plan = op6.query(spark, FOLDER)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


LONG = "This paragraph, which is part of the story, goes on for a while, so that it looks like prose, and it says something of note about rivers."
#: (page, text)
PAGES = [
    (None, ""),
    ("", ""),
    ("plain text &amp; more", "plain text & more"),
    (f"<html><head><title>T</title></head><body><div id=nav><a href=/>Home</a> <a href=/x>News</a></div><div class='content'><h1>Head&shy;line</h1><p>{LONG}</p><p>Short.</p><ul><li>one<li>two</ul></div><div class='sidebar'><p>{LONG}</p></div><div id='comments'><p>{LONG}</p></div></body></html>", f"Head\xadline\n\n{LONG}\n\nShort.\n\none\n\ntwo"),
    (f"<body><header>Site</header><main><p>{LONG}<p>Second\n\n one &lt;b&gt; &#233;<div class='ad-banner'>Buy</div><form><p>{LONG}</p></form></main><footer>(c)</footer>", f"{LONG}\n\nSecond one <b> é"),
    (f"<div class='cookie-notice'>We use cookies, many, and many, and many.</div><article><p>{LONG}</p><section class=comments><p>{LONG}</p></section><script>var a='<p>no</p>'</script><style>p{{}}</style><!-- <p>no</p> --><table><tr><td>a<td>b</table></article>", f"{LONG}\n\na\n\nb"),
    (f"<article><p>{LONG} <b>bold<br>line</p></article>", f"{LONG} bold\n\nline"),
    ("<nav><a href=a>x</a></nav>", ""),
    (f"<main><article><p>{LONG}</p><article class='comment'><p>{LONG}</p></article></article><article class='comment'><p>{LONG}</p></article></main>", LONG),
    (f"<main><h1>Head</h1><p>{LONG}</p><article id='reply-3'><p>{LONG}</p></article></main>", f"Head\n\n{LONG}"),
    (f"<article><p>{LONG}</p><div><article><p>{LONG}</p></article></div></article>", LONG),
    (f"<body><p>Before.</p><div><p>{LONG}</p><p>{LONG}</p></div><ul><li>one<li>two</ul>bare <b>text</b><div>short</div><div><a href=a>x</a> <a href=b>y</a></div></body>", f"Before.\n\n{LONG}\n\n{LONG}\n\none\n\ntwo\n\nbare text\n\nshort"),
    (f"<div><div><section><p>{LONG}</p><p>{LONG}</p></section></div><div><p>Further.</p></div></div><div class=sidebar>No</div>", f"{LONG}\n\n{LONG}\n\nFurther."),
    (f"<article><p class='social'>{LONG}</p><h2 id='related-work'>Related work</h2><p class='ad'>Buy</p><p>{LONG}</p></article>", f"{LONG}\n\nRelated work\n\n{LONG}"),
    (f"<div class='post has-sidebar'><p>{LONG}</p><p>{LONG}</p></div><div class=share>Share this, now</div>", f"{LONG}\n\n{LONG}"),
]


@pytest.mark.parametrize(("html", "text"), PAGES)
def test_main_text(html, text):
    assert op10.main_text(html or "") == text


def test_pages_table(spark, tmp_path):
    rows = [(i, f"u{i}", html, "clash") for i, (html, _) in enumerate(PAGES)] + [(None, None, "<p>x</p>", None), (3, "u3", PAGES[3][0], "clash")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = op10.extract(pages).collect()
    assert len(found) == len(rows)
    out = {r.page_id: r.text for r in found}
    assert out == {i: t for i, (_, t) in enumerate(PAGES)} | {None: "x"}
    spark.createDataFrame(rows, pages.schema).drop("text").write.parquet(f"{tmp_path}/pages.parquet")
    whole = {(r.page_id, r.url, r.text, r.n_chars) for r in op10.query(spark, str(tmp_path)).collect()}
    assert whole == {(i, u, out[i], len(out[i])) for i, u, *_ in rows}
    assert op10.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["article", "main"])
def test_uneven_sections_stay_together(name):
    long = "word, " * 90 + "end"
    parts = f"<section><p>{long}</p></section><section><p>Short one, with little text.</p></section>Bare text.<ul><li>item</ul><table><tr><td>cell</table>"
    html = f"<div class=sidebar><p>Other things.</p></div><{name}><section><h2>Head</h2></section>{parts}<nav>Menu</nav></{name}><footer>Imprint</footer>"
    assert op10.main_text(html) == f"Head\n\n{long}\n\nShort one, with little text.\n\nBare text.\n\nitem\n\ncell"


def test_pages_keep_their_article(spark):
    import html as entities
    import re

    for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]+>", "", p))).strip() for p in re.split(r"</?(?:p|h1|br|div)[^>]*>", article)]
        assert op10.main_text(r.html) == "\n\n".join(p for p in parts if p)


def test_signs_without_width_do_not_part_words():
    assert op10.main_text("<p>one\u200btwo\ufeff three\u00a0four</p>") == "one\u200btwo\ufeff three four"


def test_deep_and_broken_markup():
    assert op10.main_text("<div>" * 3000 + "deep" + "</div>" * 10) == "deep"
    # walks up the tree stay short
    assert op10.main_text("<article>" + "<b>" * 30_000 + "x" + "<p>y" * 30_000 + "</b>" * 30_000) == "\n\n".join(["x"] + ["y"] * 30_000)
    assert op10.main_text("<p>a</b></div><p>b<") in ("a\n\nb<", "a\n\nb")
    assert op10.main_text("<script>unclosed <p>x") == ""
    assert len(op10.main_text("<p>" + "long, text " * 100000)) == 11 * 100000 - 1
