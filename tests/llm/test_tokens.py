import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st

from tallymill.llm import op1_token_files as op1, op8_token_counts as op8, op9_bpe as op9
from tallymill.llm.common import new_path

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Null, empty and very long texts, odd white space, special strings, rows that repeat.
TEXTS = ["Hello, world!", "", None, "  a  b\n\n c\t\x0b\x0cd\r\n", "It's  I'll 'sx ’s DON'T", "naïve ÀÉÎ straße", "日本語 テスト 123 4567", "<|endoftext|> \\", "x" * 5000, "word " * 3000, "a\x1cb\xa0c d", "Hello, world!"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", 1) for i, t in enumerate(TEXTS)] + [(None, "no id", "clash", 1), (3, "same id again", "clash", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, start int")


def test_files_hold_the_ids_of_the_library(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    path = new_path(spark, "test")
    op1.write_token_files(docs, path, WORDS)
    rows = op1.read_token_files(spark, path).collect()
    expected = sorted([(-1 if r.doc_id is None else r.doc_id, [*library.encode(r.text or "", add_special_tokens=False).ids, 2]) for r in docs.collect()])
    assert sorted((-1 if r.doc_id is None else r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in rows) == expected
    assert all(r.n_tokens == len(r.ids) // 4 for r in rows)
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [-1 if r.doc_id is None else r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert ids == sorted(ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>", "abc", "Éa.", " ", "\n", "'s", "9"]), max_size=12).map("".join), st.booleans())
def test_special_strings_are_the_librarys_matter(text, special_as_text):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    library.encode_special_tokens = special_as_text
    assert np.frombuffer(op1.encode_texts([text], WORDS, special_as_text)[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.characters(max_codepoint=255), st.sampled_from(["'", "'s", "'RE", "###", "Wort", "\u0301", "<|endoftext|>"])), max_size=40).map("".join))
def test_latin_texts_are_cut_as_the_library_does(text):
    library = op1._encoder(WORDS, False).tokenizer
    assert np.frombuffer(op1.encode_texts([text], WORDS)[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_marks_behind_words_pass_the_librarys_chain_once(monkeypatch):
    words, calls = op1._Words(WORDS), []
    monkeypatch.setitem(op1._encoders, (WORDS, False), words)
    chain = words.chain
    monkeypatch.setattr(words, "chain", lambda w: calls.append(w) or chain(w))
    op1.encode_texts([" ".join(f"{a}{b}{mark}" for a in "abcde" for b in "VWXYZ" for mark in ("###", ".%%%", "&&&"))], WORDS)
    assert sorted(calls) == ["###", "&&&", ".%%%"]


def test_recent_strings_stay_and_others_are_found_again():
    calls = []
    memo = op1.Recent(lambda k: calls.append(k) or k.encode(), most=3)
    assert b"".join(map(memo.__getitem__, "aabacadaeafaga")) == b"aabacadaeafaga" and calls == list("abcdefg")
    assert len(memo) + len(memo.older) <= 6
    assert memo["b"] == b"b" and calls[-1] == "b"


def test_another_tokenizer_is_not_taken_apart():
    from tokenizers import Tokenizer

    other = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(other)
    for got, text in zip(op1.encode_texts([t or "" for t in TEXTS], other), TEXTS, strict=True):
        assert np.frombuffer(got, "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids


def test_one_document_is_read_alone(spark, docs):
    path = new_path(spark, "test")
    op1.write_token_files(docs, path, WORDS)
    assert [r.doc_id for r in op1.read_token_files(spark, path, 5, 5).collect()] == [5]


def test_no_documents_give_an_empty_file_set(spark, docs):
    path = new_path(spark, "test")
    op1.write_token_files(docs.limit(0), path, WORDS)
    assert op1.read_token_files(spark, path).count() == 0


def test_query_over_the_smallest_table(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    rows = op1.query(spark, "/root/testdata/sf0.001").orderBy("doc_id").collect()
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()]
    at = 0
    for row, text in zip(rows, texts, strict=True):
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        assert (row.start, row.n_tokens, row.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=op9.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return op9.Coder(RANKS, public_tokenizers.PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(list("abcdeé ÀÖ.,'!?\n\t 19日")), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_encoding_equals_the_library(coder, tiktoken_encoding, text):
    assert np.frombuffer(coder.encode([text])[0], np.int32).tolist() == tiktoken_encoding.encode_ordinary(text)


@pytest.mark.parametrize("pattern", [r"\p{L}+|[^\p{L}]", r" ?\S+|\s+"])
def test_another_pattern_is_cut_by_itself(pattern):
    import tiktoken

    library = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=op9.read_ranks(RANKS), special_tokens={})
    texts = [t or "" for t in TEXTS]
    for got, text in zip(op9.Coder(RANKS, pattern).encode(texts), texts, strict=True):
        assert np.frombuffer(got, np.int32).tolist() == library.encode_ordinary(text)


def test_digests_of_the_whole_query(spark, tiktoken_encoding):
    import hashlib

    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op9.query(spark, "/root/testdata/sf0.001").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        ids = tiktoken_encoding.encode_ordinary(r.text or "")
        assert got.pop(r.doc_id) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    assert not got


def test_round_trip_and_odd_rows(spark, docs, tiktoken_encoding):
    rows = op9.decode(op9.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS).collect()
    assert len(rows) == docs.count()
    by_text = sorted((list(r.ids), bytes(r.decoded)) for r in rows)
    assert by_text == sorted((tiktoken_encoding.encode_ordinary(r.text or ""), (r.text or "").encode()) for r in docs.collect())
    assert sorted((list(r.ids), bytes(r.decoded)) for r in op9.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect()) == by_text
    assert op9.digest(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_unknown_ids_are_an_error_and_null_lists_are_null(spark):
    lists = spark.createDataFrame([(1, None), (2, [5])], "doc_id long, ids array<int>")
    assert [r.decoded is None for r in op9.decode(lists, RANKS).orderBy("doc_id").collect()] == [True, False]
    with pytest.raises(Exception, match="vocabulary|out of bounds"):
        op9.decode(spark.createDataFrame([(1, [50256])], "doc_id long, ids array<int>"), RANKS).collect()


def test_perfect_hash_is_minimal_and_knows_strangers():
    keys = [f"k{i}".encode() for i in range(2000)]
    table = op9.PerfectHash(keys, list(range(2000)))
    assert table.find(keys) == list(range(2000))
    assert sorted(table.keys) == sorted(keys)
    assert table.find([b"other", b""]) == [-1, -1]
    assert op9.PerfectHash([], []).find([b"a"]) == [-1]


def test_memo_keeps_common_words_and_finds_dropped_ones_again():
    from tallymill.llm.memo import Memo

    memo = Memo(lambda keys: [k.encode() for k in keys], 10)
    for i in range(0, 40, 4):
        memo.learn({f"{j}" for j in range(i, i + 4)} | {"0"})
        assert memo.join(["0", f"{i + 3}"]) == b"0" + str(i + 3).encode()
    assert len(memo) <= 14


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 6), max_size=20), st.lists(st.integers(1, 9), max_size=8))
def test_attribution_by_brute_force(sizes, lines):
    total = sum(sizes)
    bounds = [0]
    for n in lines:
        if bounds[-1] + n < total:
            bounds.append(bounds[-1] + n)
    bounds = np.array([*bounds, total])
    if not total:
        return
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    most, start, share = np.zeros(len(bounds) - 1), np.zeros(len(bounds) - 1), np.zeros(len(bounds) - 1)
    at = 0
    for n in sizes:
        held = np.bincount(owner[at : at + n], minlength=len(bounds) - 1)
        most[held.argmax()] += 1
        start[owner[at]] += 1
        share += held / n
        at += n
    got = op8.attribute(np.cumsum(sizes), bounds)
    assert got[0].tolist() == most.tolist()
    assert got[1].tolist() == start.tolist()
    assert np.allclose(got[2], share)


def test_sections_tile_texts(spark, docs):
    everything = op8.count_sections(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert op8.count_sections(docs.limit(0), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0
    rows = everything.collect()
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=op9.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    # the row without an id, and the two rows of one id
    assert [r.char_end for r in rows if r.doc_id is None] == [len("no id")]
    assert sum(r.n_tokens for r in rows if r.doc_id == 3) == len(library.encode_ordinary(TEXTS[3])) + len(library.encode_ordinary("same id again"))
    for doc, text in enumerate(TEXTS):
        if doc == 3:
            continue
        own = sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.section)
        text = text or ""
        assert "".join(text[r.char_start : r.char_end] for r in own) == text
        n = len(library.encode_ordinary(text))
        assert sum(r.n_tokens for r in own) == sum(r.n_started for r in own) == n
        assert abs(sum(r.token_share for r in own) - n) < 1e-6
        assert len(own) == max(1, len(text.splitlines()) if "\n" in text else 1)


def test_runs_of_white_space_that_stop_the_library(spark):
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    text = "ab\n" + " " * 1_100_000 + "\ncd"
    rows = op8.count_sections(spark.createDataFrame([(1, text)], "doc_id long, text string"), ranks, pattern).orderBy("section").collect()
    assert [(r.char_start, r.char_end) for r in rows] == [(0, 3), (3, 1_100_004), (1_100_004, 1_100_006)]
    ids = op8.encoded(text, ranks, pattern)
    token = {rank: token for token, rank in op9.read_ranks(ranks).items()}
    assert b"".join(map(token.__getitem__, ids.tolist())) == text.encode()
    assert sum(r.n_tokens for r in rows) == len(ids)


def test_section_counts_of_the_whole_query(spark):
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=op9.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    rows = {}
    for r in op8.query(spark, "/root/testdata/sf0.001").collect():
        rows.setdefault(r.doc_id, {})[r.section] = (r.n_tokens, r.n_started)
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        raw, at = (r.text or "").encode(), 0
        owner = np.cumsum([0, *(np.frombuffer(raw, np.uint8)[:-1] == 10)]) if raw else np.zeros(0, np.int64)
        expected = {s: [0, 0] for s in range(int(owner.max(initial=0)) + 1)}
        for token in library.encode_ordinary(r.text or ""):
            held = Counter(owner[at : at + len(library.decode_single_token_bytes(token))].tolist())
            expected[max(sorted(held), key=held.__getitem__)][0] += 1
            expected[int(owner[at])][1] += 1
            at += sum(held.values())
        assert rows[r.doc_id] == {s: tuple(n) for s, n in expected.items()}
