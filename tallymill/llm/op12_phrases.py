"""Phrase collocations by best-first growth of prefixes with bounds on their scores.

1. Words are counted by language. A word is known by a 64-bit hash of its bytes and its language; a second hash is counted along, and should
   two words ever share the first one, all is counted again with another seed. So hashes name words exactly.
2. Prefixes of two words are counted where both words are frequent enough. The count of a prefix bounds all that grows from it: a phrase
   x y z scores at most f(x y) / f(x), since its own count is at most f(x y) and the count of y z at least its own; by the same argument
   from the other end, at most f(y z) / f(z).
3. The frontier is expanded in waves, the highest bounds first: a wave counts the phrases of three words that may reach its least score, and
   those that hold a pair which reaches it, for these decide whether the pair survives. All phrases of the least score or more are then
   known exactly. A language with TOP survivors among them is settled, ties included; for the others the next wave goes deeper, to the end if
   need be. Least scores come from the language's own pairs.

Which words and pairs matter in a pass over the texts is told by filters of a fixed size (one hash, flags at its place). What they let
through in error is counted like the rest and leaves when counts are joined exactly, so they only save work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tallymill.llm.common import discard, stash, table

TOP, LEAST_COUNT, INSIDE_PERCENT, SCALE = 2000, 10, 50, 1_000_000
NO_LANG = "und"
#: Each wave goes down to the score of the language's pair at a rank so many times as far.
DEEPER = 8
#: Languages that are broadcast.
MOST_LANGS = 10_000
#: Places of a filter as a power of two: 32 MB.
FILTER_BITS = 25
#: Bytes of text that are cut into words at a time (more if one word is longer), and words that are counted at a time.
PIECE, COUNTED = 1 << 20, 1_500_000

#: Only A-Z change; blanks part words, a line feed stands for all signs that part pieces.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@lru_cache(4)
def _powers(seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each byte, and the powers of an odd base and of its inverse, for hashes of stretches from running sums."""
    values = _mix(np.arange(1, 257, dtype=np.uint64) + np.uint64(seed * 1000))
    base = int(_mix(np.array([seed + 77], np.uint64))[0]) | 1
    grow = lambda b: np.multiply.accumulate(np.array([1, *[b] * (PIECE - 1)], np.uint64))
    return values, grow(base), grow(pow(base, -1, 1 << 64))


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of stretches of bytes."""
    out = np.zeros(len(starts), np.uint64)
    # stretches that begin within one block of bytes are hashed from its running sums
    at = 0
    while at < len(starts):
        low = int(starts[at])
        upto = int(np.searchsorted(ends, low + PIECE, "right"))
        if upto == at:  # one word longer than a block
            from xxhash import xxh3_64_intdigest

            out[at] = xxh3_64_intdigest(data[low : int(ends[at])].tobytes(), seed)
            at += 1
            continue
        values, power, inverse = _powers(seed)
        block = data[low : int(ends[upto - 1])]
        sums = np.zeros(len(block) + 1, np.uint64)
        np.cumsum(values[block] * power[: len(block)], out=sums[1:])
        s, e = starts[at:upto] - low, ends[at:upto] - low
        out[at:upto] = (sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64)
        at = upto
    return _mix(out)


class Words:
    """The words of some texts: hashes, pieces and places."""

    __slots__ = ("check", "data", "ends", "hash", "of_lang", "piece", "starts")


def words_of(texts: list[bytes | None], langs: list[str | None], seed: int, check: bool = False) -> Words:
    """Words of texts in order. No piece goes beyond a text, and the hash of a word has its language in it."""
    out = Words()
    joined = b"\n".join(t or b"" for t in texts).translate(_FOLD)
    out.data = data = np.frombuffer(joined, np.uint8)
    blank = (data == 32) | (data == 10)
    edges = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).view(np.int8)))
    out.starts, out.ends = edges[0::2], edges[1::2]
    breaks = np.flatnonzero(data == 10)
    out.piece = np.searchsorted(breaks, out.starts)
    own = {x: _lang_hash(x, seed) for x in set(langs)}
    of_text = np.array([own[x] for x in langs], np.uint64)
    out.of_lang = of_text[np.searchsorted(np.cumsum([len(t or b"") + 1 for t in texts]), out.starts, "right")]
    out.hash = _mix(_hashes(data, out.starts, out.ends, seed) ^ out.of_lang)
    out.check = _mix(_hashes(data, out.starts, out.ends, seed + 1) + out.of_lang) >> np.uint64(32) if check else None
    return out


def _parts(text: bytes) -> Iterator[bytes]:
    """A text, or stretches of about PIECE bytes of a longer one, parted where its pieces are."""
    if len(text) <= PIECE:
        yield text
        return
    folded, at = text.translate(_FOLD), 0
    while at < len(folded):
        end = folded.rfind(b"\n", at, at + PIECE)
        end = end if end > at else folded.find(b"\n", at + PIECE)
        end = len(folded) if end < 0 or len(folded) - at <= PIECE else end
        yield folded[at:end]
        at = end


def _in_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """Texts and their languages, about PIECE bytes at a time."""
    texts, langs, size = [], [], 0
    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for part in _parts(text) if text else ():
                texts.append(part)
                langs.append(lang)
                size += len(part)
                if size >= PIECE:
                    yield texts, langs
                    texts, langs, size = [], [], 0
    if texts:
        yield texts, langs


_signed = lambda x: pa.array(x.view(np.int64))


def count_words(texts: DataFrame, seed: int) -> DataFrame:
    """(h, check, lang_h, n): how often each task meets a word of a language; check is half of its second hash, lang_h the hash of its language."""
    names = ["h", "check", "lang_h", "n"]
    most = COUNTED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, held = [], 0

        def grouped(h: np.ndarray, c: np.ndarray, lang: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
            order = np.lexsort((c, h))
            first = np.flatnonzero(np.concatenate([[True], (np.diff(h[order]) != 0) | (np.diff(c[order]) != 0)]))
            at = order[first]
            return h[at], c[at], lang[at], np.add.reduceat(n[order], first)

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(list(map(_signed, grouped(*(np.concatenate(x) for x in zip(*numbers, strict=True))))), names)

        for given, of in _in_pieces(batches):
            w = words_of(given, of, seed, check=True)
            if not len(w.hash):
                continue
            numbers.append(grouped(w.hash, w.check, w.of_lang, np.ones(len(w.hash), np.int64)))
            held += len(numbers[-1][0])
            if held >= most:
                yield packed()
                numbers, held = [], 0
        if held:
            yield packed()

    return texts.mapInArrow(run, "h long, check long, lang_h long, n long")


def spell(texts: DataFrame, seed: int, used: DataFrame) -> DataFrame:
    """(h, word) of the hashes in used (h): one more pass over the texts, from which only these words come."""
    flags = used.sparkSession.sparkContext.broadcast(make_filter(used.select("h", F.lit(1).alias("flag")), ["h"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given, of in _in_pieces(batches):
            w = words_of(given, of, seed)
            some = np.flatnonzero(flags.value[_place(w.hash, len(flags.value))])
            h, at = np.unique(w.hash[some], return_index=True)
            at = some[at]
            raw = w.data.tobytes()
            words = pa.array([raw[s:e] for s, e in zip(w.starts[at].tolist(), w.ends[at].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([_signed(h), words.cast(pa.string())], ["h", "word"])

    return texts.mapInArrow(run, "h long, word string").groupBy("h").agg(F.first("word").alias("word")).join(used, "h", "left_semi")


def _lang_hash(lang: str | None, seed: int) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest((NO_LANG if lang is None else lang).encode(), seed)


def languages(texts: DataFrame, seed: int) -> DataFrame:
    """(lang_h, lang) of the languages, which are few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([_signed(np.array([_lang_hash(x, seed) for x in batch.column(0).to_pylist()], np.uint64)), batch.column(0)], ["lang_h", "lang"])

    return texts.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang")).distinct().mapInArrow(run, "lang_h long, lang string")


def _counted(texts: DataFrame, seed: int, size: int, shared: Callable, keep: Callable[[Words, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(h1 .. hk, n): how often each task meets a phrase of ``size`` words in one piece, of those that keep(filter, places) names."""
    names = [*[f"h{i + 1}" for i in range(size)], "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[np.ndarray]] = [[] for _ in range(size)]
        flags, held = shared(), 0

        def packed() -> pa.RecordBatch:
            columns = [np.concatenate(k) for k in kept]
            for k in kept:
                k.clear()
            names_, ids = np.unique(np.concatenate(columns), return_inverse=True)
            parts = np.split(ids.astype(np.int64), size)
            code = parts[0] << 32 | parts[1]
            if size == 3:
                pairs, code = np.unique(code, return_inverse=True)
                code = code.astype(np.int64) << 32 | parts[2]
            codes, n = np.unique(code, return_counts=True)
            last = codes & 0xFFFFFFFF
            head = pairs[codes >> 32] if size == 3 else codes
            ends = [head >> 32, head & 0xFFFFFFFF, last] if size == 3 else [head >> 32, last]
            return pa.RecordBatch.from_arrays([*[_signed(names_[e]) for e in ends], pa.array(n.astype(np.int64))], names)

        for given, of in _in_pieces(batches):
            w = words_of(given, of, seed)
            at = keep(w, flags)
            for i in range(size):
                kept[i].append(w.hash[at + i])
            held += len(at)
            if held >= COUNTED:
                yield packed()
                held = 0
        if held:
            yield packed()

    rows = texts.mapInArrow(run, ", ".join(f"{c} long" for c in names))
    return rows.groupBy(*names[:-1]).agg(F.sum("n").alias("a")).where(F.col("a") >= LEAST_COUNT)


def _place(h: np.ndarray, places: int) -> np.ndarray:
    return (_mix(h) & np.uint64(places - 1)).astype(np.int64)


def _pair(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return h1 * np.uint64(0x9E3779B97F4A7C15) + (h2 ^ (h2 >> np.uint64(29)))


def make_filter(rows: DataFrame, columns: list[str]) -> np.ndarray:
    """Flags at the places of (hash columns, flag byte): chunks are put together by Spark, so the driver gets 2 ** FILTER_BITS bytes at most."""
    chunk, size = 12, 1 << FILTER_BITS

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = [c.to_numpy().view(np.uint64) for c in batch.columns[:-1]]
            at = _place(h[0] if len(h) == 1 else _pair(*h), size)
            yield pa.RecordBatch.from_arrays([pa.array(at >> chunk), pa.array(at & (1 << chunk) - 1), batch.column(len(h)).cast(pa.int64())], ["chunk", "at", "flag"])

    def put(rows_: pa.Table) -> pa.Table:
        out = np.zeros(1 << chunk, np.uint8)
        np.bitwise_or.at(out, rows_["at"].to_numpy(), rows_["flag"].to_numpy().astype(np.uint8))
        return pa.table({"chunk": rows_["chunk"].slice(0, 1), "flags": pa.array([out.tobytes()], pa.binary())})

    flags = np.zeros(size, np.uint8)
    placed = rows.select(*columns, "flag").mapInArrow(places, "chunk long, at long, flag long")
    for r in placed.groupBy("chunk").applyInArrow(put, "chunk long, flags binary").toLocalIterator():
        flags[r.chunk << chunk : (r.chunk + 1) << chunk] = np.frombuffer(r.flags, np.uint8)
    return flags


#: Flags of pairs: frequent enough; a prefix to grow; the end of one that grows; a pair whose survival is open.
FREQUENT, PREFIX, SUFFIX, OPEN = 1, 2, 4, 8


def keep_pairs(w: Words, flags: np.ndarray) -> np.ndarray:
    """Places of pairs of words, in one piece, that may both be frequent."""
    good = flags[_place(w.hash, len(flags))] > 0
    return np.flatnonzero(good[:-1] & good[1:] & (w.piece[:-1] == w.piece[1:]))


def keep_triples(w: Words, flags: np.ndarray) -> np.ndarray:
    """Places of three words that a wave counts."""
    pairs = np.where(w.piece[:-1] == w.piece[1:], flags[_place(_pair(w.hash[:-1], w.hash[1:]), len(flags))], 0).astype(np.uint8)
    left, right = pairs[:-1], pairs[1:]
    grows = (left & PREFIX > 0) & (right & SUFFIX > 0)
    return np.flatnonzero((left & FREQUENT > 0) & (right & FREQUENT > 0) & (grows | ((left | right) & OPEN > 0)))


def score_of(a: Column, left: Column, right: Column) -> Column:
    """floor(SCALE * a * a / (left * right)), exactly."""
    wide = lambda c: c.cast("decimal(18,0)")
    return F.call_function("div", wide(a) * wide(a) * F.lit(SCALE).cast("decimal(7,0)"), wide(left) * wide(right))


def word_counts(texts: DataFrame) -> tuple[DataFrame, int]:
    """(h, lang_h, f) of every word of every language, and the seed by which no two words have one hash."""
    seed = 1
    while True:
        sums = count_words(texts, seed).groupBy("h").agg(F.min("lang_h").alias("lang_h"), F.sum("n").alias("f"), F.min("check").alias("c1"), F.max("check").alias("c2"))
        words = stash(sums, "words")
        if words.where("c1 <> c2").isEmpty():
            return words.select("h", "lang_h", "f"), seed
        discard(words)
        seed += 1


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of two or three words.

    docs: (text, lang). Null texts count as empty; a null language as ``und``. Repeated rows count each. A language without a phrase that is
    frequent enough has no rows; an empty table gives none. Other columns are not looked at.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("text").cast("binary").alias("text"), "lang")
    words, seed = word_counts(texts)
    named = stash(languages(texts, seed), "languages")  # Spark knows the size of a table and broadcasts a small one
    sizes = words.groupBy("lang_h").agg(F.sum("f").alias("n")).join(named, "lang_h").select("lang", "n")
    frequent = words.where(F.col("f") >= LEAST_COUNT)
    known = spark.sparkContext.broadcast(make_filter(frequent.select("h", F.lit(1).alias("flag")), ["h"]))
    first, second = frequent.select(F.col("h").alias("h1"), "lang_h", F.col("f").alias("f1")), frequent.select(F.col("h").alias("h2"), F.col("f").alias("f2"))
    pairs = _counted(texts, seed, 2, lambda: known.value, keep_pairs).join(first, "h1").join(second, "h2").join(named, "lang_h").drop("lang_h")
    pairs = stash(pairs.withColumn("score", score_of(F.col("a"), F.col("f1"), F.col("f2"))), "pairs")
    # pairs of a language by score, so that least scores can be read off
    steps = pairs.groupBy("lang", "score").agg(F.count("*").alias("c"))
    steps = stash(steps.select("lang", "score", F.sum("c").over(Window.partitionBy("lang").orderBy(F.desc("score"))).alias("upto")), "steps")
    open_ = pairs.select("lang").distinct()
    reach, out = top, None
    while True:
        # of the scores down to which a language has at least ``reach`` pairs the highest, or all
        least = open_.join(steps.where(F.col("upto") >= reach).groupBy("lang").agg(F.max("score").alias("least")), "lang", "left").select("lang", F.coalesce("least", F.lit(0)).alias("least"))
        least = stash(least, "least")
        survivors = _wave(texts, seed, pairs, least)
        enough = survivors.groupBy("lang").agg(F.count("*").alias("c")).where(F.col("c") >= top)
        settled = least.where("least = 0").select("lang").unionByName(enough.select("lang")).distinct()
        part = stash(survivors.join(settled, "lang", "left_semi"), "settled")
        out = part if out is None else out.unionByName(part)
        before, open_ = open_, stash(least.select("lang").join(settled, "lang", "left_anti"), "open")
        discard(survivors, least, *([before] if reach > top else []))
        if open_.isEmpty():
            break
        reach *= DEEPER
    discard(pairs, steps, open_)
    used = out.select(F.explode(F.array("h1", "h2", "h3")).alias("h")).where("h is not null").distinct()
    spelling = stash(spell(texts, seed, stash(used, "used")), "spelling")
    spelt = out
    for i in (1, 2, 3):
        spelt = spelt.join(spelling.select(F.col("h").alias(f"h{i}"), F.col("word").alias(f"w{i}")), f"h{i}", "left")
    spelt = spelt.withColumn("phrase", F.concat_ws(" ", "w1", "w2", "w3"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = spelt.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _wave(texts: DataFrame, seed: int, pairs: DataFrame, least: DataFrame) -> DataFrame:
    """(lang, h1, h2, h3, a, l, r, score): the surviving phrases of these languages with their least score or more."""
    spark = texts.sparkSession
    own = pairs.join(least, "lang")
    bound = lambda f: score_of(F.col("a"), F.col("a"), F.col(f)) >= F.col("least")
    flag = F.lit(FREQUENT) + F.when(bound("f1"), PREFIX).otherwise(0) + F.when(bound("f2"), SUFFIX).otherwise(0) + F.when(F.col("score") >= F.col("least"), OPEN).otherwise(0)
    flags = spark.sparkContext.broadcast(make_filter(own.select("h1", "h2", flag.alias("flag")), ["h1", "h2"]))
    # texts of settled languages needn't be read again; should there be very many languages, they are
    few = least.select(F.col("lang").alias("_lang")).limit(MOST_LANGS + 1)
    some = texts.join(F.broadcast(few), F.coalesce("lang", F.lit(NO_LANG)) == F.col("_lang"), "left_semi") if few.count() <= MOST_LANGS else texts
    triples = stash(_counted(some, seed, 3, lambda: flags.value, keep_triples), "triples")
    first = own.select("h1", "h2", F.col("a").alias("f12"), "f1", "lang", "least")
    second = pairs.select(F.col("h1").alias("h2"), F.col("h2").alias("h3"), F.col("a").alias("f23"), F.col("f2").alias("f3"))
    scored = triples.join(first, ["h1", "h2"]).join(second, ["h2", "h3"])
    cut = lambda k, l, r: F.struct(score_of(F.col("a"), F.col(l), F.col(r)).alias("score"), F.lit(k).alias("k"), F.col(l).alias("l"), F.col(r).alias("r"))
    best = F.least(cut(1, "f1", "f23"), cut(2, "f12", "f3")).alias("cut")
    three = scored.select("lang", "h1", "h2", "h3", "a", "least", best).where("cut.score >= least").select("lang", "h1", "h2", "h3", "a", "cut.l", "cut.r", "cut.score")
    # the most frequent longer phrase that a pair begins or ends
    around = triples.select("h1", "h2", "a").unionByName(triples.select(F.col("h2").alias("h1"), F.col("h3").alias("h2"), "a"))
    longest = around.groupBy("h1", "h2").agg(F.max("a").alias("most"))
    two = own.where("score >= least").join(longest, ["h1", "h2"], "left").where((100 * F.coalesce("most", F.lit(0)) < INSIDE_PERCENT * F.col("a")))
    two = two.select("lang", "h1", "h2", F.lit(None).cast("long").alias("h3"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), "score")
    out = stash(two.unionByName(three), "survivors")
    discard(triples)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = f"""WITH pieces AS (SELECT row_number() OVER () AS piece, lang, p FROM (SELECT coalesce(lang, '{NO_LANG}') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents)),
w AS (SELECT piece, lang, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM (SELECT piece, lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS ws FROM pieces)),
g AS (SELECT lang, x, lead(x, 1) OVER p AS y, lead(x, 2) OVER p AS z FROM w WINDOW p AS (PARTITION BY piece ORDER BY i)),
one AS (SELECT lang, x, count(*)::HUGEINT AS a FROM g GROUP BY lang, x), n AS (SELECT lang, sum(a) AS n FROM one GROUP BY lang),
two AS (SELECT lang, x, y, count(*)::HUGEINT AS a FROM g WHERE y IS NOT NULL GROUP BY lang, x, y), three AS (SELECT lang, x, y, z, count(*)::HUGEINT AS a FROM g WHERE z IS NOT NULL GROUP BY lang, x, y, z HAVING count(*) >= {LEAST_COUNT}),
cuts AS (SELECT t.lang, t.x, t.y, NULL AS z, t.a, p.a AS l, q.a AS r, 1 AS k FROM two t JOIN one p ON p.lang = t.lang AND p.x = t.x JOIN one q ON q.lang = t.lang AND q.x = t.y WHERE t.a >= {LEAST_COUNT}
  UNION ALL SELECT t.lang, t.x, t.y, t.z, t.a, p.a, q.a, 1 FROM three t JOIN one p ON p.lang = t.lang AND p.x = t.x JOIN two q ON q.lang = t.lang AND q.x = t.y AND q.y = t.z
  UNION ALL SELECT t.lang, t.x, t.y, t.z, t.a, p.a, q.a, 2 FROM three t JOIN two p ON p.lang = t.lang AND p.x = t.x AND p.y = t.y JOIN one q ON q.lang = t.lang AND q.x = t.z),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, x, y, z ORDER BY score, k) AS i FROM (SELECT *, {SCALE} * a * a // (l * r) AS score FROM cuts)) WHERE i = 1),
most AS (SELECT lang, x, y, max(a) AS m FROM (SELECT lang, x, y, a FROM three UNION ALL SELECT lang, y, z, a FROM three) GROUP BY lang, x, y),
kept AS (SELECT b.lang, concat_ws(' ', b.x, b.y, b.z) AS phrase, a, l, r, score FROM best b LEFT JOIN most m ON m.lang = b.lang AND m.x = b.x AND m.y = b.y AND b.z IS NULL WHERE m.m IS NULL OR 100 * m.m < {INSIDE_PERCENT} * b.a)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN n USING (lang) WHERE rank <= {TOP}"""
