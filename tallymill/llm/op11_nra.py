"""Ranked lexical search by NRA: impact-sorted lists are read in order, and every document has a lower and an upper bound on its score.

1. The terms of the items are looked up in whole texts. A document becomes a row of its length and the numbers and frequencies of these
   terms; from these rows follow the counts of the corpus, and from those the impact of every posting.
2. Documents are parted into shards of about SHARD, as they lie in their files: nothing is shuffled. A shard has a list of postings for
   each term, the highest impact first.
3. For an item the lists of its terms are read from the top, each a stretch at a time. What a document has been seen with is its lower
   bound; the lists in which it hasn't been seen add at most what stands at their reading places, which gives its upper bound. An item is
   done when no document outside, seen or not, can reach the k-th best lower bound, and the bounds of all that can are equal: so members,
   ties and scores are final. Only lists that an undecided document hasn't been seen in are read on.
4. The k-th best score so far goes from shard to shard within a task, so later shards stop sooner. The k best of each task are merged.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tallymill.llm.common import sliced, stash, table

TOP = 20
#: Documents of a shard, or fewer if they hold so many postings.
SHARD, SHARD_POSTINGS = 8192, 4_000_000
#: Postings of a list that are read first; each further stretch is STRIDE times as long.
FIRST, STRIDE = 128, 4
#: Terms of the items that a pass over the documents looks for; items with more terms in all are dealt to several passes.
MOST_TERMS = 1_000_000

#: Letters, digits and whatever lies beyond ASCII make terms; only A-Z change.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

_ROWS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.binary()), ("tfs", pa.binary())])


def terms_of(raw: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text in order; null has none."""
    return raw.translate(_FOLD).split() if raw else []


def item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, terms, counts): the different items, numbered, with their terms and how often they stand there."""
    schema = pa.schema([("item", pa.int64()), ("item_id", pa.int64()), ("terms", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            counts = [Counter(terms_of(t)) for t in batch.column(1).to_pylist()]
            columns = [range(number, number + len(counts)), batch.column(0), [list(c) for c in counts], [list(c.values()) for c in counts]]
            number += len(counts)
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).distinct()
    return rows.mapInArrow(run, "item long, item_id long, terms array<binary>, counts array<long>")


def look_up(docs: DataFrame, vocabulary) -> DataFrame:
    """(doc_id, n, terms, tfs) of each row: its number of terms, and numbers and frequencies of those of the vocabulary (a broadcast dict) as packed 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in sliced(batches, 500):
            n, terms, tfs = [], [], []
            for raw in batch.column(1).to_pylist():
                words = terms_of(raw)
                found = Counter(filter(known.__contains__, words))
                n.append(len(words))
                terms.append(np.fromiter(map(known.__getitem__, found), "<i4", len(found)).tobytes())
                tfs.append(np.fromiter(found.values(), "<i4", len(found)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(terms, pa.binary()), pa.array(tfs, pa.binary())], schema=_ROWS)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, n long, terms binary, tfs binary")


def document_frequencies(rows: DataFrame, n_terms: int) -> np.ndarray:
    """How many documents hold each term: one partial count for each task, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(n_terms, np.int64)
        for batch in batches:
            counts += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4"), minlength=n_terms)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used], pa.int64())], ["term", "df"])

    out = np.zeros(n_terms, np.int64)
    for r in rows.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r.term] = r.df
    return out


def nra(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores): all of the documents 0 to n_docs - 1 whose sum over the lists is among the k highest and at least floor, ties included, with their sums.

    A list holds a document once at most, and its values, all above 0, descend.
    """
    lower = np.zeros(n_docs, np.int64)
    depth, step = [0] * len(lists), [FIRST] * len(lists)
    front = np.array([int(v[0]) for _, v in lists], np.int64)
    wanted = range(len(lists))
    while True:
        for j in wanted:
            docs, values = lists[j]
            d = depth[j] = min(len(docs), (at := depth[j]) + step[j])
            step[j] *= STRIDE
            lower[docs[at:d]] += values[at:d]
            front[j] = values[d] if d < len(docs) else 0
        ahead = int(front.sum())
        least = max(floor, int(np.partition(lower, n_docs - k)[n_docs - k]) if n_docs > k else 0, 1)
        open_ = np.flatnonzero(front).tolist()
        if ahead >= least:  # a document that no list has shown yet may get in
            wanted = open_
            continue
        upper = lower + ahead
        for j in open_:
            upper[lists[j][0][: depth[j]]] -= front[j]
        can = (lower > 0) & (upper >= least)
        undecided = can & (upper > lower)
        n = int(undecided.sum())
        if not n:
            docs = np.flatnonzero(can)
            return docs, lower[docs]
        wanted = [j for j in open_ if int(undecided[lists[j][0][: depth[j]]].sum()) < n]


def _shards(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_ids, lengths, document of each posting, its term, its frequency) of some thousand documents at a time."""
    ids, lengths, sizes, terms, tfs, held = [], [], [], [], [], 0

    def shard():
        where = np.repeat(np.arange(len(ids)), np.array(sizes, np.int64) // 4)
        out = np.array(ids, np.int64), np.array(lengths, np.int64), where, np.frombuffer(b"".join(terms), "<i4"), np.frombuffer(b"".join(tfs), "<i4").astype(np.int64)
        for x in (ids, lengths, sizes, terms, tfs):
            x.clear()
        return out

    for batch in batches:
        for doc_id, n, t, f in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if t:
                ids.append(doc_id)
                lengths.append(n)
                sizes.append(len(t))
                terms.append(t)
                tfs.append(f)
                held += len(t) // 4
                if len(ids) >= size or held >= SHARD_POSTINGS:
                    yield shard()
                    held = 0
    if ids:
        yield shard()


def impacts(term: np.ndarray, tf: np.ndarray, length: np.ndarray, weight: np.ndarray, n_docs: int, n_words: int) -> np.ndarray:
    """What each posting adds to a score, in whole numbers."""
    scaled = 25 * n_docs * length // n_words if int(length.max(initial=0)) * 25 * n_docs < 1 << 63 else np.array([25 * n_docs * int(x) // n_words for x in length], np.int64)
    return weight[term] * (1_000_000_000 * tf // (1000 * tf + 12 * (75 + scaled)))


def _search(rows: DataFrame, asked: list[tuple[int, np.ndarray, np.ndarray]], weight: np.ndarray, n_docs: int, n_words: int, k: int) -> DataFrame:
    """(item, doc_id, score): the k best of each task's documents for each item, given as (item, terms, counts)."""
    shared, size = rows.sparkSession.sparkContext.broadcast((asked, weight)), SHARD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, w = shared.value
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 2] * len(items)
        for ids, lengths, where, term, tf in _shards(batches, size):
            value = impacts(term, tf, lengths[where], w, n_docs, n_words)
            order = np.lexsort((-value, term))
            order = order[value[order] > 0]
            where, value, term = where[order], value[order], term[order]
            starts = np.searchsorted(term, np.arange(len(w) + 1)).tolist()
            for i, (_, terms, counts) in enumerate(items):
                lists = [(where[a:b], c * value[a:b]) for t, c in zip(terms.tolist(), counts.tolist(), strict=True) if (a := starts[t]) < (b := starts[t + 1])]
                if not lists:
                    continue
                scores, found = best[i]
                docs, sums = nra(lists, len(ids), k, int(scores[-1]) if len(scores) == k else 1)
                if len(docs):
                    scores, found = np.concatenate([scores, sums]), np.concatenate([found, ids[docs]])
                    first = np.lexsort((found, -scores))[:k]
                    best[i] = scores[first], found[first]
        columns = [np.repeat([item for item, *_ in items], [len(s) for s, _ in best]), np.concatenate([d for _, d in best]), np.concatenate([s for s, _ in best])]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item", "doc_id", "score"])

    return rows.mapInArrow(run, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents (doc_id, text) with the highest scores above 0 for each item (item_id, text); ties go to the smaller doc_id.

    Null and empty texts have no terms: such documents count nowhere and are never found, and such items have no rows. Rows of docs that
    share an id are documents of their own; a row without an id counts in the statistics and is not returned. Equal items are one; of
    items that share an id each has its own ranks. Other columns are not looked at; an empty table gives no rows.
    """
    spark = docs.sparkSession
    asked = stash(item_terms(items), "items")
    passes = max(1, -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // MOST_TERMS))
    found = None
    for g in range(passes):
        some = asked.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == g).select("item", "terms", "counts").collect()
        numbers: dict[bytes, int] = {}
        packed = [(r.item, np.array([numbers.setdefault(bytes(t), len(numbers)) for t in r.terms], np.int64), np.array(r.counts, np.int64)) for r in some]
        rows = stash(look_up(docs, spark.sparkContext.broadcast(numbers)), "postings")
        n_docs, n_words = rows.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        frequency = document_frequencies(rows, len(numbers))
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df) + 1))) for df in frequency], np.int64)
        part = _search(rows.where("doc_id is not null"), packed, weight, n_docs, max(1, n_words), k)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_TERMS} AS ts FROM documents), q AS (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS ts FROM (SELECT DISTINCT item_id, text FROM benchmark)),
p AS (SELECT k, t, count(*) AS tf FROM (SELECT k, unnest(ts) AS t FROM d) GROUP BY k, t), c AS (SELECT count(*) FILTER (WHERE len(ts) > 0) AS n, sum(len(ts))::BIGINT AS l FROM d),
f AS (SELECT t, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM p GROUP BY t), c),
m AS (SELECT k, doc_id, 75 + (25 * len(ts)::BIGINT * n) // l AS m FROM d, c WHERE len(ts) > 0),
s AS (SELECT i, item_id, k, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM (SELECT i, item_id, unnest(ts) AS t FROM q) JOIN f USING (t) JOIN p USING (t) JOIN m USING (k) GROUP BY i, item_id, k, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= {TOP}"""
