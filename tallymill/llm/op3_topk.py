"""Exact top-k search by term-at-a-time accumulation over blocks.

A term is a vector component. Candidates are packed into blocks, each with a posting list (rows, weights) for every term; queries are
packed into blocks as sparse rows. For a pair of blocks every term scatters its weighted postings into the dense scores of the queries
that have the term; the k best of each query are then partitioned out, and the few left from all blocks are merged by rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tallymill.llm.common import stash, table
from tallymill.operators.retrieval import best_of

SCALE, TOP, EVERY = 256, 5, 50
CANDIDATE_ROWS, QUERY_ROWS = 4096, 512
#: Rows that a hash deals to a partition on average, as a share of a block, so that few partitions need a second block.
FILLED = 0.9
#: Candidate blocks are dealt in turn to so many slots for each core, at most one for each block. A slot gets all query blocks: more slots are more tasks and more copies of the queries.
SLOTS_PER_CORE = 4

_BLOCK = pa.schema([("block", pa.int64()), ("n", pa.int32()), ("ids", pa.binary()), ("rows", pa.binary()), ("terms", pa.binary()), ("weights", pa.binary())])
_BLOCK_DDL = "block long, n int, ids binary, rows binary, terms binary, weights binary"


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, w array<long>): floor(SCALE * x) of each component. Vectors that are null or hold a null or non-finite component, and rows without an id, are left out."""
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    sound = F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & F.forall(x, lambda v: F.coalesce((F.abs(v) < float("inf")) & ~F.isnan(v), F.lit(False)))
    # a double of 2 ** 63 or more would become the largest whole number without a word
    whole = lambda v: F.when((v * SCALE >= -(2.0**63)) & (v * SCALE < 2.0**63), F.floor(v * SCALE).cast("long")).otherwise(F.raise_error(F.lit("a component is too large for 64 bits")).cast("long"))
    return vectors.where(sound).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, whole).alias("w"))


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Packs (vec_id, w) into blocks of up to ``size`` rows in ascending id: row, term and weight of every component that isn't 0."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, ids, vectors = TaskContext.get().partitionId() << 32, [], []

        def block() -> pa.RecordBatch:
            order = np.argsort(np.array(ids, np.int64), kind="stable")
            lengths = np.array([len(v) for v in vectors], np.int64)[order]
            flat = np.concatenate([vectors[i] for i in order]) if lengths.sum() else np.zeros(0, np.int64)
            row = np.repeat(np.arange(len(ids)), lengths)
            term = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            used = flat != 0
            by_term = np.argsort(term[used], kind="stable")
            columns = [np.array(ids, np.int64)[order], row[used][by_term].astype(np.int32), term[used][by_term].astype(np.int32), flat[used][by_term]]
            return pa.RecordBatch.from_pylist([dict(zip(_BLOCK.names, [number, len(ids), *[c.tobytes() for c in columns]], strict=True))], schema=_BLOCK)

        for batch in batches:
            ids += batch.column(0).to_pylist()
            lists = batch.column(1)
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            vectors += [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]
            while len(ids) >= size:
                (ids, more), (vectors, rest) = (ids[:size], ids[size:]), (vectors[:size], vectors[size:])
                yield block()
                number, ids, vectors = number + 1, more, rest
        if ids:
            yield block()

    return rows.mapInArrow(pack, _BLOCK_DDL)


def _postings(rows: bytes, terms: bytes, weights: bytes) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    row, term, weight = np.frombuffer(rows, np.int32), np.frombuffer(terms, np.int32), np.frombuffer(weights, np.int64)
    at = np.flatnonzero(np.diff(term, prepend=-1))
    ends = [*at[1:].tolist(), len(term)]
    return {int(term[a]): (row[a:b], weight[a:b]) for a, b in zip(at.tolist(), ends, strict=True)}


def _narrowed(queries: dict, candidates: dict) -> np.dtype:
    most = lambda w: max(abs(int(w.min())), abs(int(w.max())))
    bound = sum(most(w) * most(candidates[t][1]) for t, (_, w) in queries.items() if t in candidates)
    return np.dtype(np.int32 if bound < 1 << 31 else np.int64 if bound < 1 << 63 else object)


def block_scores(n_q: int, queries: dict, n_c: int, candidates: dict) -> np.ndarray:
    """Inner products, queries x candidates, one term after another; in 32 bits where no sum can leave them, in whole numbers of any size where one could leave 64."""
    kind = _narrowed(queries, candidates)
    scores, spare = np.zeros((n_q, n_c), kind), np.empty((n_q, n_c), kind)
    for term, (q_rows, q_weights) in queries.items():
        if term not in candidates:
            continue
        c_rows, c_weights = candidates[term]
        c_weights, q_weights = c_weights.astype(kind), q_weights.astype(kind)
        if len(c_rows) < n_c:
            for q, w in zip(q_rows.tolist(), q_weights, strict=True):
                scores[q, c_rows] += w * c_weights
        elif len(q_rows) == n_q:  # both lists name every row in order
            np.multiply(q_weights[:, None], c_weights, out=spare)
            scores += spare
        else:
            scores[q_rows] += np.multiply(q_weights[:, None], c_weights, out=spare[: len(q_rows)])
    return scores


def top_k(vectors: DataFrame, is_query: Column, k: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows, other than those of the query's own id, with the highest inner product of whole-number vectors; ties go to the smaller id.

    Vectors of different lengths are compared over the components that both have. A query with fewer candidates has fewer rows; a
    repeated id is a candidate, and a query, once for each row. Scores and components are 64-bit; a result, or a scaled component, that doesn't fit is an error.
    Vectors without sound components take no part, other columns are not looked at, and an empty table gives no rows.
    """
    rows = whole_vectors(vectors)
    wanted = rows.where(is_query)
    n_queries, n = wanted.count(), rows.count()
    dealt = lambda part, count, size: part.repartition(max(1, -(-count // max(1, int(FILLED * size)))), "vec_id")
    q_blocks = _blocks(dealt(wanted, n_queries, QUERY_ROWS), QUERY_ROWS)
    c_blocks = stash(_blocks(dealt(rows, n, CANDIDATE_ROWS), CANDIDATE_ROWS), "blocks")
    slots = max(1, min(c_blocks.count(), SLOTS_PER_CORE * vectors.sparkSession.sparkContext.defaultParallelism))
    left = q_blocks.select([F.col(c).alias(f"q_{c}") for c in _BLOCK.names] + [F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot")])
    # a block's number holds its partition above 32 bits and its place there
    right = c_blocks.withColumn("slot", F.pmod(F.shiftright("block", 32) + F.col("block").bitwiseAND((1 << 32) - 1), F.lit(slots)).cast("int"))
    # a value for each slot that Spark deals to a partition of its own
    keys = F.broadcast(vectors.sparkSession.range(40 * slots).groupBy(F.pmod(F.hash("id"), F.lit(slots)).alias("slot")).agg(F.min("id").alias("key")))
    keyed = lambda part: part.join(keys, "slot", "left").withColumn("key", F.coalesce("key", F.col("slot").cast("long"))).drop("slot").repartition(slots, "key")
    pairs = keyed(left).join(keyed(right), "key").drop("key")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in (x for i in range(batch.num_rows) for x in batch.slice(i, 1).to_pylist()):
                queries, candidates = _postings(r["q_rows"], r["q_terms"], r["q_weights"]), _postings(r["rows"], r["terms"], r["weights"])
                found = list(best_of(block_scores(r["q_n"], queries, r["n"], candidates), np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["ids"], np.int64), k))
                columns = zip(*found, strict=True) if found else ([], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


SQL = f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.w, c.w)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {EVERY} = 0),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= {TOP}"""
