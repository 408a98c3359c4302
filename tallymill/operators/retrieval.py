"""Nearest neighbours by inner product, exactly: blocks of queries against blocks of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallymill.operators.ranking import top_per_key

#: Queries and rows of a block.
QUERY_ROWS, ROWS = 512, 4096
#: Blocks of rows are dealt to at most so many slots for each core; a slot gets a copy of all queries.
SLOTS_PER_CORE = 4


def best_of(scores: np.ndarray, q_ids: np.ndarray, c_ids: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """(query, candidate, score) of each query's k best in this block, without rows of the query's own id. c_ids ascend, so among equal scores an earlier column wins. Only the k best are sorted."""
    n = scores.shape[1]
    for q, row in zip(q_ids.tolist(), scores, strict=True):
        own = np.searchsorted(c_ids, [q, q + 1])
        first = n - k - int(own[1] - own[0])
        if first > 0:
            edge = (np.sort(row) if row.dtype == object else np.partition(row, first))[first]
            columns = np.flatnonzero(row >= edge)
        else:
            columns = np.arange(n)
        columns = columns[(columns < own[0]) | (columns >= own[1])]
        for c in sorted(columns.tolist(), key=lambda c: -row[c])[:k]:
            yield q, int(c_ids[c]), int(row[c])


def _blocks(rows: DataFrame, size: int, given: str) -> DataFrame:
    """(block, ids, values): rows (id, array<long>) packed by a hash into blocks of about so many."""
    blocks = max(1, -(-rows.count() // size))
    # of the whole row, so that a block is no more than its share whatever the ids are
    return rows.groupBy(F.pmod(F.xxhash64(*rows.columns), F.lit(blocks)).alias(f"{given}_block")).agg(F.array_sort(F.collect_list(F.struct(*rows.columns))).alias(given))


def nearest(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows for each query, other than those of its own id; ties go to the smaller id.

    queries: (query_id, q array<long>); rows: (vec_id, v array<long>); vectors are of one length. Each block of queries meets each block
    of rows once, and only the k best of a query leave a pair of blocks, so pairs of a query and a row are never rows of a table.
    """
    spark = rows.sparkSession
    left, right = _blocks(queries.select("query_id", "q"), QUERY_ROWS, "qs"), _blocks(rows.select("vec_id", "v"), ROWS, "vs")
    slots = max(1, min(-(-rows.count() // ROWS), SLOTS_PER_CORE * spark.sparkContext.defaultParallelism))
    left = left.select("qs", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot")).repartition(slots, "slot")
    pairs = left.join(right.select("vs", F.pmod("vs_block", F.lit(slots)).cast("int").alias("slot")).repartition(slots, "slot"), "slot")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (q_ids, q), (c_ids, v) = (_matrix(column[i].values) for column in batch.columns)
                found = list(best_of(_products(q, v), q_ids, c_ids, k))
                columns = zip(*found, strict=True) if found else ([], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    found = pairs.select("qs", "vs").mapInArrow(search, "query_id long, vec_id long, score long")
    return top_per_key(found, ["query_id"], k, F.desc("score"), "vec_id").select("query_id", "rank", "vec_id", "score")


def _matrix(rows: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    ids, lists = rows.field(0), rows.field(1)
    return ids.to_numpy(), lists.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers: in floating point where that is exact."""
    most = lambda m: float(np.abs(m).max(initial=0))
    if most(q) * most(v) * max(1, q.shape[1]) < 2.0**53:
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    return q @ v.T
