"""Near-duplicate embeddings by tiles of vectors along their principal components.

1. Equal vectors of a label become one node with a count, so a group of copies is compared once.
2. The second moments of the unit vectors, added up over all of them, give an orthogonal basis whose first directions hold most of every
   vector. Nodes are sorted along the first direction and cut into tiles of up to TILE; a hot label is many tiles.
3. Two tiles of a label meet if boxes around their leading coordinates are near enough for a link at all.
4. Products of two tiles are accumulated over some coordinates at a time, the leading ones first. The norms of what is left of two vectors
   bound the rest of their product: pairs that cannot reach the threshold leave, and when none is left the tiles are done. What remains at
   the end is decided by the cosine of the vectors as given, in double precision.
5. Tiles report how many rows each node links with, and for each group that they connect its edges to one node. Components follow from these
   edges by star steps over tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, StructType

from tallymill.llm.common import stash, table, with_fields
from tallymill.llm.op7_bagminhash import components

THRESHOLD = 0.93
TILE = 1024
#: Coordinates of the first stretch; each further one ends at twice the place.
FIRST = 8
#: Leading coordinates of a tile's box.
BOX = 4
#: A basis is fitted for the commonest lengths of vectors up to a longest one; others are compared in the order of their components, with the same result.
BASES, LONGEST = 8, 1024
#: Tasks that add up second moments.
MOMENT_TASKS = 256
#: Bounds give way by so much, far more than rounding can move a sum.
SLACK = 1e-9
#: Pairs whose exact cosines are computed at a time.
AT_ONCE = 1 << 16
#: Tiles of a label that a task pairs with others of it.
PAIRED = 256


def _fits(id_col: str, vector_col: str, label_col: str) -> Column:
    """Whether a row can have links."""
    finite = F.forall(F.col(vector_col), lambda x: F.coalesce((F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x.cast("double")), F.lit(False)))
    return F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.coalesce(finite & F.exists(F.col(vector_col), lambda x: x != 0), F.lit(False))


def _matrix(lists: pa.ListArray) -> np.ndarray:
    """Vectors of one length as rows."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1)


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1, without overflow on the way."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def bases(nodes: DataFrame) -> dict[int, np.ndarray]:
    """length -> orthogonal basis (columns), the direction with the largest second moment first."""
    fitted = {r.dim for r in nodes.where(F.col("dim").between(2, LONGEST)).groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(BASES).collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column(0).to_numpy()
            for d in set(dims.tolist()):
                u = unit(_matrix(batch.column(1).filter(pa.array(dims == d))))
                sums[d] = sums.get(d, 0.0) + u.T @ u
        for d, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([row.tobytes() for row in m], pa.binary())], ["dim", "row", "sums"])

    def add(rows: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(s, np.float64) for s in rows["sums"].to_pylist()], axis=0)
        return rows.slice(0, 1).set_column(2, "sums", pa.array([total.tobytes()], pa.binary()))

    ddl = "dim int, row int, sums binary"
    parts = nodes.where(F.col("dim").isin(list(fitted))).select("dim", "v").coalesce(MOMENT_TASKS).mapInArrow(run, ddl)
    moments = {d: np.zeros((d, d)) for d in fitted}
    for r in parts.groupBy("dim", "row").applyInArrow(add, ddl).collect():
        moments[r.dim][r.row] = np.frombuffer(r.sums, np.float64)
    return {d: np.ascontiguousarray(np.linalg.eigh((m + m.T) / 2)[1][:, ::-1]) for d, m in moments.items()}


def _with_lead(nodes: DataFrame, shared) -> DataFrame:
    """nodes with ``lead``, the first coordinate of the unit vector."""
    columns = ["gid", "node", "n", "label", "dim", "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, lead = batch.column(4).to_numpy(), np.zeros(batch.num_rows)
            for d in set(dims.tolist()):
                u = unit(_matrix(batch.column(5).filter(pa.array(dims == d))))
                lead[dims == d] = u @ shared.value[d][:, 0] if d in shared.value else u[:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lead)], [*columns, "lead"])

    rows = nodes.select(*columns)
    return rows.mapInArrow(run, with_fields(rows.schema, {"lead": DoubleType()}))


_TILE_DDL = "tile long, dim int, gids binary, nodes binary, counts binary, vectors binary, low array<double>, high array<double>"


def tiles(nodes: DataFrame, shared, n_nodes: int) -> DataFrame:
    """Rows of up to TILE nodes of one label and length, in the order of the first coordinate; vectors as 64-bit or, where that is exact, 32-bit numbers."""
    label_type = nodes.schema["label"].dataType

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, here, held, size, arrow = TaskContext.get().partitionId() << 33, None, [], 0, None

        def tile() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            v = _matrix(rows["v"].chunk(0))
            d = v.shape[1]
            c = unit(v) @ shared.value[d] if d in shared.value else unit(v)
            with np.errstate(over="ignore"):
                short = v.astype(np.float32)
            packed = [x.to_numpy().astype(np.int64).tobytes() for x in (rows["gid"], rows["node"], rows["n"])]
            values = (short if np.array_equal(short, v) else v).tobytes()
            columns = [[number], [d], *[[x] for x in (*packed, values)], [c[:, :BOX].min(0)], [c[:, :BOX].max(0)]]
            types = [pa.int64(), pa.int32(), *[pa.binary()] * 4, *[pa.list_(pa.float64())] * 2]
            arrays = [pa.array(x, t) for x, t in zip(columns, types, strict=True)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([here[0]], arrow)], ["tile", "dim", "gids", "nodes", "counts", "vectors", "low", "high", "label"])

        for batch in batches:
            arrow = batch.schema.field("label").type
            keys = list(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True))
            at = 0
            while at < len(keys):
                if held and (keys[at] != here or size == TILE):
                    yield tile()
                    number, held, size = number + 1, [], 0
                here, end = keys[at], at
                while end < len(keys) and keys[end] == here and size + end - at < TILE:
                    end += 1
                held.append(batch.slice(at, end - at))
                size, at = size + end - at, end
        if held:
            yield tile()

    ordered = _with_lead(nodes, shared).repartitionByRange(max(1, min(10_000, n_nodes // (2 * TILE) + 1)), "label", "dim", "lead", "gid").sortWithinPartitions("label", "dim", "lead", "gid")
    return ordered.mapInArrow(cut, with_fields(StructType.fromDDL(_TILE_DDL), {"label": label_type}))


def near_tiles(cut: DataFrame, n_tiles: int) -> DataFrame:
    """(a, b): tiles of one label and length, each with itself too, that may hold a link. A label's tiles are dealt over several tasks."""
    salts = n_tiles // PAIRED + 1
    meta = lambda t: cut.select("label", "dim", F.col("tile").alias(t), F.col("low").alias(f"{t}_low"), F.col("high").alias(f"{t}_high"))
    left = meta("a").withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(salts)).cast("int"))
    right = meta("b").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    gap = lambda i: F.greatest(F.lit(0.0), F.get("a_low", F.lit(i)) - F.get("b_high", F.lit(i)), F.get("b_low", F.lit(i)) - F.get("a_high", F.lit(i)))
    # unit vectors of a cosine c are sqrt(2 - 2c) apart
    apart = sum((gap(i) * gap(i) for i in range(BOX)), F.lit(0.0))
    return left.join(right, ["label", "dim", "salt"]).where((F.col("a") <= F.col("b")) & (apart <= 2 - 2 * THRESHOLD + SLACK)).select("a", "b")


def candidates(x: np.ndarray, y: np.ndarray, same: bool, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j), i < j where same, of the unit rows of x and y whose product may reach the threshold; coordinates are looked at from the first on."""
    least, d = threshold - SLACK, x.shape[1]
    rest = lambda z: np.sqrt(np.maximum(0.0, np.cumsum((z * z)[:, ::-1], 1)[:, ::-1]))
    rest_x, rest_y = (np.pad(rest(z), ((0, 0), (0, 1))) for z in (x, y))
    rows, columns, sums, at, i, j = np.arange(len(x)), np.arange(len(y)), np.zeros((len(x), len(y))), 0, None, None
    while at < d:
        end = min(d, max(FIRST, 2 * at))
        if i is None:
            sums += x[rows, at:end] @ y[columns, at:end].T
            alive = sums + rest_x[rows, end][:, None] * rest_y[columns, end] >= least
            if same:
                alive &= rows[:, None] < columns
            n = int(alive.sum())
            if n * 8 < alive.size:  # few pairs are left: they go on one by one
                r, c = np.nonzero(alive)
                i, j, sums = rows[r], columns[c], sums[r, c]
            else:
                r, c = alive.any(1), alive.any(0)
                rows, columns, sums = rows[r], columns[c], sums[np.ix_(r, c)]
        else:
            sums = sums + np.concatenate([np.einsum("ij,ij->i", x[i[p : p + AT_ONCE], at:end], y[j[p : p + AT_ONCE], at:end]) for p in range(0, len(i), AT_ONCE)])
            alive = sums + rest_x[i, end] * rest_y[j, end] >= least
            i, j, sums = i[alive], j[alive], sums[alive]
        if i is not None and not len(i):
            break
        at = end
    if i is None:
        r, c = np.nonzero(sums >= least if not same else (sums >= least) & (rows[:, None] < columns))
        i, j = rows[r], columns[c]
    return i, j


def exact_links(v: np.ndarray, w: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Which pairs of rows of v and w, vectors as given, have a cosine of threshold or more."""
    v, w = (z / np.abs(z).max(1, keepdims=True) for z in (v, w))
    long_v, long_w = (np.sqrt(np.einsum("ij,ij->i", z, z)) for z in (v, w))
    dots = [np.einsum("ij,ij->i", v[i[p : p + AT_ONCE]], w[j[p : p + AT_ONCE]]) for p in range(0, len(i), AT_ONCE)]
    return np.concatenate(dots) / (long_v[i] * long_w[j]) >= threshold if dots else np.zeros(0, bool)


def connected(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest of the places 0 to n - 1 that each is connected to by the pairs (i, j)."""
    least = np.arange(n)
    while len(i):
        a, b = least[i], least[j]
        apart = a != b
        if not apart.any():
            break
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(least, np.maximum(a, b), np.minimum(a, b))
        while (up := least[least] != least).any():
            least[up] = least[least[up]]
    return least


_FOUND = pa.schema([("gid", pa.int64()), ("n", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def _compare(pairs: DataFrame, shared) -> DataFrame:
    """(gid, n) of nodes with links between two tiles, n rows on the other side, and (a, b), edges between node names that connect what these links connect."""

    def tile(row: dict, side: str) -> tuple[np.ndarray, ...]:
        gids, nodes, counts = (np.frombuffer(row[f"{c}_{side}"], np.int64) for c in ("gids", "nodes", "counts"))
        raw = row[f"vectors_{side}"]
        v = np.frombuffer(raw, np.float32 if len(raw) == 4 * row["dim"] * len(gids) else np.float64).reshape(len(gids), -1).astype(np.float64)
        return gids, nodes, counts, v

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                same = row["a"] == row["b"]
                gids, nodes, counts, v = tile(row, "a")
                gids_b, nodes_b, counts_b, w = (gids, nodes, counts, v) if same else tile(row, "b")
                basis = shared.value.get(row["dim"])
                x, y = (unit(z) if basis is None else unit(z) @ basis for z in (v, w))
                i, j = candidates(x, y, same)
                good = exact_links(v, w, i, j)
                i, j = i[good], j[good]
                if not len(i):
                    continue
                n_a, n_b = np.bincount(i, counts_b[j], len(gids)).astype(np.int64), np.bincount(j, counts[i], len(gids_b)).astype(np.int64)
                offset = 0 if same else len(gids)
                names = nodes if same else np.concatenate([nodes, nodes_b])
                least = connected(len(names), i, j + offset)
                below = np.flatnonzero(least != np.arange(len(names)))
                used_a, used_b = np.flatnonzero(n_a), np.flatnonzero(n_b)
                tallies = [np.concatenate([gids[used_a], gids_b[used_b]]), np.concatenate([n_a[used_a], n_b[used_b]])]
                edges = [names[least[below]], names[below]]
                blank = lambda n: pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays([*map(pa.array, tallies), blank(len(tallies[0])), blank(len(tallies[0]))], schema=_FOUND)
                yield pa.RecordBatch.from_arrays([blank(len(below)), blank(len(below)), *map(pa.array, edges)], schema=_FOUND)

    return pairs.mapInArrow(run, "gid long, n long, a long, b long")


def linked(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row: how many other rows of its label have a cosine of THRESHOLD or more with it, and the smallest id that links lead to.

    Rows without a vector, an id or a label, with a null, NaN or infinite component, or of zeros alone, have no links. Vectors of different
    lengths have none with one another. Rows that share an id are one point of the links' graph, but each row counts its own links, to the
    other rows. A row without an id has no component (null) and isn't kept. Other columns are not looked at; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    names = id_col, vector_col, label_col
    rows = vectors.where(_fits(*names)).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("v"))
    grouped = rows.groupBy("label", "v").agg(F.min("vec_id").alias("node"), F.count("*").alias("n"))
    nodes = stash(grouped.select(F.monotonically_increasing_id().alias("gid"), "node", "n", "label", F.size("v").alias("dim"), "v"), "vectors")
    n_nodes = nodes.count()
    shared = spark.sparkContext.broadcast(bases(nodes))
    cut = stash(tiles(nodes, shared, n_nodes), "tiles")
    side = lambda s, *more: cut.select(F.col("tile").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("gids", "nodes", "counts", "vectors")], *more)
    pairs = near_tiles(cut, cut.count()).join(side("a", "dim"), "a").join(side("b"), "b")
    found = stash(_compare(pairs, shared), "links")
    members = stash(rows.join(nodes.select("label", "v", "gid", "node", F.col("n").alias("copies")), ["label", "v"]).select("vec_id", "gid", "node", "copies"), "members")
    several = members.groupBy("vec_id").agg(F.min("node").alias("a"), F.max("node").alias("most")).where("a <> most").select("vec_id", "a")
    twice = members.join(several, "vec_id").where("node <> a").select("a", F.col("node").alias("b")).distinct()
    classes = components(found.where("a is not null").select("a", "b").unionByName(twice))
    tally = found.where("gid is not null").groupBy("gid").agg(F.sum("n").alias("links"))
    with_links = members.join(tally, "gid", "left").join(classes, "node", "left")
    inside = with_links.select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("class", "node").alias("component_id"))
    own = F.col(id_col).cast("long")
    alone = vectors.where(~_fits(*names)).select(own.alias("vec_id"), F.lit(0).cast("long").alias("n_links"), own.alias("component_id"))
    return inside.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "embeddings"))


SQL = f"""WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a), c AS (SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id"""
