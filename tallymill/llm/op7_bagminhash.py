"""Near-duplicates by BagMinHash signatures of word-shingle multisets, banding, and exact verification.

1. A text's multiset of SHINGLE-word shingles gets a signature: for every shingle a Poisson process over (weight, time), parted into
   weight ranges that double, gives points in ascending time; a point whose weight lies below the shingle's count falls into one of
   SLOTS registers, which keep their earliest time. Two registers agree with the probability of the weighted Jaccard similarity.
2. Rows with equal multisets become one node, named by their smallest doc_id.
3. Nodes that share the BAND_ROWS registers of a band meet in a bucket.
4. Each node of a bucket is compared with the bucket's smallest node. Comparisons are exact: nodes whose multisets have a similarity of
   THRESHOLD or more are linked. Linked nodes form classes.
5. Buckets that still hold several classes are compared in full, in pairs of blocks of about BLOCK nodes: a pair of nodes counts in the
   first band that they share, and is compared only if nothing has linked its classes yet. Signatures and sizes are compared first, so
   multisets are sent only where a pair may be similar enough. A bucket of copies costs a star, and no task holds more than two blocks.
   What is known by then are parts of classes, which is enough: it only saves comparisons.
   Of the pairs that meet none is passed over but those that LEAST_AGREEMENT rules out.
6. Classes are connected components, by alternating star steps over tables in the shared folder; the neighbours of a node are dealt to
   several tasks, however many it has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallymill.llm.common import discard, sliced, stash, table
from tallymill.llm.op1_token_files import split_words

SHINGLE, THRESHOLD = 5, 0.8
BANDS, BAND_ROWS = 25, 5
SLOTS = BANDS * BAND_ROWS
#: Nodes of a block in the full comparison of a bucket.
BLOCK = 256
#: A node's neighbours are dealt over so many parts when classes are joined.
SALTS = 64
#: Texts or pairs that a task holds at a time.
AT_ONCE = 100
#: Pairs whose signatures agree in less than this share are not compared: at a similarity of 0.8 that happens once in 10 ** 8 pairs.
LEAST_AGREEMENT = 0.58


def shingles(text: str) -> np.ndarray:
    """64-bit hashes of a text's shingles, one for each place, sorted. A text with fewer words than a shingle has one, of all its words; a text without words has none."""
    from xxhash import xxh3_64_intdigest

    words = [w for w in split_words(text) if w]
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxh3_64_intdigest(" ".join(words))], np.uint64)
    own = {w: xxh3_64_intdigest(w) for w in set(words)}
    h = np.fromiter(map(own.__getitem__, words), np.uint64, len(words))
    n = len(words) - SHINGLE + 1
    mixed = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        mixed = _mix(mixed * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.sort(mixed)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(key: np.ndarray, step: np.ndarray) -> np.ndarray:
    bits = _mix(key + step * np.uint64(0xD1342543DE82EF95))
    return ((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(owner: np.ndarray, item: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Registers (n x SLOTS) of n multisets, given as (owner, item hash, count). A multiset without items keeps infinity.

    The weights of an item are parted into ranges [0, 1), [1, 2), [2, 4), [4, 8) ..., each with a Poisson process of its width that all
    multisets share; a point's own unit range follows from its place in the process, and points at or above the item's count are passed
    over, which is at most half of what an item draws.
    """
    registers, limit = np.full(n * SLOTS, np.inf), np.full(n, np.inf)
    parts, low, width = [], 0, 1
    while len(more := np.flatnonzero(weight > low)):
        parts.append((owner[more], _mix(item[more] + np.uint64(low)), weight[more] - low, np.full(len(more), width)))
        low, width = low + width, low + width
    if not parts:
        return registers.reshape(n, SLOTS)
    owner, key, inside, width = map(np.concatenate, zip(*parts, strict=True))
    time, drawn = np.zeros(len(owner)), 0
    while len(owner):
        many = int(np.clip(30_000 // len(owner), 1, 48))  # points of each process in this round
        step = np.arange(drawn, drawn + many, dtype=np.uint64) * np.uint64(3)
        times = time[:, None] + np.cumsum(-np.log(_uniform(key[:, None], step)), 1) / width[:, None]
        place = _uniform(key[:, None], step + np.uint64(1)) * width[:, None]
        good = (times < limit[owner][:, None]) & (place < inside[:, None])
        slot = (_mix(key[:, None] ^ (step + np.uint64(2)) * np.uint64(0xA0761D6478BD642F)) % np.uint64(SLOTS)).astype(np.int64)
        np.minimum.at(registers, (owner[:, None] * SLOTS + slot)[good], times[good])
        limit = registers.reshape(n, SLOTS).max(1)
        time, drawn = times[:, -1], drawn + many
        alive = time < limit[owner]
        owner, key, inside, width, time = owner[alive], key[alive], inside[alive], width[alive], time[alive]
    return registers.reshape(n, SLOTS)


def short_registers(registers: np.ndarray) -> np.ndarray:
    """16 bits of each register; different times agree in them once in 65536 times."""
    return (_mix(registers.view(np.uint64)) >> np.uint64(48)).astype("<u2")


def multiset(text: str) -> np.ndarray:
    """The shingles of a text as a sorted set: the n-th occurrence of a shingle is an item of its own, so set sizes are multiset sizes."""
    items = shingles(text)
    if len(items) < 2:
        return items
    first = np.concatenate([[True], items[1:] != items[:-1]])
    nth = np.arange(len(items)) - np.maximum.accumulate(np.where(first, np.arange(len(items)), 0))
    return np.sort(np.where(nth == 0, items, _mix(items + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))))


def similarity(x: np.ndarray, y: np.ndarray) -> float:
    both = np.intersect1d(x, y, assume_unique=True).size
    return both / (x.size + y.size - both)


def sign(docs: DataFrame) -> DataFrame:
    """(doc_id, key, sig) for each row: the hash of its multiset and its short registers, both null for a text without words."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in sliced(batches, AT_ONCE):
            sets = [shingles(t or "") for t in batch.column(1).to_pylist()]
            owner, item, weight = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for i, s in enumerate(sets):
                different, counts = np.unique(s, return_counts=True)
                owner.append(np.full(len(different), i))
                item.append(different)
                weight.append(counts)
            rows = short_registers(signatures(np.concatenate(owner), np.concatenate(item), np.concatenate(weight), len(sets)))
            keys = [xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            sigs = [r.tobytes() if len(s) else None for r, s in zip(rows, sets, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, key binary, sig binary")


def buckets(nodes: DataFrame) -> DataFrame:
    """(band, bucket, node) of the buckets in which several nodes meet."""
    bands = F.array(*[F.struct(F.lit(b).alias("band"), F.xxhash64(F.lit(b), F.substring("sig", 2 * BAND_ROWS * b + 1, 2 * BAND_ROWS)).alias("bucket")) for b in range(BANDS)])
    each = nodes.select("node", F.explode(bands).alias("b")).select("b.band", "b.bucket", "node")
    shared = each.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    return each.join(shared, "bucket").select("band", "bucket", "node")


def with_multisets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, sig, items): the multisets of these nodes (node, key, sig), from the texts of the rows that gave them; twice for a row that stands twice, which does no harm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in sliced(batches, AT_ONCE):
            node, key, sig, text = (c.to_pylist() for c in batch.columns)
            out = []
            for n, k, s, t in zip(node, key, sig, text, strict=True):
                if xxh3_128_digest(shingles(t).tobytes()) == k:  # a row of the same id with another text isn't the node
                    out.append({"node": n, "sig": s, "items": multiset(t).tobytes()})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("node", pa.int64()), ("sig", pa.binary()), ("items", pa.binary())]))

    rows = nodes.join(docs.select(F.col("doc_id").cast("long").alias("node"), "text").where("text is not null"), "node").select("node", "key", "sig", "text")
    return rows.mapInArrow(run, "node long, sig binary, items binary")


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_MEMBERS = pa.schema([("band", pa.int32()), ("bucket", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("block", pa.int32()), ("node", pa.int64()), ("class", pa.int64())])


def compare_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, AT_ONCE):
            found = ([], [])
            for a, b, sig_a, sig_b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                agreement = (np.frombuffer(sig_a, "<u2") == np.frombuffer(sig_b, "<u2")).mean()
                if agreement >= LEAST_AGREEMENT and similarity(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= THRESHOLD:
                    found[0].append(a)
                    found[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()) for f in found], schema=_LINKS)

    left = sets.select(F.col("node").alias("a"), F.col("sig").alias("sig_a"), F.col("items").alias("items_a"))
    right = sets.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"), F.col("items").alias("items_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sig_a", "sig_b", "items_a", "items_b").mapInArrow(run, "a long, b long")


def _likely(rows: pa.Table, order: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Places of the pairs between two blocks of one bucket (or within one) whose signatures may belong to similar multisets, and their agreement. A pair counts in the first band that it shares."""
    band, i, j = (rows[c][0].as_py() for c in ("band", "i", "j"))
    block, group, size = (rows[c].to_numpy()[order] for c in ("block", "class", "size"))
    sigs = np.stack([np.frombuffer(rows["sig"][at].as_buffer(), "<u2") for at in order.tolist()])
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    found_x, found_y, found_n = [], [], []
    for x in left.tolist():
        y = right[(right > x) if i == j else slice(None)]
        y = y[(group[y] != group[x]) & (np.minimum(size[y], size[x]) >= THRESHOLD * np.maximum(size[y], size[x]))]
        if not len(y):
            continue
        equal = sigs[y] == sigs[x]
        agreement = equal.sum(1)
        first = equal.reshape(len(y), BANDS, BAND_ROWS).all(2).argmax(1)
        good = (first == band) & (agreement >= LEAST_AGREEMENT * SLOTS)
        found_x += [x] * int(good.sum())
        found_y += y[good].tolist()
        found_n += agreement[good].tolist()
    return found_x, found_y, found_n


def likely_members(rows: pa.Table) -> pa.Table:
    """The rows (band, bucket, i, j, block, node, class), without signatures, of the nodes that have a likely partner here."""
    x, y, _ = _likely(rows, np.arange(rows.num_rows))
    return rows.select(_MEMBERS.names).take(pa.array(np.unique(np.array(x + y, np.int64)))).cast(_MEMBERS)


def compare_blocks(rows: pa.Table) -> pa.Table:
    """Links between nodes of two blocks of one bucket (or within one), given as (band, bucket, i, j, block, node, class, sig, size, items): enough of them to join all classes that have a link here."""
    order = np.argsort(rows["node"].to_numpy(), kind="stable")
    node, group = (rows[c].to_numpy()[order] for c in ("node", "class"))
    sets = [np.frombuffer(rows["items"][at].as_buffer(), np.uint64) for at in order.tolist()]  # views of the Arrow rows
    found_x, found_y, found_n = _likely(rows, order)
    parent = {g: g for g in np.unique(group).tolist()}

    def root(g: int) -> int:
        while parent[g] != g:
            parent[g] = g = parent[parent[g]]
        return g

    links = ([], [])
    for at in np.argsort(-np.array(found_n), kind="stable").tolist():
        x, y = found_x[at], found_y[at]
        one, other = root(int(group[x])), root(int(group[y]))
        small, large = sorted((len(sets[x]), len(sets[y])))
        if one != other and small >= THRESHOLD * large and similarity(sets[x], sets[y]) >= THRESHOLD:
            parent[one] = other
            links[0].append(int(node[x]))
            links[1].append(int(node[y]))
    return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in links], schema=_LINKS)


def full_comparison(met: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) in the buckets that hold several classes."""
    known = met.join(classes.withColumnRenamed("class", "found"), "node", "left").select("band", "bucket", "node", F.coalesce("found", "node").alias("class"))
    parts = known.groupBy("bucket", "class").agg(F.count("*").alias("n"))
    whole = parts.groupBy("bucket").agg(F.sum("n").alias("n"), F.max(F.struct("n", "class")).alias("top")).where("n > top.n")
    # the nodes of the largest class are linked already: they have blocks of their own, after the others', which meet only the others'
    apart, blocks = F.col("n") > BLOCK, lambda n: F.ceil(n / BLOCK).cast("int")
    mixed = whole.select("bucket", F.when(apart, F.col("top.class")).alias("large"), F.when(apart, blocks(F.col("n") - F.col("top.n"))).otherwise(1).alias("few"), F.when(apart, blocks(F.col("top.n"))).otherwise(0).alias("many"))
    is_large, deal = F.coalesce(F.col("class") == F.col("large"), F.lit(False)), lambda n: F.pmod(F.xxhash64("node", "bucket"), F.col(n)).cast("int")
    dealt = known.join(mixed, "bucket").withColumn("block", F.when(is_large, F.col("few") + deal("many")).otherwise(deal("few")))
    last = F.when(is_large, F.col("few")).otherwise(F.col("few") + F.col("many")) - 1
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), last))).drop("large", "few", "many")
    paired = paired.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other")
    signed = sets.select("node", "sig", F.expr("octet_length(items) div 8").alias("size"))
    rows = paired.join(signed, "node").select("band", "bucket", "i", "j", "block", "node", "class", "sig", "size")
    members = rows.groupBy("bucket", "i", "j").applyInArrow(likely_members, "band int, bucket long, i int, j int, block int, node long, class long")
    items = members.join(sets.withColumn("size", F.expr("octet_length(items) div 8")), "node")
    return items.select("band", "bucket", "i", "j", "block", "node", "class", "sig", "size", "items").groupBy("bucket", "i", "j").applyInArrow(compare_blocks, "a long, b long")


def near_classes(links: DataFrame) -> DataFrame:
    """(node, class): classes that are parts of the true ones, in two steps from links (a < b): a node's smallest neighbour, then that one's."""
    lowest = links.groupBy("b").agg(F.min("a").alias("a"))
    above = lowest.select(F.col("b").alias("a"), F.col("a").alias("top"))
    return lowest.join(above, "a", "left").select(F.col("b").alias("node"), F.coalesce("top", "a").alias("class"))


def _with_least(edges: DataFrame, key: str, other: str) -> DataFrame:
    """Adds m, the least ``other`` of each row's key. Rows of one key are dealt over SALTS parts, each of which gets m: a part has at least one row, so there are no more copies of m than rows."""
    salted = edges.withColumn("salt", F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy(key, "salt").agg(F.min(other).alias("m"))
    least = parts.groupBy(key).agg(F.min("m").alias("m"), F.collect_list("salt").alias("salts"))
    return salted.join(least.select(key, "m", F.explode("salts").alias("salt")), [key, "salt"]).drop("salt")


def components(links: DataFrame) -> DataFrame:
    """(node, class): the smallest node that each node is connected to; nodes without links, and the smallest ones, are left out."""
    edges = links.select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).where("high <> low")
    state = None
    while True:
        both = edges.select(F.col("high").alias("u"), F.col("low").alias("v")).unionByName(edges.select(F.col("low").alias("u"), F.col("high").alias("v")))
        large = _with_least(both, "u", "v").where("v > u").select(F.col("v").alias("high"), F.least("u", "m").alias("low")).distinct()
        small = _with_least(large, "high", "low")
        # a node's own row comes from its part with the least neighbour
        small = small.select(F.when(F.col("low") == F.col("m"), F.col("high")).otherwise(F.col("low")).alias("high"), F.col("m").alias("low")).distinct()
        before, edges = edges, stash(small, "edges")
        if state is not None:
            discard(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("high").alias("node"), F.col("low").alias("class"))
        state = now


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id) for each row: documents of a class are connected by similar ones, and the class is named by its smallest id.

    A document is its id: rows that share an id share a class, whatever their texts. Texts without words, null or empty, are alone. A
    row without an id is in the class of an equal multiset that has one, else in none (null). Texts with fewer words than a shingle are
    alike only if all their words are. Extra columns are not looked at; an empty table gives no rows.
    """
    signed = stash(sign(docs), "signed")
    nodes = stash(signed.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("node"), F.first("sig").alias("sig")), "nodes")
    named = nodes.where("node is not null")
    met = stash(buckets(named), "buckets")
    sets = stash(with_multisets(docs, named.join(met.select("node").distinct(), "node", "left_semi")), "multisets")
    leaders = met.groupBy("bucket").agg(F.min("node").alias("a"))
    star = met.join(leaders, "bucket").where("node <> a").select("a", F.col("node").alias("b")).distinct()
    # rows that share an id are linked by it
    same_id = signed.where("doc_id is not null").join(nodes, "key").where("doc_id <> node").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    twice = same_id.join(named.select(F.col("node").alias("b")), "b", "left_semi").select("a", "b")
    links = stash(compare_pairs(star, sets).unionByName(twice), "links")
    more = stash(full_comparison(met, near_classes(links), sets), "links")
    classes = components(links.unionByName(more))
    discard(met, sets, links, more)  # classes and what follows read nodes, signed and the last edges alone
    of_key = nodes.join(classes, "node", "left").select("key", F.coalesce("class", "node").alias("class"))
    return signed.join(of_key, "key", "left").select("doc_id", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class")).alias("class_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that name their class, and rows without an id, unchanged. Of several rows with one id, one stays."""
    found = stash(near_duplicates(docs), "classes").where("doc_id = class_id")
    named = found.groupBy("doc_id").agg(F.count("*").alias("n"))
    kept = docs.join(named.select("doc_id"), "doc_id", "left_semi")
    if not named.where("n > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id"])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.where("doc_id is null"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
