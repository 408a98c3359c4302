"""Byte-level BPE encoding and decoding with two tiers of look-up.

A text is cut by the tokenizer's pattern. A minimal perfect hash over the vocabulary resolves the pieces that are tokens as they stand;
the others are merged, lowest rank first and leftmost among equals, with a heap over a linked list of byte runs.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType

from tallymill.llm.common import sliced, table, with_fields
from tallymill.llm.memo import Memo


#: Fixed value: the pattern for which stretches between spaces, and Latin words with marks after them, can be cut without it.
KNOWN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PerfectHash:
    """A minimal perfect hash: each key has a slot of its own among as many slots as there are keys (hash and displace).

    Keys fall into buckets by a 64-bit hash. From the fullest bucket on, each gets the first displacement that sends its keys to free
    slots; a bucket of one key points straight at one of the slots left over. A slot keeps its key, so that a look-up tells keys from
    strangers.
    """

    def __init__(self, keys: list[bytes], values: list[int], load: int = 3):
        self.n, self.buckets = len(keys), max(1, len(keys) // load)
        hashes = self.hashes(keys).tolist()
        if len(set(hashes)) < self.n:
            raise ValueError("two keys are equal or share a 64-bit hash")
        groups: dict[int, list[int]] = {}
        for i, h in enumerate(hashes):
            groups.setdefault(h % self.buckets, []).append(i)
        self.keys, self.values, taken = [b""] * self.n, [0] * self.n, bytearray(self.n)
        shift = [0] * self.buckets
        free = iter(range(self.n))
        for bucket, own in sorted(groups.items(), key=lambda g: -len(g[1])):
            d, slots = 0, []
            if len(own) == 1:
                slots = [next(s for s in free if not taken[s])]
                shift[bucket] = -1 - slots[0]
            while len(slots) < len(own):
                d += 1
                slots = []
                for i in own:
                    slot = self._slot(hashes[i], d)
                    if taken[slot] or slot in slots:
                        break
                    slots.append(slot)
                shift[bucket] = d
            for i, slot in zip(own, slots, strict=True):
                taken[slot], self.keys[slot], self.values[slot] = 1, keys[i], values[i]
        self.shift = np.array(shift, np.int64)

    def _slot(self, h: int, d: int) -> int:
        mixed = (h ^ d * 0x9E3779B97F4A7C15) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
        return (mixed ^ mixed >> 29) % self.n

    @staticmethod
    def hashes(keys: list[bytes]) -> np.ndarray:
        from xxhash import xxh3_64_intdigest

        return np.fromiter(map(xxh3_64_intdigest, keys), np.uint64, len(keys))

    def find(self, keys: list[bytes]) -> list[int]:
        """The value of each key, -1 for strangers."""
        if not keys or not self.n:
            return [-1] * len(keys)
        hashes = self.hashes(keys)
        shift = self.shift[(hashes % np.uint64(self.buckets)).astype(np.int64)]
        mixed = (hashes ^ shift.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        slots = np.where(shift < 0, -1 - shift, ((mixed ^ mixed >> np.uint64(29)) % np.uint64(self.n)).astype(np.int64)).tolist()
        return [self.values[s] if self.keys[s] == k else -1 for s, k in zip(slots, keys, strict=True)]


def pair_ranks(ranks: dict[bytes, int]) -> list[dict[int, int]]:
    """By left rank: right rank -> rank of the token that both make, for every way to part a token into two."""
    get, out = ranks.get, [{} for _ in range(max(ranks.values(), default=-1) + 1)]
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            if (left := get(token[:i])) is not None and (right := get(token[i:])) is not None:
                out[left][right] = rank
    return out


def merge(ids: list[int], pairs: list[dict[int, int]]) -> list[int]:
    """BPE of one piece, given as the ranks of its bytes: a heap of candidate merges (rank, place) over a doubly linked list of byte runs. A run goes by the rank of its token; merged ones become -1."""
    n = len(ids)
    bits = n.bit_length()
    mask = (1 << bits) - 1
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    rows = [pairs[a] for a in ids]  # of a run: what it makes with a next one
    best = [row.get(b, -1) for row, b in zip(rows, ids[1:], strict=False)]  # what it makes with the one that stands there
    best.append(-1)
    heap = [rank << bits | i for i, rank in enumerate(best) if rank >= 0]
    heapify(heap)
    while heap:
        key = heappop(heap)
        i, rank = key & mask, key >> bits
        if best[i] != rank:
            continue  # the run or its neighbour has changed since
        j = after[i]
        ids[i], ids[j], best[j] = rank, -1, -1
        row = rows[i] = pairs[rank]
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            best[i] = made = row.get(ids[k], -1)
            if made >= 0:
                heappush(heap, made << bits | i)
        else:
            best[i] = -1
        k = before[i]
        if k >= 0:
            best[k] = made = rows[k].get(rank, -1)
            if made >= 0:
                heappush(heap, made << bits | k)
    return [x for x in ids if x >= 0]


class Coder:
    """Encodes with a rank file and a pattern."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex

        self.ranks = read_ranks(ranks_path)
        self.pieces = regex.compile(pattern).findall
        self.whole = PerfectHash(list(self.ranks), list(self.ranks.values()))
        self.pairs = pair_ranks(self.ranks)
        self.byte = [self.ranks[bytes([b])] for b in range(256)]
        self.known = Memo(self._merge_pieces, 300_000)
        self.memo = Memo(self._fill, 300_000)
        #: the shortcuts below hold for this pattern alone
        self.is_known = pattern == KNOWN_PATTERN
        self.plain = re.compile("( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?]*)").fullmatch
        self.odd_blank = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search

    def _merge_pieces(self, pieces: list[str]) -> list[bytes]:
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        byte, pairs = self.byte, self.pairs
        return [array("i", [rank] if rank >= 0 else merge([byte[b] for b in key], pairs)).tobytes() if key else b"" for key, rank in zip(raw, self.whole.find(raw), strict=True)]

    def _fill(self, stretches: list[str]) -> list[bytes]:
        if not self.is_known:  # what comes here are pieces already
            self.known.learn(set(stretches))
            return [self.known[s] for s in stretches]
        plain, pieces = self.plain, self.pieces
        # letters of Latin alphabets after a space, with marks after them, are cut without the pattern
        found = [m.groups() if (m := plain(s)) else pieces(s) for s in stretches]
        self.known.learn(set().union(*found))
        known = self.known
        return [known[f[0]] + known[f[1]] if len(f) == 2 else known.join(f) for f in found]

    def stretches(self, text: str) -> list[str]:
        """Parts of a text whose pieces together are those of the text: where one space parts two other characters, the pattern never looks back across it. A text with a space beside other white space, or with rare white space, is cut by the pattern itself."""
        first, *rest = text.split(" ")
        if not first or "" in rest or " \n" in text or "\n " in text or self.odd_blank(text):
            return self.pieces(text)
        return [first, *[" " + r for r in rest]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as native 32-bit integers."""
        parts = [self.stretches(t) if self.is_known else self.pieces(t) for t in texts]
        self.memo.learn(set().union(*parts))
        return [self.memo.join(p) for p in parts]


_coders: dict[tuple[str, str], Coder] = {}
_tokens: dict[str, pa.Array] = {}


def _coder(ranks_path: str, pattern: str) -> Coder:
    """One for each Python worker."""
    if (ranks_path, pattern) not in _coders:
        _coders[ranks_path, pattern] = Coder(ranks_path, pattern)
    return _coders[ranks_path, pattern]


def _lists(rows: list[bytes]) -> pa.Array:
    flat = np.frombuffer(b"".join(rows), np.int32)
    ends = np.cumsum([0, *[len(r) // 4 for r in rows]])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


def _encoded(batches: Iterator[pa.RecordBatch], ranks_path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """(doc_id, ids) of batches of (doc_id, text)."""
    coder = _coder(ranks_path, pattern)
    for part in sliced(batches, 100):
        yield pa.RecordBatch.from_arrays([part.column(0), _lists(coder.encode(part.column(1).to_pylist()))], ["doc_id", "ids"])


def _decoded(batches: Iterator[pa.RecordBatch], ranks_path: str) -> Iterator[pa.RecordBatch]:
    """Adds decoded to batches that hold ids."""
    if ranks_path not in _tokens:
        ranks = read_ranks(ranks_path)
        table_of = [None] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            table_of[rank] = token
        _tokens[ranks_path] = pa.array(table_of, pa.binary())
    tokens = _tokens[ranks_path]
    for part in sliced(batches, 200):
        lists = part.column("ids")
        taken = tokens.take(lists.flatten())
        if taken.null_count:
            raise ValueError("an id is not in the vocabulary")
        # the bytes of the taken tokens lie one after another: texts are stretches of them
        sizes = np.cumsum([0, *pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_pylist()])
        ends = np.frombuffer(taken.buffers()[1], np.int32)[sizes] if len(taken) else np.zeros(len(sizes), np.int32)
        decoded = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(np.ascontiguousarray(ends)), taken.buffers()[2]])
        if lists.null_count:
            decoded = pa.compute.if_else(pa.compute.is_null(lists), pa.scalar(None, pa.binary()), decoded)
        yield pa.RecordBatch.from_arrays([*part.columns, decoded], [*part.schema.names, "decoded"])


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>), a row for each row: repeated rows and null ids stay as they are, null and empty texts have no ids, an empty table gives no rows, and other columns are not looked at."""
    rows = _texts(docs, id_col, text_col)
    return rows.mapInArrow(lambda batches: _encoded(batches, ranks_path, pattern), with_fields(rows.schema[:1], {"ids": ArrayType(IntegerType())}))


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Adds ``decoded``, the bytes that the ids stand for; an id that the vocabulary lacks is an error, a null list gives null."""
    return encoded.mapInArrow(lambda batches: _decoded(batches, ranks_path), with_fields(encoded.schema, {"decoded": BinaryType()}))


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What ``encode`` and then ``decode`` give, in one pass: a task has one Python worker, not two, and so one copy of the vocabulary."""
    rows = _texts(docs, id_col, text_col)
    return rows.mapInArrow(lambda batches: _decoded(_encoded(batches, ranks_path, pattern), ranks_path), with_fields(rows.schema[:1], {"ids": ArrayType(IntegerType()), "decoded": BinaryType()}))


def digest(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row; of a null or empty text both are the digest of nothing."""
    coded = round_trip(docs, ranks_path, pattern)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
