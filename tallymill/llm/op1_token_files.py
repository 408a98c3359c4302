"""Token-ID output: files of separately compressed documents with a shared dictionary.

A file set is a folder with three Parquet tables:

* ``dictionary``: one row, the zstandard dictionary and its SHA-256;
* ``blocks``: rows of about a megabyte in document order. A payload holds its own offset index, so one document is read by
  finding its block (the row-group statistics of ``first_doc`` and ``last_doc``), slicing, and decompressing only its frame;
* ``offsets``: the number of ids before each run of blocks, so that a document's place in the whole stream is known.

Payload: ``TKB1``, 32 bytes of dictionary hash, u32 count, u8 bytes per id, then per document i64 id, u8 id present, u32 tokens,
u64 end offset of its frame, then the frames.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tallymill.llm.common import new_path, table
from tallymill.llm.memo import Recent

END_ID = 2
MAGIC = b"TKB1"
#: The dictionary is fitted on about this many documents, chosen by a hash of the id, and has at most this many bytes.
DICTIONARY_DOCS, DICTIONARY_BYTES = 2000, 64 * 1024
#: Of a document's ids so many bytes are looked at when the dictionary is fitted.
SAMPLE_BYTES = 64 * 1024
BLOCK_BYTES, BLOCK_DOCS = 1 << 20, 2048

_INDEX = np.dtype([("doc", "<i8"), ("has", "u1"), ("tokens", "<u4"), ("end", "<u8")])
_encoders: dict[tuple[str, bool], _Words] = {}
#: The normalizer and pre-tokenizer under which a text's ids are those of its words.
KNOWN = (
    r'''{"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}''',
    r'''{"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": true}, {"type": "ByteLevel", "add_prefix_space": false, "trim_offsets": true, "use_regex": false}]}''',
)
#: Letters of Latin-1 in lower case, its numbers and its white space. Its texts are their own normal form, and a letter's lower case is in it too.
_LETTERS, _NUMBERS, _BLANKS = r"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\x09-\x0d\x20\x85\xa0"
_latin = re.compile(r"[\x00-\xff]*").fullmatch
#: The pre-tokens of a lower-case text of Latin-1 under the KNOWN pre-tokenizer.
_pieces = re.compile(rf"[{_LETTERS}]+|'(?:[stmd]|re|ve|ll)|[{_NUMBERS}]|[^{_BLANKS}{_LETTERS}{_NUMBERS}]+").findall
_letters = re.compile(rf"[{_LETTERS}]+").fullmatch
#: A plain word: letters whose normal form and lower case are simple, then marks, which make a pre-token of their own.
_plain = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)([.,;:!?]*)").fullmatch
#: An added token that a plain word or a run of marks could hold, or that holds white space, is not found word by word.
_inside_plain = re.compile(r"[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]*[.,;:!?]*|.*\s.*", re.S).fullmatch


class _Words:
    """Word -> its ids as little-endian u32, by the tokenizers library. No pre-token of the tokenizer holds white space and it keeps no context, so a text's ids are those of its words in order.

    A text of Latin-1 without added tokens is cut into its pre-tokens at once, of which those of letters go to the library's model. In other texts
    the two pre-tokens of a plain word do; any other word passes its whole chain. All this holds for a tokenizer
    whose normalizer and pre-tokenizer are the KNOWN ones; with others, texts are encoded as a whole (``by_word`` is false).
    """

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        parts = json.loads(self.tokenizer.to_str())
        added = [t["content"] for t in parts["added_tokens"]]
        self.added = [unicodedata.normalize("NFC", a).lower() for a in added]
        self.by_word = [parts["normalizer"], parts["pre_tokenizer"]] == [json.loads(k) for k in KNOWN] and not any(map(_inside_plain, added))
        self.model, self.found = self.tokenizer.model, Recent(self.find)
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        signs = {b: level.pre_tokenize_str(chr(b))[0][0] for b in range(0x21, 0x7F)}
        signs |= {b: level.pre_tokenize_str(bytes([0xC3, b]).decode())[0][0][1] for b in range(0x80, 0xC0)}
        self.signs = str.maketrans({chr(b): c for b, c in signs.items()} | {"\xc3": level.pre_tokenize_str("\u00e0")[0][0][0]})

    def chain(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def find(self, word: str) -> bytes:
        """Ids of a pre-token or of a word."""
        if word.isascii() and _letters(word):
            return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()
        if not (plain := _plain(word)):
            return self.chain(word)
        letters, marks = plain.groups()
        if marks or letters != letters.lower():
            return self.found[letters.lower()] + (self.found[marks] if marks else b"")
        return array("I", [t.id for t in self.model.tokenize(letters.encode().decode("latin-1").translate(self.signs))]).tobytes()

    def text(self, text: str) -> bytes:
        if not self.by_word:
            return self.chain(text)
        ids = self.found.__getitem__
        if _latin(text):
            low = text.lower()
            if not any(a in low for a in self.added):
                return b"".join(map(ids, _pieces(low)))
        return b"".join(map(ids, split_words(text)))


def _encoder(path: str, special_as_text: bool) -> _Words:
    """One for each Python worker."""
    if (path, special_as_text) not in _encoders:
        _encoders[path, special_as_text] = _Words(path, special_as_text)
    return _encoders[path, special_as_text]


def split_words(text: str) -> list[str]:
    """The runs between ASCII white space, empty ones included."""
    for blank in "\t\n\x0b\x0c\r":
        if blank in text:
            text = text.replace(blank, " ")
    return text.split(" ")


def encode_texts(texts: list[str], path: str, special_as_text: bool = False) -> list[bytes]:
    """Ids of each text as little-endian u32. As in the library, the strings of special tokens give their ids, unless they are to count as ordinary text."""
    return list(map(_encoder(path, special_as_text).text, texts))


def _sliced(batch: pa.RecordBatch, rows: int = 100) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def encode(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", special_as_text: bool = False) -> DataFrame:
    """(doc_id, ids as little-endian u32 bytes with the end id), a row for each row, repeated or not. A null text is empty and has the end id alone; an empty table gives no rows; other columns are not looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = struct.pack("<I", end_id)
        for batch in (s for b in batches for s in _sliced(b)):
            ids = [x + end for x in encode_texts(batch.column(1).to_pylist(), tokenizer_path, special_as_text)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary")


def fit_dictionary(docs: DataFrame, tokenizer_path: str, width: int, special_as_text: bool = False, docs_wanted: int = DICTIONARY_DOCS, most_bytes: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary from the id arrays of about ``docs_wanted`` documents, of each at most SAMPLE_BYTES and of equal ones one; few or tiny ones give a plain-content dictionary, none an empty one."""
    import zstandard

    share = min(1.0, docs_wanted / max(1, docs.count()))
    chosen = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) <= int(share * (1 << 30)))
    heads = encode(chosen, tokenizer_path, special_as_text=special_as_text).select(F.substring("ids", 1, SAMPLE_BYTES).alias("ids")).distinct()
    arrays = sorted(_narrow(r.ids, width) for r in heads.collect())
    try:
        return zstandard.train_dictionary(most_bytes, arrays, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(arrays)[-most_bytes:]


def _narrow(ids: bytes, width: int) -> bytes:
    return np.frombuffer(ids, "<u4").astype("<u2").tobytes() if width == 2 else ids


def _packer(tokenizer_path: str, end_id: int, dictionary: bytes, width: int, special_as_text: bool):
    digest = hashlib.sha256(dictionary).digest()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        part, end = TaskContext.get().partitionId(), struct.pack("<I", end_id)
        given = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        for held in given.values():
            held.precompute_compress(level=3)
        squeeze = zstandard.ZstdCompressor(**{} if given else {"level": 3}, write_content_size=True, write_checksum=False, write_dict_id=False, **given)
        number = before = held = tokens = 0
        index, frames = [], []

        def block() -> pa.RecordBatch:
            entries = np.array(index, _INDEX)
            payload = MAGIC + digest + struct.pack("<IB", len(index), width) + entries.tobytes() + b"".join(frames)
            known = entries["doc"][entries["has"] == 1]
            row = {"part": part, "block": number, "first_doc": int(known[0]) if len(known) else None, "last_doc": int(known[-1]) if len(known) else None, "n_docs": len(index), "before": before, "n_tokens": tokens, "payload": payload}
            return pa.RecordBatch.from_pylist([row], schema=_BLOCK_ARROW)

        for batch in (s for b in batches for s in _sliced(b)):
            for doc, ids in zip(batch.column(0).to_pylist(), encode_texts(batch.column(1).to_pylist(), tokenizer_path, special_as_text), strict=True):
                ids += end
                frame = squeeze.compress(_narrow(ids, width))
                held += len(frame)
                tokens += len(ids) // 4
                frames.append(frame)
                index.append((doc or 0, doc is not None, len(ids) // 4, held))
                if held >= BLOCK_BYTES or len(index) >= BLOCK_DOCS:
                    yield block()
                    number, before, held, tokens, index, frames = number + 1, before + tokens, 0, 0, [], []
        if index:
            yield block()

    return pack


_BLOCK_SCHEMA = "part int, block int, first_doc long, last_doc long, n_docs int, before long, n_tokens long, payload binary"
_BLOCK_ARROW = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("n_docs", pa.int32()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("payload", pa.binary())])


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", special_as_text: bool = False) -> None:
    """Writes the file set for all documents in ascending id order (null ids first, then ties by text). Other columns are not looked at. An empty table gives an empty file set. special_as_text: a text that spells a special token is ordinary text; the library's own rule, and the default, is to give that token's id."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    width = 2 if max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    dictionary = fit_dictionary(rows, tokenizer_path, width, special_as_text)
    spark.createDataFrame([(bytearray(dictionary), hashlib.sha256(dictionary).hexdigest())], "dictionary binary, sha256 string").coalesce(1).write.parquet(f"{path}/dictionary")
    # the second key spreads the rows of one repeated id
    laid = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    laid.mapInArrow(_packer(tokenizer_path, end_id, dictionary, width, special_as_text), _BLOCK_SCHEMA).write.option("compression", "none").parquet(f"{path}/blocks")
    sums = spark.read.schema(_BLOCK_SCHEMA).parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # one row for each partition of the writing job, so this window is short at any size
    before = F.sum("n").over(Window.orderBy("part")) - F.col("n")
    sums.select("part", before.alias("part_start")).coalesce(1).write.parquet(f"{path}/offsets")


def _open(payload: bytes, decompressors: dict, dictionary: bytes, sha: bytes) -> Iterator[tuple[int | None, bytes]]:
    import zstandard

    if payload[:4] != MAGIC or payload[4:36] != sha:
        raise ValueError("not a block of this file set")
    count, width = struct.unpack_from("<IB", payload, 36)
    if not decompressors:
        given = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        decompressors[0] = zstandard.ZstdDecompressor(**given)
    index = np.frombuffer(payload, _INDEX, count, 41)
    at = body = 41 + count * _INDEX.itemsize
    for doc, has, _, end in index.tolist():
        ids = decompressors[0].decompress(payload[at : body + end])
        yield doc if has else None, np.frombuffer(ids, "<u2").astype("<u4").tobytes() if width == 2 else ids
        at = body + end


def read_token_files(spark: SparkSession, path: str, first_doc: int | None = None, last_doc: int | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids as little-endian u32 bytes) of all documents, or of those in a range of ids, for which only blocks that can hold them are read."""
    held = spark.read.parquet(f"{path}/dictionary").first()
    dictionary, sha = bytes(held.dictionary), bytes.fromhex(held.sha256)
    blocks = spark.read.schema(_BLOCK_SCHEMA).parquet(f"{path}/blocks")
    if first_doc is not None:
        blocks = blocks.where(F.col("last_doc") >= first_doc)
    if last_doc is not None:
        blocks = blocks.where(F.col("first_doc") <= last_doc)
    offsets = spark.read.parquet(f"{path}/offsets")
    rows = blocks.join(offsets, "part").select((F.col("part_start") + F.col("before")).alias("start"), "payload")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools: dict = {}
        for batch in batches:
            for i in range(batch.num_rows):
                start, out = batch.column(0)[i].as_py(), ([], [], [], [])
                for doc, ids in _open(batch.column(1)[i].as_py(), tools, dictionary, sha):
                    for column, value in zip(out, (doc, start, len(ids) // 4, ids), strict=True):
                        column.append(value)
                    start += len(ids) // 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "start", "n_tokens", "ids"])

    out = rows.mapInArrow(unpack, "doc_id long, start long, n_tokens long, ids binary")
    if first_doc is not None:
        out = out.where(F.col("doc_id") >= first_doc)
    return out if last_doc is None else out.where(F.col("doc_id") <= last_doc)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
