"""Token counts of a document's sections: the whole text is encoded once and its tokens are attributed by their places.

A byte-level token stands for a run of bytes, so the ends of all tokens follow from the lengths of their byte strings, and sections are
byte intervals of the same text. Tokens and sections are joined as intervals, both in order. A token that crosses a boundary goes by a
rule: ``most`` gives it to the section that holds most of its bytes, the first of them among equals; ``start`` to the section of its
first byte; ``share`` splits it by bytes. Counts of all sections of a document add up to its tokens under each rule.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallymill.llm.common import table
from tallymill.llm.op9_bpe import _coder as own_coder

#: The library's pattern engine stops with an error in runs of about a million white spaces. Texts with runs of this length are left to the heap encoder, which gives the same ids.
LONG_BLANKS = 500_000
_long_blanks = re.compile(rf"\s{{{LONG_BLANKS}}}").search

_coders: dict[tuple[str, str], tuple] = {}


def _coder(ranks_path: str, pattern: str) -> tuple:
    """The encoder and the byte length of each token, once for each Python worker."""
    if (ranks_path, pattern) not in _coders:
        import base64

        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        lengths[list(ranks.values())] = [len(t) for t in ranks]
        _coders[ranks_path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths
    return _coders[ranks_path, pattern]


def encoded(text: str, ranks_path: str, pattern: str) -> np.ndarray:
    """The ids of a text, however long it and its runs are."""
    if len(text) >= LONG_BLANKS and _long_blanks(text):
        return np.frombuffer(own_coder(ranks_path, pattern).encode([text])[0], np.int32)
    return np.asarray(_coder(ranks_path, pattern)[0].encode_ordinary(text), np.int64)


def attribute(ends: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each section under the rules most, start and share; ends: of all tokens in order; bounds: where sections begin, and the end of the text.

    Sections tile the text. Only a token that crosses a boundary is looked at by itself.
    """
    n = len(bounds) - 1
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    first = np.searchsorted(bounds, starts, "right") - 1
    last = np.searchsorted(bounds, ends, "left") - 1
    start = np.bincount(first, minlength=n)[:n]
    most, share = start.copy(), start.astype(np.float64)
    for t in np.flatnonzero(first != last).tolist():
        sections = np.arange(first[t], last[t] + 1)
        held = np.minimum(bounds[sections + 1], ends[t]) - np.maximum(bounds[sections], starts[t])
        most[first[t]] -= 1
        most[sections[held.argmax()]] += 1
        share[first[t]] -= 1
        share[sections] += held / held.sum()
    return most, start, share


def line_bounds(raw: bytes) -> np.ndarray:
    """Where the lines of a text begin, each with the line feed that ends it, and the end of the text."""
    breaks = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    inner = breaks[breaks < len(raw)]
    return np.concatenate([[0], inner, [len(raw)]]).astype(np.int64)


_COLUMNS = {"section": pa.int32(), "char_start": pa.int64(), "char_end": pa.int64(), "n_tokens": pa.int64(), "n_started": pa.int64(), "token_share": pa.float64()}


def count_sections(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, section, char_start, char_end, n_tokens, n_started, token_share) for each line of each row, in code points and by the three rules.

    A line holds the line feed that ends it. A null or empty text has one empty section without tokens. Repeated rows, and rows
    without an id, are counted each; an empty table gives no rows; other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _coder(ranks_path, pattern)[1]
        for batch in batches:
            for i in range(0, batch.num_rows, 100):
                part = batch.slice(i, 100)
                owner, out = [], {c: [] for c in _COLUMNS}
                for row, text in enumerate(part.column(1).to_pylist()):
                    raw = text.encode()
                    bounds = line_bounds(raw)
                    ends = np.cumsum(lengths[encoded(text, ranks_path, pattern)]) if raw else np.zeros(0, np.int64)
                    most, start, share = attribute(ends, bounds) if raw else (np.zeros(1, np.int64),) * 2 + (np.zeros(1),)
                    # code points begin at every byte but the continuations
                    chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])[bounds] if not text.isascii() else bounds
                    owner.append(np.full(len(bounds) - 1, row))
                    for name, values in zip(_COLUMNS, (np.arange(len(bounds) - 1), chars[:-1], chars[1:], most, start, share), strict=True):
                        out[name].append(values)
                columns = [pa.array(np.concatenate(out[c]), t, safe=False) for c, t in _COLUMNS.items()]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.concatenate(owner))), *columns], ["doc_id", *_COLUMNS])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, section int, char_start long, char_end long, n_tokens long, n_started long, token_share double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_sections(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
