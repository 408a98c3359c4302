"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallymill.llm import op1_token_files, op2_quality, op3_topk, op4_toxicity, op5_mixing, op6_chat, op7_bagminhash, op8_token_counts, op9_bpe, op10_html, op11_nra, op12_phrases, op13_pca_tiles
from tallymill.llm.common import for_texts

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {
    "op1_token_files": op1_token_files.query,
    "op2_quality": op2_quality.query,
    "op3_topk": op3_topk.query,
    "op4_toxicity": op4_toxicity.query,
    "op5_mixing": op5_mixing.query,
    "op6_chat": op6_chat.query,
    "op7_bagminhash": op7_bagminhash.query,
    "op8_token_counts": op8_token_counts.query,
    "op9_bpe": op9_bpe.query,
    "op10_html": op10_html.query,
    "op11_nra": op11_nra.query,
    "op12_phrases": op12_phrases.query,
    "op13_pca_tiles": op13_pca_tiles.query,
}

QUERIES: dict[str, Query] = {name: for_texts(query) for name, query in _QUERIES.items()}
ORACLES: dict[str, str] = {"op2_quality": op2_quality.SQL, "op3_topk": op3_topk.SQL, "op5_mixing": op5_mixing.SQL, "op6_chat": op6_chat.SQL, "op11_nra": op11_nra.SQL, "op12_phrases": op12_phrases.SQL, "op13_pca_tiles": op13_pca_tiles.SQL}
