"""From raw documents to token counts of a training mix: toxicity, quality, near-duplicates, mixing, encoding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallymill.llm import op2_quality, op4_toxicity, op5_mixing, op7_bagminhash, op9_bpe
from tallymill.llm.common import discard, for_texts, scratch, stash, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


@for_texts
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels, doesn't call toxic."""
    return op4_toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


@for_texts
def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are not unusual for their language and source."""
    return op2_quality.keep_good(docs)


@for_texts
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each class."""
    return op7_bagminhash.keep_one(docs)


@for_texts
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return op5_mixing.repeat_rows(docs)


@for_texts
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row of the mix."""
    import public_tokenizers

    return op9_bpe.digest(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: A learned classifier and signatures stand in the way of SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are written to the shared folder and read again by the next, and what only the stage before needed is deleted.

    A stage gives rows for whatever it gets: null and empty texts fail the quality rules, rows without an id stay with their texts, repeated
    rows are one document, other columns pass through, and empty tables give no rows.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            kept = stage(spark, docs, sf_dir)
            written = stash(kept, name, keep=True)
        if before is not None:
            discard(before)
        docs = before = written
    return STAGES[-1][1](spark, docs, sf_dir)
