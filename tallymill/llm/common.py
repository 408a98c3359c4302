"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DataType, StructField, StructType

from tallymill.sources.files import new_path

#: Rows and bytes of an Arrow batch: whole texts can be long, so batches stay short.
ARROW_ROWS, ARROW_BYTES = 1000, "8m"

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark: SparkSession) -> None:
    """Arrow batches for whole texts, for all of the session: an application's choice, which no operator makes."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def for_texts(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A query that sets short batches for its session first."""

    @wraps(query)
    def run(spark: SparkSession, *given) -> DataFrame:
        short_batches(spark)
        return query(spark, *given)

    return run


def sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many; what is held for a batch stays small."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def with_fields(schema: StructType, added: dict[str, DataType]) -> StructType:
    """A schema with more fields; names may hold any sign."""
    return StructType([StructField(f.name, f.dataType) for f in schema] + [StructField(n, t) for n, t in added.items()])


_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is stashed inside is deleted at the end: only for results that have been written by then."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            _delete(spark, path)


def stash(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Writes the rows as a table in the shared folder and reads them from there: what follows starts from files that outlive a lost executor. keep: also beyond a scratch around it."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    if _scratch and not keep:
        _scratch[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stashed_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def discard(*tables: DataFrame) -> None:
    """Deletes stashed tables that no plan reads any more."""
    for df in tables:
        _delete(df.sparkSession, df.stashed_at)


def n_words(text: str | Column) -> Column:
    """Words of a text; null has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
