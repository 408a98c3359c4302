"""Keyed writes of a stored table: rows appended, a document's rows replaced, a status set where it is what it should be.

A table is a folder of Parquet files, parted by a bucket of its key. A change reads and writes the buckets that its keys fall into and no
others. It is put together in a table of its own first and then takes the place of those buckets at once, so a change that stops half-way leaves the old rows,
and one that runs again ends in the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallymill.sources.files import drop, stored

BUCKET = "bucket"


def _bucketed(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    return rows.withColumn(BUCKET, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def create(rows: DataFrame, path: str, key: str, buckets: int) -> None:
    _bucketed(rows, key, buckets).repartition(BUCKET).write.partitionBy(BUCKET).parquet(path)


def append(rows: DataFrame, path: str, key: str, buckets: int) -> None:
    _bucketed(rows, key, buckets).repartition(BUCKET).write.mode("append").partitionBy(BUCKET).parquet(path)


def rows_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(BUCKET)


def _put(whole: DataFrame, path: str, touched: list[int]) -> None:
    """Makes these rows (with their bucket) the rows of the touched buckets."""
    spark = whole.sparkSession
    ready = stored(whole, "change")
    filled = {r[BUCKET] for r in ready.select(BUCKET).distinct().collect()}
    ready.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    for b in set(touched) - filled:  # nothing is left there
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{BUCKET}={b}")
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    drop(ready)


def replace(rows: DataFrame, path: str, key: str, buckets: int, keys: DataFrame | None = None) -> None:
    """Deletes what the table has of the keys (by default those that rows has) and inserts the rows."""
    spark = rows.sparkSession
    gone = _bucketed((rows if keys is None else keys).select(key).distinct(), key, buckets)
    touched = [r[BUCKET] for r in gone.select(BUCKET).distinct().collect()]
    old = spark.read.parquet(path).where(F.col(BUCKET).isin(touched))
    _put(old.join(gone.select(key), key, "left_anti").select(old.columns).unionByName(_bucketed(rows, key, buckets).select(old.columns)), path, touched)


def compare_and_set(spark: SparkSession, path: str, condition: Column, column: str, value: Column) -> int:
    """Sets a column of the rows for which the condition holds and says how many there were; none means that another was first, and nothing is written."""
    table = spark.read.parquet(path)
    hit = table.where(condition).groupBy(BUCKET).count().collect()
    if hit:
        touched = [r[BUCKET] for r in hit]
        _put(table.where(F.col(BUCKET).isin(touched)).withColumn(column, F.when(condition, value).otherwise(F.col(column))), path, touched)
    return sum(r["count"] for r in hit)
