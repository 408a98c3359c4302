"""Files in the folder that driver and executors share, and the sinks that write there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. A local session, whose executors are the driver, gets one where it has none; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = held.get() if held.isDefined() else tempfile.mkdtemp(prefix="tallymill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tallymill/{label}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, label: str) -> DataFrame:
    """The rows, written as a table in the shared folder and read from there: what follows starts from files that outlive a lost executor, and sees one and the same rows however often it reads them."""
    path = new_path(rows.sparkSession, label)
    rows.write.parquet(path)
    out = rows.sparkSession.read.schema(rows.schema).parquet(path)
    out.stored_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes stored tables that no plan reads any more."""
    for rows in tables:
        spark = rows.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(rows.stored_at)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def clean(spark: SparkSession) -> None:
    """Deletes all that queries of this package have written to the shared folder: for when none of their results will be read again."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tallymill")
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def write_csv(rows: DataFrame, fields: list[str], path: str) -> StructType:
    """Writes these fields in this order, with a header; other columns are left out, fields that rows lack are empty. Returns the schema to read with."""
    out = rows.select(*[F.col(f) if f in rows.columns else F.lit(None).cast("string").alias(f) for f in fields])
    out.write.option("header", True).option("escape", '"').option("emptyValue", '""').csv(path)
    return out.schema


def read_csv(spark: SparkSession, schema: StructType, path: str) -> DataFrame:
    """The rows of a file set with a header; null and empty text stay apart."""
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).option("emptyValue", "").csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    """A line of JSON for each row, with its nulls."""
    rows.write.option("ignoreNullFields", False).json(path)
