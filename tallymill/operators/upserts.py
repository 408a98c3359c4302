"""Keyed changes of a table, expressed as the table that results."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def update_by_key(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """base with the columns of changes replaced where the key has a change that isn't null. changes has one row for each key."""
    new = [c for c in changes.columns if c not in keys]
    renamed = changes.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in new])
    return base.join(renamed, keys, "left").select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in new else F.col(c) for c in base.columns])


def insert_absent(base: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """base and those of the rows whose key it lacks."""
    return base.unionByName(rows.join(base.select(*keys), keys, "left_anti").select(*base.columns))


def upsert_counts(base: DataFrame, delta: DataFrame, keys: list[str], count: str, latest: str) -> DataFrame:
    """Both tables by key, with counts added up and the other columns of the latest row."""
    rest = [c for c in base.columns if c not in keys and c != count]
    both = base.unionByName(delta.select(*base.columns))
    grouped = both.groupBy(*keys).agg(F.sum(count).alias(count), F.max_by(F.struct(*rest), F.col(latest)).alias("_last"))
    return grouped.select(*[F.col(f"_last.{c}").alias(c) if c in rest else F.col(c) for c in base.columns])


def replace_groups(base: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """base with all rows of the groups that rows has replaced by these."""
    return base.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows.select(*base.columns))
