"""Lookups between tables: references resolved, keys inherited, revisions and metadata merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolve(df: DataFrame, objects: DataFrame, on: Column, must: bool = False) -> DataFrame:
    """Follows one reference: dangling ones stay with nulls, or go if it must resolve. Spark picks the strategy by size."""
    return df.join(objects, on, "inner" if must else "left")


def unreferenced(df: DataFrame, users: DataFrame, on: Column) -> DataFrame:
    return df.join(users, on, "left_anti")


def listed(df: DataFrame, members: DataFrame, on: Column) -> DataFrame:
    return df.join(members, on, "left_semi")


def inherit(*levels: Column) -> Column:
    """The nearest of own, parent's, grandparent's … value."""
    return F.coalesce(*levels)


def merge_first(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Of each key, the first value that isn't null, by revision."""
    return df.groupBy(key).agg(F.min_by(F.col(value), F.when(F.col(value).isNotNull(), F.col(order))).alias(value))


def rebased_union(left: DataFrame, right: DataFrame, id_col: str) -> DataFrame:
    """Both tables, the ids of the right one moved past those of the left."""
    offset = left.agg((F.coalesce(F.max(id_col), F.lit(-1)) + 1).alias("_offset"))
    # one row
    moved = right.crossJoin(F.broadcast(offset)).withColumn(id_col, (F.col(id_col) + F.col("_offset")).cast(dict(left.dtypes)[id_col])).drop("_offset")
    return left.unionByName(moved)


def expand_ranges(df: DataFrame, low: Column, high: Column, out: str) -> DataFrame:
    """A row for each whole number from low to high, both included."""
    return df.withColumn(out, F.explode(F.sequence(low, high)))
