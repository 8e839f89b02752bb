"""Ordered, stateful operators as windows: gaps, runs, depth, ordinals, siblings, latest revisions.

A window here is partitioned by a document-like key, so tasks grow with the number of keys. ``ordinal`` numbers
rows over a whole table, for which it counts ranges first instead of gathering all rows in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def over(key: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*key).orderBy(*order)


def running(spec: WindowSpec) -> WindowSpec:
    return spec.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def earlier(spec: WindowSpec) -> WindowSpec:
    return spec.rowsBetween(Window.unboundedPreceding, -1)


def entry_number(df: DataFrame, opens: Column, spec: WindowSpec, out: str = "entry") -> DataFrame:
    """Numbers entries from 1: a row that ``opens`` starts another."""
    return df.withColumn("_opens", F.when(opens, 1).otherwise(0)).withColumn(out, F.sum("_opens").over(running(spec)).cast("long")).drop("_opens")


def gap_class(gap: Column, space: float, hard: float) -> Column:
    """none, soft (a space lies between) or hard (an entry ends); first where nothing is before."""
    return F.when(gap.isNull(), "first").when(gap > hard, "hard").when(gap >= space, "soft").otherwise("none")


def pen_position(advance: Column, spec: WindowSpec) -> Column:
    """Sum of the advances before a row."""
    return F.coalesce(F.sum(advance).over(earlier(spec)), F.lit(0)).cast("long")


def depth(opens: Column, spec: WindowSpec) -> Column:
    """Nesting depth after a row that opens (+1) or closes (-1)."""
    return F.sum(F.when(opens, 1).otherwise(-1)).over(running(spec)).cast("long")


def runs(df: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """Consecutive rows of equal value: key, run, a, b (first and last order), v. Nulls are equal."""
    spec = over(key, [order])
    same = F.lag(value).over(spec).eqNullSafe(F.col(value)) & (F.row_number().over(spec) > 1)
    marked = df.withColumn("_ch", F.when(same, 0).otherwise(1)).withColumn("run", F.sum("_ch").over(running(spec)).cast("long"))
    return marked.groupBy(*key, "run").agg(F.min(order).alias("a"), F.max(order).alias("b"), F.min(value).alias("v"))


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The newest row of each key. Spark limits each partition before the shuffle."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rn = 1").drop("_rn")


def siblings(value: str, spec: WindowSpec) -> tuple[Column, Column]:
    return F.lag(value).over(spec), F.lead(value).over(spec)


def ordinal(df: DataFrame, order: str, out: str = "i", start: int = 0, ranges: int | None = None) -> DataFrame:
    """Numbers all rows by a whole-number order column, without gathering them.

    Rows are cut into ranges at quantiles; a range's rows are ranked inside it, and ranges are offset by the counts of
    those before, a table of one row for each range. Nulls come first.
    """
    spark = df.sparkSession
    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    low = F.coalesce(F.col(order).cast("long"), F.lit(-(1 << 63)))
    shares = F.array(*(F.lit(i / ranges) for i in range(1, ranges)))
    cuts = sorted(set(df.agg(F.percentile_approx(low, shares, 100 * ranges)).first()[0] or []))
    if len(cuts) < 64:
        part = F.size(F.filter(F.lit(cuts).cast("array<bigint>"), lambda c: c <= low))
    else:  # many cuts are searched, not compared one by one; only the order column goes to Python

        @F.arrow_udf("int")
        def search(keys: pa.Array) -> pa.Array:
            return pa.array(np.searchsorted(np.array(cuts, np.int64), keys.to_numpy(zero_copy_only=False), side="right").astype(np.int32))

        part = search(low)
    parts = df.withColumn("_part", part.cast("long"))
    counts = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    ranked = parts.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy(order)))
    # one row for each range: their number is fixed above
    joined = ranked.join(F.broadcast(before), F.col("_part") == F.col("_p"))
    return joined.withColumn(out, (F.col("_before") + F.col("_rank") - 1 + start).cast("long")).drop("_part", "_rank", "_p", "_before")


def blocks(df: DataFrame, key: str) -> DataFrame:
    """Contiguous blocks of whole numbers: first, cnt."""
    numbered = ordinal(df.select(key), key, "_i", start=1)
    return numbered.groupBy((F.col(key) - F.col("_i")).alias("_g")).agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("cnt")).drop("_g")
