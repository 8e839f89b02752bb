"""Sharding by jump consistent hashing.

A row's shard follows from its key and the number of shards alone, without a ring table; when one shard is
appended, rows move only into it. Numbering the rows of a shard is done in two levels, so a shard is never
gathered into one task: rows are counted by (shard, chunk), chunk offsets are summed over that small table, and
rows are ranked inside a chunk only.

Defined cases: a null key hashes as Spark's ``xxhash64(NULL)`` does, so all null keys share a shard. Repeated
rows are placed alike and get slots of their own, neighbouring or not. An empty table gives an empty result. Other columns pass
through; an input column named like an output is replaced by the output.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm._common import fresh, shuffle_partitions, written

#: Fixed value: the multiplier of the 64-bit generator in the published jump hash algorithm.
_STEP = np.uint64(2862933555777941757)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash of 64-bit keys, all keys of the batch advancing together."""
    state = keys.astype(np.uint64, copy=True)
    at = np.zeros(len(state), np.int64)
    ahead = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    with np.errstate(over="ignore"):
        while len(live):
            at[live] = ahead[live]
            s = state[live] * _STEP + np.uint64(1)
            state[live] = s
            jump = (at[live] + 1) * (float(1 << 31) / ((s >> np.uint64(33)).astype(np.float64) + 1.0))
            ahead[live] = jump.astype(np.int64)
            live = live[ahead[live] < shards]
    return at.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a key column of any hashable type; only 8 bytes a row go to Python."""
    if shards < 1:
        raise ValueError("shards must be at least 1")

    @F.pandas_udf("int")
    def jump(h: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(h.to_numpy().astype(np.int64).view(np.uint64), shards))

    return jump(F.xxhash64(key))


def assign_shards(df: DataFrame, key: str, shards: int, grown: bool = False) -> DataFrame:
    """Adds ``shard`` and, if asked for, ``grown_shard``: where the row is with one shard more."""
    df = df.withColumn("shard", shard_of(F.col(key), shards))
    return df.withColumn("grown_shard", shard_of(F.col(key), shards + 1)) if grown else df


def number_slots(df: DataFrame, order: list[str], shard: str = "shard", chunks: int | None = None) -> DataFrame:
    """Adds ``slot``, gapless from 0 in each shard.

    ``chunks`` parts of each shard are ranked apart; their number grows with the shuffle partitions, so a chunk stays as
    small as a partition. A row's chunk is a hash of all order columns and of its place in the input, so that no
    key and no rows repeated however often make a large one; the table, which should be narrow, is written once
    with it, since both passes must see the same chunks. The offsets have shards x chunks rows at most, and Spark
    chooses how to join them. Inside a chunk rows follow the order columns.
    """
    chunk, at, n, rank, before = (fresh(df, x, shard) for x in ("chunk", "at", "n", "rank", "before"))
    chunks = chunks or 2 * shuffle_partitions(df.sparkSession)
    salt = F.xxhash64(F.lit("slot"), *(F.col(c) for c in order), F.col(at))
    placed = df.withColumn(at, F.monotonically_increasing_id()).withColumn(chunk, F.pmod(salt, F.lit(chunks)).cast("int"))
    parts = written(placed, "slots")
    counts = parts.groupBy(shard, chunk).agg(F.count(F.lit(1)).alias(n))
    ahead = Window.partitionBy(shard).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(shard, chunk, F.coalesce(F.sum(n).over(ahead), F.lit(0)).alias(before))
    inside = Window.partitionBy(shard, chunk).orderBy(*order, at)
    joined = parts.withColumn(rank, F.row_number().over(inside)).join(offsets, [shard, chunk], "left")
    kept = [c for c in df.columns if c.lower() != "slot"]
    return joined.select(*kept, (F.col(before) + F.col(rank) - 1).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law ``key``, shard, slot, grown_shard of all documents.

    size is the text's UTF-8 bytes (null: none) plus 8; a null text has the checksum of an empty one. The text is
    read, measured and left behind in the scan: only numbers are shuffled.
    """
    raw = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    out = number_slots(assign_shards(rows, "doc_id", shards, grown=True), ["doc_id", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
