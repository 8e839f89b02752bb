"""Labelled rows for the two classifiers: folds by a checksum of the id, and a bounded sample of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as an empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds).cast("int")


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, most: int) -> DataFrame:
    """doc_id, text, label of at most ``most`` labelled documents outside the held-out fold, chosen by a hash of the id.

    Of rows that repeat an id, the largest label and the smallest text count. The chosen ids are broadcast: they are
    at most ``most`` pairs of numbers. Null ids and labels are left out; a null text is an empty one.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold(F.col("doc_id"), folds) != held_out))
    once = known.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    chosen = once.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()
    pairs = docs.sparkSession.createDataFrame([(int(r.doc_id), int(r.label)) for r in chosen], "doc_id long, label int")
    found = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(pairs), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
