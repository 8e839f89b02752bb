"""The corpus pipeline: documents in, encoded training text out.

Stages, each on all that its predecessor kept: the quality classifier (poor documents go), toxicity (toxic ones go), the
n-gram Jaccard join (one document of each near-duplicate group stays, that with the smallest id), mixing to the sources'
weights (documents are left out or repeated), and byte-level BPE. All but the last return the columns of documents.

Defined cases: null and empty texts are scored, joined, mixed and encoded as the operators say; a document with a null
id is linked with nothing and stays. Of rows that repeat the id that stays, one with each text stays. Rows may
repeat after mixing. An empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.llm import bpe, mixing, ngram_join, quality, toxicity
from leafmill.llm._common import fresh, written

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

#: Near duplicates: words of a shingle, and the least Jaccard similarity as a fraction.
WORDS, NUM, DEN = 5, 80, 100

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least the operator's threshold."""
    out = fresh(docs, "score")
    scored = quality.score(docs, quality.fit(docs, _labels(spark, sf_dir)), out=out)
    return scored.where(F.col(out) >= quality.THRESHOLD).select(*docs.columns)


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the operator's threshold."""
    out = fresh(docs, "score")
    scored = toxicity.score(docs, toxicity.fit(docs, _labels(spark, sf_dir)), out=out)
    return scored.where(F.col(out) < toxicity.THRESHOLD).select(*docs.columns)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group."""
    other, nth = fresh(docs, "gone"), fresh(docs, "nth")
    groups = ngram_join.jaccard_components(docs, WORDS, NUM, DEN)
    gone = written(groups.where("doc_id <> component_id").select(F.col("doc_id").alias(other)).distinct(), "gone")
    # the list grows with the input, so it is joined by shuffle at every size; the window needs no other
    known = docs.where("doc_id IS NOT NULL").join(gone.hint("merge"), F.col("doc_id") == F.col(other), "left_anti")
    order = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("source", "lang", "n_chars")
    first = known.withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1)
    return first.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def encode_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens, ids (little-endian unsigned 32-bit integers) of every row of the mix."""
    coded = bpe.encode(docs, VOCABULARY, public_tokenizers.PATTERN)
    return coded.select("doc_id", "source", "lang", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality", keep_good),
    ("toxicity", keep_civil),
    ("ngram_jaccard", keep_distinct),
    ("mixing", mix_sources),
    ("byte_bpe", encode_text),
]

#: Training and Newton iterations aren't SQL: the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
