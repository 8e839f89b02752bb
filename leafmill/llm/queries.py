"""The driver's queries over this package's operators, and DuckDB SQL for those that SQL can express.

Each query reads whole tables, applies its operator with production parameters, and derives the contract's
columns from what the operator returns.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import bpe, chat, fingerprint, hamming, mixing, ngram_join, quality, sharding, toxicity, warc

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, VOCABULARY, public_tokenizers.PATTERN).select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_edits(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 24)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(manifest, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten rows nearest to every row whose id is divisible by 100, by the signs of the embedding."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), hamming.sign_code(F.col("embedding")).alias("code"))
    found = hamming.top_k(rows, rows.where(F.col("id") % 100 == 0), 10)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), F.col("id").alias("vec_id"), F.col("distance").cast("long").alias("distance"))


def op7_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(said))
    return chat.digest_conversations(chat.format_windows(rows.union(extra)))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_fingerprint": op2_fingerprint,
    "op3_sharding": op3_sharding,
    "op4_mixing": op4_mixing,
    "op5_warc": op5_warc,
    "op6_hamming_top_k": op6_hamming_top_k,
    "op7_chat_windows": op7_chat_windows,
    "op8_toxicity": op8_toxicity,
    "op9_quality": op9_quality,
    "op10_ngram_join": op10_ngram_join,
}

ORACLE_SQL: dict[str, str] = {
    "op5_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages), f AS (SELECT d, min(page_id) AS f FROM p GROUP BY d)
        SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
            array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                1 + CAST((CAST('0x' || substr(p.d, CAST(10 * (k // 8) + 1 AS INTEGER), 10) AS BIGINT) >> CAST(35 - 5 * (k % 8) AS INTEGER)) & 31 AS INTEGER), 1)), '') AS payload_digest,
            CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to
        FROM p JOIN f ON p.d = f.d""",
    "op7_chat_windows": """WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, t, u, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS x(t, u)),
        a AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, CAST(ceil(length(text) / 4.0) AS BIGINT) + 4 AS n,
            24 + length(replace(replace(replace(role, '&', '&amp;'), '<|', '&lt;|'), chr(10), '&#10;')) + length(replace(replace(text, '&', '&amp;'), '<|', '&lt;|')) AS chars FROM r),
        g AS (SELECT *, first_value(role = 'system') OVER w AS has, first_value(chars) OVER w AS sys, first_value(CASE WHEN role = 'system' THEN n ELSE 0 END) OVER w AS base FROM a WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
        h AS (SELECT *, greatest(1024 - 256 - base, 2) // 2 AS stride, greatest(1024 - 256 - base, 2) - greatest(1024 - 256 - base, 2) // 2 AS half FROM g),
        b AS (SELECT *, CASE WHEN n > half OR coalesce(lag(n) OVER w > half, false) THEN 1 ELSE 0 END AS breaks,
            coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
        c AS (SELECT *, sum(breaks) OVER (PARTITION BY conv_id ORDER BY i) AS run FROM b),
        d AS (SELECT *, floor((before - first_value(before) OVER (PARTITION BY conv_id, run ORDER BY i)) / stride) AS step FROM c),
        e AS (SELECT *, coalesce(lag(run) OVER w <> run OR lag(step) OVER w <> step, true) AS opens, lag(n, 1) OVER w AS n1, lag(n, 2) OVER w AS n2, lag(chars, 1) OVER w AS c1, lag(chars, 2) OVER w AS c2 FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
        k AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY i) AS win FROM e),
        m AS (SELECT *, least(256, 1024 - base - sum(n) OVER (PARTITION BY conv_id, win)) AS spare FROM k),
        f AS (SELECT *, CASE WHEN opens AND i > 1 THEN (CASE WHEN has THEN sys ELSE 0 END) + (CASE WHEN n1 <= spare AND NOT (has AND i = 2) THEN c1 ELSE 0 END)
            + (CASE WHEN n1 + n2 <= spare AND NOT (has AND i = 3) THEN c2 ELSE 0 END) ELSE 0 END AS again FROM m)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(chars + again) AS BIGINT) AS formatted_chars, CAST(count(*) FILTER (WHERE opens) AS BIGINT) AS n_windows FROM f GROUP BY conv_id""",
    "op10_ngram_join": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
            ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) END) AS sh FROM w),
        n AS (SELECT doc_id, len(sh) AS n FROM s), x AS (SELECT doc_id, unnest(sh) AS t FROM s),
        o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM x AS a JOIN x AS b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM o JOIN n AS p ON p.doc_id = a JOIN n AS q ON q.doc_id = b WHERE 100 * o >= 85 * (p.n + q.n - o)),
        r(doc_id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reach)
        SELECT r.doc_id, any_value(n.n) AS n_shingles, min(reach) AS component_id FROM r JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id""",
    "op6_hamming_top_k": """WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS bits FROM embeddings WHERE embedding IS NOT NULL),
        p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.bits, c.bits), lambda z: CASE WHEN z[1] = z[2] THEN 0 ELSE 1 END)) AS BIGINT) AS distance
            FROM c AS q, c WHERE q.vec_id % 100 = 0)
        SELECT query_id, rank, vec_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM p) WHERE rank <= 10""",
}
