"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwave.llm import archive, bpe, chat, neardup, packing, pii, quality, scoring, spelling, sql, tokenfile, topk, trie, webtext
from quillwave.llm.common import table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe_pair_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_decode(table(spark, sf_dir, "documents"), WORD_BPE))


def op2_wrapper_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webtext.main_text(table(spark, sf_dir, "pages"))


def op3_context_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.digests(tokenfile.write_and_read(table(spark, sf_dir, "documents"), BYTE_BPE, spark))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_chosen_path_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_block_pruned_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_zipped_web_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = archive.write_and_read(table(spark, sf_dir, "pages"), spark)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.spans(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE)


def op11_incremental_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    # A conversation whose texts are control strings themselves.
    hostile = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", hostile), (-7, 1, "assistant", hostile)], "conv_id long, turn long, role string, text string")
    return chat.read_back(held.unionByName(extra))


def op12_partenum_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_bitmap_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(*trie.rebuilt(table(spark, sf_dir, "conversations")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_bpe_pair_index,
        op2_wrapper_main_text,
        op3_context_tree_scores,
        op4_token_files,
        op5_quality_rules,
        op6_chosen_path_near_duplicates,
        op7_block_pruned_top_k,
        op8_zipped_web_archives,
        op9_weak_supervision_pii,
        op10_best_fit_packing,
        op11_incremental_chat,
        op12_partenum_spelling,
        op13_bitmap_prefix_trie,
    )
}

ORACLES: dict[str, str] = {
    "op7_block_pruned_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
            FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op8_zipped_web_archives": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
            FROM pages
        ), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND first < page_id THEN first END AS refers_to
        FROM f""",
    "op11_incremental_chat": sql.OP11,
    "op12_partenum_spelling": sql.OP12,
    "op13_bitmap_prefix_trie": sql.OP13,
}
