"""The registered queries opN_<name>, each over its whole table, and DuckDB SQL where that can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontamination, mixing, prefix_trie, substring_dedup, topk


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_groups

    return near_groups(_table(spark, sf_dir, "documents"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_scoring import score_documents

    return score_documents(_table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import repeats_report

    return repeats_report(_table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import language_report

    return language_report(_table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(_table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(_table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), all_columns=False)


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import conversation_digests

    return conversation_digests(_table(spark, sf_dir, "conversations"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_quality

    scored = score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "quality_score", "text_score", "meta_score", "accepted")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contamination_report

    return contamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .alignment import align

    return align(_table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_lm_scoring, op3_substring_dedup, op4_language_id, op5_sharding, op6_exact_dedup, op7_chat_formatting, op8_mixing, op9_quality_classifier, op10_decontamination, op11_topk, op12_alignment, op13_prefix_trie)}

LOWER_SQL = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE = {
    "op3_substring_dedup": substring_dedup.REPEATS_SQL,
    "op6_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({LOWER_SQL.format("text")}) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)""",
    "op7_chat_formatting": chat.CHAT_SQL,
    "op8_mixing": mixing.mix_sql(),
    "op10_decontamination": decontamination.CONTAMINATION_SQL,
    "op11_topk": topk.TOP_SQL,
    "op13_prefix_trie": prefix_trie.TRIE_SQL,
}
