"""The registered queries op1 to op13, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table
from .exact import exact_sql
from .merkle import audit_sql
from .urls import judge_sql


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .paragraphs import substring_report

    return substring_report(read_table(spark, sf_dir, "documents"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_components

    c = simhash_components(read_table(spark, sf_dir, "documents"))
    return c.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import classify

    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import near_vectors

    return near_vectors(read_table(spark, sf_dir, "embeddings"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import judge

    return judge(read_table(spark, sf_dir, "pages"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score_documents

    return score_documents(read_table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import suffix_dedup

    return suffix_dedup(read_table(spark, sf_dir, "documents"))


def op4_media_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import describe_media, text_media

    return describe_media(text_media(read_table(spark, sf_dir, "documents")))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import encode

    return encode(read_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op11_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .alignment import alignment

    return alignment(read_table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact import exact_groups

    return exact_groups(read_table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import audit

    return audit(read_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_pack_sequences, op2_embedding_dedup, op3_url_filter, op4_media_avi, op5_sentencepiece, op6_substring_dedup, op7_lm_scoring, op8_simhash_dedup,
        op9_toxicity, op10_suffix_dedup, op11_cross_tokenizer, op12_exact_dedup, op13_merkle_manifest,
    )
}
ORACLE_SQL: dict[str, str] = {"op3_url_filter": judge_sql(), "op12_exact_dedup": exact_sql(), "op13_merkle_manifest": audit_sql()}
