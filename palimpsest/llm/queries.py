"""The operators' queries: each applies one to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .oracles import FILTER_AUDIT, PREFIX_TRIE


def ranks() -> str:
    """The rank file of the packing's vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_table

    return quality_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), size=4)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import repeated_spans

    return repeated_spans(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan_secrets, train

    docs = table(spark, sf_dir, "documents")
    return scan_secrets(docs, train(docs))


def op6_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import harmonic_pack

    return harmonic_pack(table(spark, sf_dir, "documents"), ranks())


def op7_nn_descent_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import embedding_near_duplicates

    return embedding_near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op9_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import cube_mix

    return cube_mix(table(spark, sf_dir, "documents"))


def op10_iso_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_digest

    return media_digest(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .audit import filter_audit

    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import repeated_bytes

    return repeated_bytes(table(spark, sf_dir, "documents")).drop("runs")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .trie import conversation_trie

    return conversation_trie(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_minhash_near_dedup, op3_html_extraction, op4_substring_dedup, op5_secret_scan, op6_harmonic_packing, op7_nn_descent_dedup, op8_elias_fano_lm, op9_cube_mixing, op10_iso_media, op11_filter_audit, op12_suffix_array_dedup, op13_prefix_trie)}
ORACLES: dict[str, str] = {"op11_filter_audit": FILTER_AUDIT, "op13_prefix_trie": PREFIX_TRIE}
