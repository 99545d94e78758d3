"""The ``opN_`` queries and ``pipeline``, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillguard.llm import bpe, codebooks, corpus, infill, language, mixing, neardup, pii, quality, repeats, setjoin, sharding, suffix_tree, topk
from quillguard.llm.session import documents


def op1_va_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.search(rows, rows.filter("vec_id % 100 = 0"))


def op2_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave(documents(spark, sf_dir))


def op3_entropy_balancing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(documents(spark, sf_dir), public_tokenizers.path(bpe.DEFAULT_VOCABULARY), public_tokenizers.PATTERN, with_ids=False)


def op5_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir))


def op6_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score_documents(documents(spark, sf_dir))


def op7_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(documents(spark, sf_dir)).drop("kept")


def op8_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(documents(spark, sf_dir))


def op9_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.components_of(documents(spark, sf_dir)).drop("t1", "t2")


def op10_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_set_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.components_of(documents(spark, sf_dir))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_va_file": op1_va_file,
        "op2_stratified_shards": op2_stratified_shards,
        "op3_entropy_balancing": op3_entropy_balancing,
        "op4_byte_bpe": op4_byte_bpe,
        "op5_ppm_language": op5_ppm_language,
        "op6_suffix_tree": op6_suffix_tree,
        "op7_suffix_repeats": op7_suffix_repeats,
        "op8_bootstrapped_pii": op8_bootstrapped_pii,
        "op9_setsketch": op9_setsketch,
        "pipeline": corpus.run,
        "op10_line_frequency": op10_line_frequency,
        "op11_vector_codes": op11_vector_codes,
        "op12_set_relations": op12_set_relations,
        "op13_fill_in_middle": op13_fill_in_middle,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_va_file": topk.SQL, "op9_setsketch": neardup.SQL, "op10_line_frequency": quality.SQL, "op11_vector_codes": codebooks.SQL, "op12_set_relations": setjoin.SQL, "op13_fill_in_middle": infill.SQL}
