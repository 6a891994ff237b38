"""The registered queries over ``documents``; each applies its operator to the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffix_dedup

    return suffix_dedup.digest(_documents(spark, sf_dir))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simhash

    return simhash.digest(_documents(spark, sf_dir))


def op3_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import media

    return media.digest(_documents(spark, sf_dir))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import packing

    return packing.digest(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    return quality.digest(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    return pii.digest(_documents(spark, sf_dir))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import common, sharding

    return sharding.digest(_documents(spark, sf_dir), common.shared_path(spark, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import bpe

    return bpe.digest(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secrets

    return secrets.digest(_documents(spark, sf_dir))


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import rules

    return rules.digest(_documents(spark, sf_dir))


def rules_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import rules

    return rules.ablation(rules.stored_ledger(_documents(spark, sf_dir)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_simhash": op2_simhash,
        "op3_audio": op3_audio,
        "op4_packing": op4_packing,
        "op5_quality": op5_quality,
        "op6_pii": op6_pii,
        "op7_sharding": op7_sharding,
        "op8_bpe": op8_bpe,
        "op9_secrets": op9_secrets,
        "op10_rules": op10_rules,
        "rules_ablation": rules_ablation,
    }


def oracle_sql() -> dict[str, str]:
    from . import rules, sharding

    return {"op7_sharding": sharding.ORACLE_SQL, "op10_rules": rules.ORACLE_SQL, "rules_ablation": rules.ABLATION_SQL}
