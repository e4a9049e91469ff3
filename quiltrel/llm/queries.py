"""The registered queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quiltrel.llm import language, licenses, media, mixing, neardup, packing, pii, quality, secrets, substrings
from quiltrel.llm.common import documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(documents(spark, sf_dir)))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(media.text_media(documents(spark, sf_dir), with_media=False))


def op5_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removals(documents(spark, sf_dir))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(quality.verdicts(documents(spark, sf_dir)))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.digest(documents(spark, sf_dir))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(mixing.mix(documents(spark, sf_dir)))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.spans(documents(spark, sf_dir)))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.clusters(documents(spark, sf_dir))


_ALL = (
    op1_secret_scan,
    op2_media_columns,
    op3_language_id,
    op4_source_mix,
    op5_repeated_substrings,
    op6_license_scan,
    op7_quality_rules,
    op8_personal_data,
    op9_packing,
    op10_near_duplicates,
)
QUERIES: dict[str, Query] = {f.__name__: f for f in _ALL}
ORACLES: dict[str, str] = {}
