"""The registered queries of the corpus operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import cotrain, decon, packing, quality, secret_scan, simhash, suffix_dedup, token_counts, training_order, url_filter
from .common import Workspace, table


def op1_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.materialise(table(spark, sf_dir, "documents"), Workspace(spark, "op1"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), Workspace(spark, "op2"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"), Workspace(spark, "op3"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.report(spark, table(spark, sf_dir, "documents"), Workspace(spark, "op4"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), Workspace(spark, "op6"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), Workspace(spark, "op7"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Workspace(spark, "op8"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decon.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_training_order, op2_simhash_near_dedup, op3_suffix_dedup, op4_token_counts, op5_quality_rules, op6_best_fit_packing, op7_url_filter, op8_quality_classifier, op9_decontamination, op10_secret_scan)}
ORACLE_SQL: dict[str, str] = {"op5_quality_rules": quality.ORACLE, "op7_url_filter": url_filter.ORACLE, "op9_decontamination": decon.ORACLE}
