"""The operators' queries over their whole tables, and DuckDB SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import centroids, decontamination, html_text, jaccard, licenses, mixing, quality, ranked, rules, secret_scan, sharding, substrings, toxicity
from tessera.llm.common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.joined(table(spark, sf_dir, "documents"), width=4, similar=85)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.cleaned(table(spark, sf_dir, "documents")).drop("kept")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.rendered(table(spark, sf_dir, "pages"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.found(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(table(spark, sf_dir, "embeddings"))


def op13_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_jaccard": op2_jaccard,
    "op3_toxicity": op3_toxicity,
    "op4_rules": op4_rules,
    "op5_mixing": op5_mixing,
    "op6_licenses": op6_licenses,
    "op7_substrings": op7_substrings,
    "op8_sharding": op8_sharding,
    "op9_html_text": op9_html_text,
    "op10_decontamination": op10_decontamination,
    "op11_secrets": op11_secrets,
    "op12_centroids": op12_centroids,
    "op13_ranked": op13_ranked,
}
ORACLES: dict[str, str] = {
    "op2_jaccard": jaccard.ORACLE,
    "op5_mixing": mixing.ORACLE,
    "op11_secrets": secret_scan.ORACLE,
    "op12_centroids": centroids.ORACLE,
    "op13_ranked": ranked.ORACLE,
}
