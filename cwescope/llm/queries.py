"""The numbered queries ``opN_<name>`` over the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cwescope.llm import (codes, decontam, licenses, lines, mixing, nearcopies, ngram_lm, packing, pii, quality, spelling,
                          substrings, topk)
from cwescope.llm.common import read


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(read(spark, sf_dir, "documents"))


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_report(read(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(read(spark, sf_dir, "documents"))


def op4_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontam_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(read(spark, sf_dir, "documents"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"))


def op7_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score(read(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(read(spark, sf_dir, "documents"))


def op10_nearcopies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearcopies.near_report(read(spark, sf_dir, "documents"))


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.code_report(read(spark, sf_dir, "embeddings"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_report(read(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licenses": op1_licenses,
    "op2_substrings": op2_substrings,
    "op3_mixing": op3_mixing,
    "op4_decontam": op4_decontam,
    "op5_lines": op5_lines,
    "op6_topk": op6_topk,
    "op7_ngram_lm": op7_ngram_lm,
    "op8_quality": op8_quality,
    "op9_pii": op9_pii,
    "op10_nearcopies": op10_nearcopies,
    "op11_codes": op11_codes,
    "op12_packing": op12_packing,
    "op13_spelling": op13_spelling,
}

ORACLES: dict[str, str] = {
    "op3_mixing": mixing.ORACLE,
    "op4_decontam": decontam.ORACLE,
    "op6_topk": topk.ORACLE,
    "op11_codes": codes.ORACLE,
}
