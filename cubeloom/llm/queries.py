"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, minhash_dedup, mixing, packing, pii, quality_rules, secret_scan, substring_dedup, suffix_dedup, url_filter
from .sql import ORACLES

Query = Callable[[SparkSession, str], DataFrame]


def _docs(report: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def queries() -> dict[str, Query]:
    return {
        "op1_url_filter": url_filter.report,
        "op2_secret_scan": _docs(secret_scan.report),
        "op3_minhash_dedup": _docs(minhash_dedup.near_duplicates),
        "op4_substring_dedup": _docs(substring_dedup.remove_repeats),
        "op5_personal_data": _docs(pii.report),
        "op6_mixing": _docs(mixing.report),
        "op7_packing": _docs(packing.pack),
        "op8_nearest_neighbours": ann.report,
        "op9_suffix_dedup": _docs(suffix_dedup.remove_repeats),
        "op10_quality_rules": _docs(quality_rules.report),
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
