"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, byte_bpe, centroids, exact_dedup, html_extract, license_scan, line_dedup, ngram_join, packing, spelling, token_counts, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ann": ann.op1_ann,
        "op2_best_fit_packing": packing.op2_best_fit_packing,
        "op3_byte_bpe": byte_bpe.op3_byte_bpe,
        "op4_warc": warc.op4_warc,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_ngram_join": ngram_join.op6_ngram_join,
        "op7_html_extract": html_extract.op7_html_extract,
        "op8_exact_dedup": exact_dedup.op8_exact_dedup,
        "op9_line_dedup": line_dedup.op9_line_dedup,
        "op10_license_scan": license_scan.op10_license_scan,
        "op11_spelling": spelling.op11_spelling,
        "op12_centroids": centroids.op12_centroids,
        "op13_token_counts": token_counts.op13_token_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_warc": warc.ORACLE,
        "op8_exact_dedup": exact_dedup.ORACLE,
        "op9_line_dedup": line_dedup.ORACLE,
        "op10_license_scan": license_scan.oracle(),
        "op12_centroids": centroids.oracle(),
    }
