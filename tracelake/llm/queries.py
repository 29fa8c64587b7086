"""The driver's queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracelake.llm import decontaminate, html_extract, language_id, language_model, license_scan, mixing, near_dup, quality, url_filter, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc_writer": warc.op1_warc_writer,
        "op2_ppm_language_id": language_id.op2_ppm_language_id,
        "op3_license_scan": license_scan.op3_license_scan,
        "op4_quality_cascade": quality.op4_quality_cascade,
        "op5_url_filter": url_filter.op5_url_filter,
        "op6_weighted_fair_mix": mixing.op6_weighted_fair_mix,
        "op7_template_extraction": html_extract.op7_template_extraction,
        "op8_benchmark_decontamination": decontaminate.op8_benchmark_decontamination,
        "op9_suffix_tree_lm": language_model.op9_suffix_tree_lm,
        "op10_minhash_near_dup": near_dup.op10_minhash_near_dup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc_writer": warc.OP1_SQL,
        "op3_license_scan": license_scan.OP3_SQL,
        "op4_quality_cascade": quality.OP4_SQL,
        "op5_url_filter": url_filter.OP5_SQL,
        "op6_weighted_fair_mix": mixing.OP6_SQL,
        "op8_benchmark_decontamination": decontaminate.OP8_SQL,
        "op10_minhash_near_dup": near_dup.OP10_SQL,
    }
