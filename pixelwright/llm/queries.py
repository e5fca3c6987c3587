"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, html_text, iblt, jaccard_join, langid, licenses, media, oracles, packing, quality, token_counts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": token_counts.op1,
        "op2_media_columns": media.op2,
        "op3_quality_classifier": quality.op3,
        "op4_license_scan": licenses.op4,
        "op5_html_text": html_text.op5,
        "op6_bpe_round_trip": bpe.op6,
        "op7_document_fingerprints": iblt.op7,
        "op8_packing": packing.op8,
        "op9_jaccard_join": jaccard_join.op9,
        "op10_language_id": langid.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_license_scan": licenses.ORACLE,
        "op9_jaccard_join": oracles.JACCARD_JOIN,
    }
