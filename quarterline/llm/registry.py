"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, fingerprints, html, jaccard, licences, packing, quality, secrets, substrings, vectors


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_licences": licences.op1_licences,
        "op2_packing": packing.op2_packing,
        "op3_fingerprints": fingerprints.op3_fingerprints,
        "op4_byte_bpe": bpe.op4_byte_bpe,
        "op5_secrets": secrets.op5_secrets,
        "op6_substrings": substrings.op6_substrings,
        "op7_vectors": vectors.op7_vectors,
        "op8_quality": quality.op8_quality,
        "op9_html": html.op9_html,
        "op10_jaccard": jaccard.op10_jaccard,
    }


def oracles() -> dict[str, str]:
    return {"op1_licences": licences.op1_sql()}
