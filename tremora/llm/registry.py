"""Queries and oracle SQL of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tremora.llm.classifier import op4_quality_classifier
from tremora.llm.clusters import OP12_SQL, op12_centroid_clustering
from tremora.llm.fuzzy_passages import op1_fuzzy_passages
from tremora.llm.jpeg import op10_jpeg_media
from tremora.llm.licenses import op11_license_scan
from tremora.llm.mixing import OP2_SQL, op2_source_mixing
from tremora.llm.near_duplicates import op9_minhash_near_dedup
from tremora.llm.quality_rules import op6_quality_rules
from tremora.llm.secrets import op3_secret_scan
from tremora.llm.sentencepiece import op5_sentencepiece
from tremora.llm.token_store import op7_token_binary
from tremora.llm.vector_codes import OP13_SQL, op13_vector_codes
from tremora.llm.warc import OP8_SQL, op8_warc_zip


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_fuzzy_passages,
        op2_source_mixing,
        op3_secret_scan,
        op4_quality_classifier,
        op5_sentencepiece,
        op6_quality_rules,
        op7_token_binary,
        op8_warc_zip,
        op9_minhash_near_dedup,
        op10_jpeg_media,
        op11_license_scan,
        op12_centroid_clustering,
        op13_vector_codes
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_source_mixing": OP2_SQL,
        "op8_warc_zip": OP8_SQL,
        "op12_centroid_clustering": OP12_SQL,
        "op13_vector_codes": OP13_SQL
    }
