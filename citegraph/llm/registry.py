"""The queries of this subpackage and the SQL that some of them must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from citegraph.llm import compression, contamination, divergence, languages, lm, near, quality, shards, variants
from citegraph.llm.licenses import op2_license_scans
from citegraph.llm.pieces import op9_piece_codec
from citegraph.llm.pii import op4_personal_data
from citegraph.llm.tokens import op1_token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_license_scans": op2_license_scans,
    "op3_sharding": shards.op3_sharding,
    "op4_personal_data": op4_personal_data,
    "op5_near_duplicates": near.op5_near_duplicates,
    "op6_language_id": languages.op6_language_id,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_decontamination": contamination.op8_decontamination,
    "op9_piece_codec": op9_piece_codec,
    "op10_cross_entropy_difference": lm.op10_cross_entropy_difference,
    "op11_quality_classifier": compression.op11_quality_classifier,
    "op12_spelling_variants": variants.op12_spelling_variants,
    "op13_source_divergence": divergence.op13_source_divergence,
}

ORACLES: dict[str, str] = {
    "op3_sharding": shards.ORACLE,
    "op7_quality_rules": quality.ORACLE,
    "op8_decontamination": contamination.ORACLE,
    "op12_spelling_variants": variants.ORACLE,
    "op13_source_divergence": divergence.ORACLE,
}
