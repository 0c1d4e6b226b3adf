"""The registered queries of this subpackage and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import classifier, edits, jaccard, licenses, media, middles, mixing, packing, pieces, rules, suffixes, tries, warc
from .common import deliver

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": edits.op1,
    "op2_license_scan": licenses.op2,
    "op3_suffix_dedup": suffixes.op3,
    "op4_mix_sources": mixing.op4,
    "op5_quality_rules": rules.op5,
    "op6_best_fit_packing": packing.op6,
    "op7_warc_derivatives": warc.op7,
    "op7_warc_decoded": warc.op7,
    "op7_warc_serialised": warc.op7_serialised,
    "op8_media_columns": media.op8,
    "op8_page_items": media.page_items,
    "op9_jaccard_join": jaccard.op9,
    "op10_quality_classifier": classifier.op10,
    "op11_fill_in_middle": middles.op11,
    "op12_sentence_pieces": pieces.op12,
    "op13_conversation_trie": tries.op13,
}


def _sent(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        deliver(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _sent(query) for name, query in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {"op4_mix_sources": mixing.ORACLE, "op5_quality_rules": rules.ORACLE, "op7_warc_derivatives": warc.ORACLE, "op7_warc_decoded": warc.ORACLE, "op7_warc_serialised": warc.SERIALISED, "op11_fill_in_middle": middles.ORACLE, "op13_conversation_trie": tries.ORACLE}
