"""Registered queries of this package: name to (query, SQL or None)."""

from __future__ import annotations

from turnsift.llm import (
    bond,
    byte_bpe,
    exact_dedup,
    imatch,
    importance,
    language_id,
    line_dedup,
    merkle,
    mixing,
    ngram_join,
    secret_scan,
    sharding,
    url_filter,
)


def registered() -> dict:
    return {
        "op1_importance": (importance.op1_importance, None),
        "op2_url_filter": (url_filter.op2_url_filter, None),
        "op3_line_dedup": (line_dedup.op3_line_dedup, line_dedup.ORACLE),
        "op4_secret_scan": (secret_scan.op4_secret_scan, None),
        "op5_byte_bpe": (byte_bpe.op5_byte_bpe, None),
        "op6_exact_dedup": (exact_dedup.op6_exact_dedup, exact_dedup.ORACLE),
        "op7_ngram_join": (ngram_join.op7_ngram_join, None),
        "op8_language_id": (language_id.op8_language_id, None),
        "op9_mixing": (mixing.op9_mixing, None),
        "op10_imatch": (imatch.op10_imatch, None),
        "op11_sharding": (sharding.op11_sharding, None),
        "op12_hard_negatives": (bond.op12_hard_negatives, bond.ORACLE),
        "op13_merkle_manifest": (merkle.op13_merkle_manifest, merkle.ORACLE),
    }
