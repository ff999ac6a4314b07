"""Queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

from . import (
    chat, exact_dedup, hard_negatives, language_model, lattice, mixing, packing, piece_table, quality, secret_scan, shingle_join,
    toxicity, url_filter,
)

QUERIES = {f.__name__: f for f in (
    lattice.op1_near_vectors,
    url_filter.op2_url_filter,
    chat.op3_chat_format,
    language_model.op4_language_model,
    mixing.op5_source_mix,
    toxicity.op6_toxicity,
    exact_dedup.op7_exact_dedup,
    packing.op8_packing,
    shingle_join.op9_shingle_join,
    quality.op10_quality,
    hard_negatives.op11_hard_negatives,
    secret_scan.op12_secret_scan,
    piece_table.op13_fill_in_middle,
)}
ORACLES = {
    "op1_near_vectors": lattice.SQL,
    "op3_chat_format": chat.SQL,
    "op5_source_mix": mixing.SQL,
    "op7_exact_dedup": exact_dedup.SQL,
    "op9_shingle_join": shingle_join.SQL,
    "op11_hard_negatives": hard_negatives.SQL,
    "op13_fill_in_middle": piece_table.SQL,
}
