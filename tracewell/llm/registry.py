"""Queries of this subpackage, and their SQL."""

from __future__ import annotations

from .align import op12_token_alignment
from .chat import OP7_SQL, op7_perspectives
from .extract import op6_main_text
from .jaccard import OP2_SQL, op2_jaccard_join
from .media import op1_media_columns
from .merkle import OP13_SQL, op13_merkle_manifest
from .mixing import OP3_SQL, op3_source_mix
from .packing import op8_best_two_fit
from .phrases import OP10_SQL, op10_phrase_dedup
from .pivots import OP11_SQL, op11_pivot_near_dedup
from .rindex import OP5_SQL, op5_suffix_dedup
from .search import OP4_SQL, op4_exact_top_k
from .toxicity import op9_toxicity

QUERIES = {
    "op1_media_columns": op1_media_columns,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_source_mix": op3_source_mix,
    "op4_exact_top_k": op4_exact_top_k,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_main_text": op6_main_text,
    "op7_perspectives": op7_perspectives,
    "op8_best_two_fit": op8_best_two_fit,
    "op9_toxicity": op9_toxicity,
    "op10_phrase_dedup": op10_phrase_dedup,
    "op11_pivot_near_dedup": op11_pivot_near_dedup,
    "op12_token_alignment": op12_token_alignment,
    "op13_merkle_manifest": op13_merkle_manifest,
}
ORACLES = {"op2_jaccard_join": OP2_SQL, "op3_source_mix": OP3_SQL, "op4_exact_top_k": OP4_SQL, "op5_suffix_dedup": OP5_SQL, "op7_perspectives": OP7_SQL, "op10_phrase_dedup": OP10_SQL, "op11_pivot_near_dedup": OP11_SQL, "op13_merkle_manifest": OP13_SQL}
