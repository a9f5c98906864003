"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from .mixing import op7_systematic_mix
from .neighbours import op9_stable_projections
from .pieces import op8_sentencepiece
from .pitman_yor import op10_pitman_yor
from .quality import op6_compression_quality
from .secrets import ORACLE_SQL as OP4_SQL
from .secrets import op4_blob_ledger
from .sharding import op3_minimax_sharding
from .simhash import op1_simhash
from .spotsigs import op2_spotsigs
from .urls import op5_url_templates

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_spotsigs": op2_spotsigs,
    "op3_minimax_sharding": op3_minimax_sharding,
    "op4_blob_ledger": op4_blob_ledger,
    "op5_url_templates": op5_url_templates,
    "op6_compression_quality": op6_compression_quality,
    "op7_systematic_mix": op7_systematic_mix,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_stable_projections": op9_stable_projections,
    "op10_pitman_yor": op10_pitman_yor,
}
#: The others can't be put in SQL (64-bit hashes, trained models, searches); tests hold them against brute force.
ORACLE: dict[str, str] = {"op4_blob_ledger": OP4_SQL}
