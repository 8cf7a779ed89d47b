"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from gridspark.llm.byte_bpe import op12_byte_bpe
from gridspark.llm.ppm import op2_ppm
from gridspark.llm.repeats import op9_prefix_free_parsing
from gridspark.llm.resampling import op6_importance_resampling
from gridspark.llm.decontaminate import op3_latent_decontamination
from gridspark.llm.hard_negatives import op13_hard_negatives
from gridspark.llm.hard_negatives import oracle as op13_sql
from gridspark.llm.hamming import op1_multi_index_hashing
from gridspark.llm.hamming import oracle as op1_sql
from gridspark.llm.line_dedup import op7_line_chunks
from gridspark.llm.merkle import op11_merkle_manifest
from gridspark.llm.merkle import oracle as op11_sql
from gridspark.llm.near_dups import op5_weighted_minhash
from gridspark.llm.packing import op8_pattern_packing
from gridspark.llm.token_store import op4_token_store
from gridspark.llm.toxicity import op10_toxicity

QUERIES = {
    "op1_multi_index_hashing": op1_multi_index_hashing,
    "op2_ppm": op2_ppm,
    "op3_latent_decontamination": op3_latent_decontamination,
    "op4_token_store": op4_token_store,
    "op5_weighted_minhash": op5_weighted_minhash,
    "op6_importance_resampling": op6_importance_resampling,
    "op7_line_chunks": op7_line_chunks,
    "op8_pattern_packing": op8_pattern_packing,
    "op9_prefix_free_parsing": op9_prefix_free_parsing,
    "op10_toxicity": op10_toxicity,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL = {"op1_multi_index_hashing": op1_sql(), "op11_merkle_manifest": op11_sql(), "op13_hard_negatives": op13_sql()}
