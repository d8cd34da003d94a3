"""Registered queries of the training-data operators and their DuckDB SQL, by query name.

Operators without SQL here can't be expressed in it; tests/llm compares them
with brute force or with the library whose results they must equal.
"""

from __future__ import annotations

from .bpe import op5_bpe_encode_decode
from .conversations import op13_conversation_repair
from .decontamination import OP2_SQL, op2_benchmark_decontamination
from .embeddings import OP9_SQL, op9_embedding_near_dedup
from .licenses import OP4_SQL, op4_license_scan
from .lines import OP3_SQL, op3_line_dedup
from .lm import op8_pitman_yor_scores
from .secrets import OP12_SQL, op12_secret_scan
from .sharding import op7_histogram_sharding
from .simhash import op10_simhash_near_dedup
from .substrings import OP1_SQL, op1_suffix_array_dedup
from .toxicity import op6_toxicity_severity
from .vector_codes import OP11_SQL, op11_vector_codes

LLM_QUERIES = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_line_dedup": op3_line_dedup,
    "op4_license_scan": op4_license_scan,
    "op5_bpe_encode_decode": op5_bpe_encode_decode,
    "op6_toxicity_severity": op6_toxicity_severity,
    "op7_histogram_sharding": op7_histogram_sharding,
    "op8_pitman_yor_scores": op8_pitman_yor_scores,
    "op9_embedding_near_dedup": op9_embedding_near_dedup,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_vector_codes": op11_vector_codes,
    "op12_secret_scan": op12_secret_scan,
    "op13_conversation_repair": op13_conversation_repair,
}

LLM_ORACLE: dict[str, str] = {
    "op1_suffix_array_dedup": OP1_SQL,
    "op2_benchmark_decontamination": OP2_SQL,
    "op3_line_dedup": OP3_SQL,
    "op4_license_scan": OP4_SQL,
    "op9_embedding_near_dedup": OP9_SQL,
    "op11_vector_codes": OP11_SQL,
    "op12_secret_scan": OP12_SQL,
}
