"""The corpus queries under their registered names; SQL where a query can be said in SQL."""

from __future__ import annotations

from .bpe import op3_bpe
from .chat import op2_chat_format
from .divergence import ORACLE as DIVERGENCE_SQL
from .divergence import op12_source_divergence
from .embeddings import op1_embedding_near_dedup
from .langid import op10_language_id
from .packing import op9_packing
from .periodic import op11_periodic_runs
from .quality import op6_quality_rules
from .simhash import op5_simhash
from .substring import op8_substring_dedup
from .suffixdedup import op7_suffix_dedup
from .tokencount import op13_token_counts
from .urls import op4_url_filter

QUERIES = {
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "op2_chat_format": op2_chat_format,
    "op3_bpe": op3_bpe,
    "op4_url_filter": op4_url_filter,
    "op5_simhash": op5_simhash,
    "op6_quality_rules": op6_quality_rules,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_packing": op9_packing,
    "op10_language_id": op10_language_id,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_source_divergence": op12_source_divergence,
    "op13_token_counts": op13_token_counts,
}
ORACLE_SQL: dict[str, str] = {"op12_source_divergence": DIVERGENCE_SQL}
