"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from pairloom.llm.bpe import op3_bpe_round_trip
from pairloom.llm.conversations import op13_conversation_repair
from pairloom.llm.decontaminate import op4_decontamination
from pairloom.llm.jaccard_join import op8_jaccard_join
from pairloom.llm.merkle import op12_document_fingerprints
from pairloom.llm.pii import op7_pii
from pairloom.llm.quality_classifier import op2_quality_classifier
from pairloom.llm.quality_rules import op5_quality_rules
from pairloom.llm.substring_dedup import op10_substring_dedup
from pairloom.llm.token_counts import op1_token_counts
from pairloom.llm.toxicity import op6_toxicity
from pairloom.llm.url_filter import op9_url_filter
from pairloom.llm.whitening import op11_embedding_whitening

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_bpe_round_trip": op3_bpe_round_trip,
    "op4_decontamination": op4_decontamination,
    "op5_quality_rules": op5_quality_rules,
    "op6_toxicity": op6_toxicity,
    "op7_pii": op7_pii,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_url_filter": op9_url_filter,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_document_fingerprints": op12_document_fingerprints,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE_SQL: dict[str, str] = {}
