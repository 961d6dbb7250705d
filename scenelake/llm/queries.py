"""Registered queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from scenelake.llm.bpe import op1_byte_bpe
from scenelake.llm.bytenet import op13_bytenet
from scenelake.llm.langid import op6_language_id
from scenelake.llm.mixing import op2_mixing
from scenelake.llm.ngram_join import op9_ngram_jaccard_join, op9_ngram_jaccard_links
from scenelake.llm.oracles import ORACLES
from scenelake.llm.phrases import op11_phrases
from scenelake.llm.quality import op10_quality_listed, op10_quality_rules
from scenelake.llm.secrets import op3_secret_scans
from scenelake.llm.toxicity import op7_toxicity
from scenelake.llm.urls import op8_url_filters
from scenelake.llm.vectors import op5_exact_top_k
from scenelake.llm.warc import op4_warc
from scenelake.llm.whitening import op12_whitening

__all__ = ["ORACLES", "QUERIES"]

QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_mixing": op2_mixing,
    "op3_secret_scans": op3_secret_scans,
    "op4_warc": op4_warc,
    "op5_exact_top_k": op5_exact_top_k,
    "op6_language_id": op6_language_id,
    "op7_toxicity": op7_toxicity,
    "op8_url_filters": op8_url_filters,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op9_ngram_jaccard_links": op9_ngram_jaccard_links,
    "op10_quality_rules": op10_quality_rules,
    "op10_quality_listed": op10_quality_listed,
    "op11_phrases": op11_phrases,
    "op12_whitening": op12_whitening,
    "op13_bytenet": op13_bytenet,
}
