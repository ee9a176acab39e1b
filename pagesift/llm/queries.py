"""Queries of the corpus operators and their DuckDB SQL, for ``__spark_entry__``."""

from __future__ import annotations

from pagesift.llm.byte_bpe import op11_byte_bpe
from pagesift.llm.chat import CHAT_SQL, op10_chat_formatting
from pagesift.llm.edit_counts import op3_token_counts
from pagesift.llm.exact_dedup import EXACT_DEDUP_SQL, op5_exact_dedup
from pagesift.llm.lexical_search import LEXICAL_SEARCH_SQL, op13_lexical_search
from pagesift.llm.license_scan import op2_license_scans
from pagesift.llm.line_crf import op4_quality_rules
from pagesift.llm.mixing import op9_mixing
from pagesift.llm.ngram_join import op7_ngram_jaccard_join
from pagesift.llm.packing import op1_packing
from pagesift.llm.pii_surrogates import op8_pii
from pagesift.llm.quality_fm import op6_quality_classifier
from pagesift.llm.whitening import op12_whitening

QUERIES = {f.__name__: f for f in (
    op1_packing, op2_license_scans, op3_token_counts, op4_quality_rules, op5_exact_dedup, op6_quality_classifier,
    op7_ngram_jaccard_join, op8_pii, op9_mixing, op10_chat_formatting,
    op11_byte_bpe, op12_whitening, op13_lexical_search,
)}
ORACLE_SQL = {
    "op5_exact_dedup": EXACT_DEDUP_SQL,
    "op10_chat_formatting": CHAT_SQL,
    "op13_lexical_search": LEXICAL_SEARCH_SQL,
}
