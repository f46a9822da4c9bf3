"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from .fingerprint import op10_document_fingerprints
from .html_text import op6_html_main_text
from .lang_id import op7_language_id
from .license_scan import OP4_SQL, op4_license_scan
from .line_dedup import op8_line_dedup
from .ngram_join import op3_ngram_jaccard_join
from .packing import op5_retrieval_packing
from .pii import op9_pii_surrogates
from .quality import OP2_SQL, op2_quality_line_frequency
from .sentencepiece_nbest import op1_sentencepiece_nbest

QUERIES = {
    "op1_sentencepiece_nbest": op1_sentencepiece_nbest,
    "op2_quality_line_frequency": op2_quality_line_frequency,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_license_scan": op4_license_scan,
    "op5_retrieval_packing": op5_retrieval_packing,
    "op6_html_main_text": op6_html_main_text,
    "op7_language_id": op7_language_id,
    "op8_line_dedup": op8_line_dedup,
    "op9_pii_surrogates": op9_pii_surrogates,
    "op10_document_fingerprints": op10_document_fingerprints,
}
SQL = {"op2_quality_line_frequency": OP2_SQL, "op4_license_scan": OP4_SQL}
