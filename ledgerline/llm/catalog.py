"""The queries of this folder, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from .chat import op2_chat_format
from .embedding import op5_embedding_near_dedup
from .html import op9_html_extract
from .language import op8_language_id
from .license import op7_license_scan
from .license import oracle as license_oracle
from .mixing import op3_mix_sources
from .ngram import op1_ngram_jaccard
from .packing import op4_pack_sequences
from .quality import op6_quality_rules
from .substring import op10_substring_dedup

QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard,
        op2_chat_format,
        op3_mix_sources,
        op4_pack_sequences,
        op5_embedding_near_dedup,
        op6_quality_rules,
        op7_license_scan,
        op8_language_id,
        op9_html_extract,
        op10_substring_dedup,
    )
}
ORACLES: dict[str, str] = {"op7_license_scan": license_oracle()}
