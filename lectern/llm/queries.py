"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from lectern.llm.bpe import op7_bpe
from lectern.llm.fingerprint import op4_fingerprints
from lectern.llm.jaccard import SQL_OP1, op1_jaccard
from lectern.llm.language import op6_language
from lectern.llm.licences import op3_licences
from lectern.llm.packing import op5_packing
from lectern.llm.quality import op2_quality
from lectern.llm.substring import SQL_OP9, op9_substring
from lectern.llm.topk import SQL_OP10, op10_top_k
from lectern.llm.url_filter import op8_url_filter

QUERIES = {f.__name__: f for f in (op1_jaccard, op2_quality, op3_licences, op4_fingerprints, op5_packing, op6_language, op7_bpe, op8_url_filter, op9_substring, op10_top_k)}
SQL = {"op1_jaccard": SQL_OP1, "op9_substring": SQL_OP9, "op10_top_k": SQL_OP10}
