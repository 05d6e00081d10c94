"""Registers one query for each training-data operator."""

from __future__ import annotations

from .decontaminate import op8_decontamination
from .html_extract import op7_html_extraction
from .license_scan import op1_license_scan
from .line_dedup import op6_line_dedup
from .quality import op9_quality_rules
from .sentencepiece_fst import op3_sentencepiece
from .sharding import op10_sharding
from .simhash import op5_simhash_near_dedup
from .token_binary import op2_token_binary
from .toxicity import op4_toxicity

QUERIES = {f.__name__: f for f in (op1_license_scan, op2_token_binary, op3_sentencepiece, op4_toxicity, op5_simhash_near_dedup, op6_line_dedup, op7_html_extraction, op8_decontamination, op9_quality_rules, op10_sharding)}
ORACLES: dict[str, str] = {}
