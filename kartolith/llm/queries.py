"""The registered corpus queries and, where SQL can express them, their oracle SQL."""

from __future__ import annotations

from . import oracles
from .decontamination import op3_decontamination
from .exact_dedup import op2_exact_dedup
from .html_extraction import op4_html_extraction
from .language_id import op7_language_id
from .line_dedup import op6_line_dedup
from .near_dedup import op10_near_dedup
from .packing import op5_packing
from .substring_dedup import op1_substring_dedup
from .suffix_dedup import op8_suffix_dedup
from .warc import op9_warc_fixity

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_html_extraction": op4_html_extraction,
    "op5_packing": op5_packing,
    "op6_line_dedup": op6_line_dedup,
    "op7_language_id": op7_language_id,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_warc_fixity": op9_warc_fixity,
    "op10_near_dedup": op10_near_dedup,
}

ORACLE_SQL = {
    "op1_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op2_exact_dedup": oracles.EXACT_DEDUP,
    "op3_decontamination": oracles.DECONTAMINATION,
    "op6_line_dedup": oracles.LINE_DEDUP,
    "op8_suffix_dedup": oracles.SUFFIX_DEDUP,
    "op9_warc_fixity": oracles.WARC_FIXITY,
    "op10_near_dedup": oracles.NEAR_DEDUP,
}
