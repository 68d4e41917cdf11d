"""The queries of the training-data operators and their SQL, by name."""

from __future__ import annotations

from .bpe import op1_bpe
from .decontaminate import op6_decontaminate
from .html import op2_html
from .jaccard import op9_jaccard
from .licenses import OP5_SQL, op5_licenses
from .maxent import op8_maxent
from .ogg import op3_ogg
from .quality import op10_quality
from .suffixes import op7_suffixes
from .toxicity import op4_toxicity

QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_html": op2_html,
    "op3_ogg": op3_ogg,
    "op4_toxicity": op4_toxicity,
    "op5_licenses": op5_licenses,
    "op6_decontaminate": op6_decontaminate,
    "op7_suffixes": op7_suffixes,
    "op8_maxent": op8_maxent,
    "op9_jaccard": op9_jaccard,
    "op10_quality": op10_quality,
}
SQL: dict[str, str] = {"op5_licenses": OP5_SQL}
