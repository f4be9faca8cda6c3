"""Registry of the training-data queries."""

from .byte_bpe import op3_byte_bpe
from .decontaminate import SQL_OP6, op6_decontamination
from .html_text import op2_html_extraction
from .jaccard_join import SQL_OP9, op9_jaccard_join
from .licence import op4_licence_scan
from .line_dedup import SQL_OP1, op1_line_dedup
from .lm_score import op7_lm_score
from .pii import op8_pii
from .quality import op10_quality_rules
from .suffix_dedup import op5_suffix_dedup

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_html_extraction": op2_html_extraction,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_licence_scan": op4_licence_scan,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_lm_score": op7_lm_score,
    "op8_pii": op8_pii,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_quality_rules": op10_quality_rules,
}
ORACLE = {
    "op1_line_dedup": SQL_OP1,
    "op6_decontamination": SQL_OP6,
    "op9_jaccard_join": SQL_OP9,
}
