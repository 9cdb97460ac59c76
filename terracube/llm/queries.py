"""Names and SQL of the subpackage's queries."""

from __future__ import annotations

from .exact_dedup import OP9_SQL, op9_exact_dedup
from .hard_negatives import OP11_SQL, op11_hard_negatives
from .html_text import op6_html_text
from .line_dedup import OP2_SQL, op2_line_dedup
from .lm_score import op3_lm_score
from .mixing import op8_mix_sources
from .near_dedup import op1_near_dedup
from .packing import op10_mixture_packing
from .pii import op5_pii
from .quality import op4_quality
from .secret_scan import OP12_SQL, op12_secret_scan
from .top_k import OP7_SQL, op7_top_k
from .whitening import op13_whitening

QUERIES = {
    "op3_lm_score": op3_lm_score,
    "op1_near_dedup": op1_near_dedup,
    "op4_quality": op4_quality,
    "op6_html_text": op6_html_text,
    "op5_pii": op5_pii,
    "op7_top_k": op7_top_k,
    "op10_mixture_packing": op10_mixture_packing,
    "op8_mix_sources": op8_mix_sources,
    "op2_line_dedup": op2_line_dedup,
    "op9_exact_dedup": op9_exact_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_secret_scan": op12_secret_scan,
    "op13_whitening": op13_whitening,
}

SQL = {
    "op7_top_k": OP7_SQL,
    "op2_line_dedup": OP2_SQL,
    "op9_exact_dedup": OP9_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op12_secret_scan": OP12_SQL,
}
