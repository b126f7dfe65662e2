"""Queries of this subpackage and their SQL, for __spark_entry__."""

from __future__ import annotations

from .bpe import op11_forced_bpe
from .divergence import OP13_SQL, op13_source_divergence
from .language import op9_language_mixture
from .mixing import OP2_SQL, op2_mixing
from .negatives import OP12_SQL, op12_hard_negatives
from .neardup import op7_near_duplicates
from .pieces import op1_sentencepiece
from .pitman_yor import op3_pitman_yor
from .quality import op6_quality
from .substring import op5_substring_dedup
from .tiff import op10_tiff_pages
from .token_files import op4_token_files
from .toxicity import op8_toxicity

QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_mixing": op2_mixing,
    "op3_pitman_yor": op3_pitman_yor,
    "op4_token_files": op4_token_files,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_quality": op6_quality,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_toxicity": op8_toxicity,
    "op9_language_mixture": op9_language_mixture,
    "op10_tiff_pages": op10_tiff_pages,
    "op11_forced_bpe": op11_forced_bpe,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_source_divergence": op13_source_divergence,
}

SQL: dict[str, str] = {"op2_mixing": OP2_SQL, "op12_hard_negatives": OP12_SQL, "op13_source_divergence": OP13_SQL}
