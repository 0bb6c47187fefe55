"""The operators' queries over their whole tables, and SQL where it can express them."""

from __future__ import annotations

from .decontamination import op10_decontamination
from .jaccard import op2_ngram_jaccard
from .language_model import op5_language_model
from .media import op1_media
from .mixing import op8_mixing
from .quality import op9_quality
from .suffixes import op7_suffix_dedup
from .tokens import op6_token_ids
from .toxicity import op4_toxicity
from .urls import OP3_SQL, op3_url_filters

QUERIES = {
    "op1_media": op1_media,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_url_filters": op3_url_filters,
    "op4_toxicity": op4_toxicity,
    "op5_language_model": op5_language_model,
    "op6_token_ids": op6_token_ids,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_mixing": op8_mixing,
    "op9_quality": op9_quality,
    "op10_decontamination": op10_decontamination,
}
ORACLE_SQL = {"op3_url_filters": OP3_SQL}
