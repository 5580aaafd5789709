"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from tidewater.llm.ball_kmeans import op11_ball_kmeans
from tidewater.llm.brown_lm import op4_brown
from tidewater.llm.chat_format import op12_chat_format
from tidewater.llm.embedding_ego import op9_embeddings
from tidewater.llm.jaccard_orders import op2_jaccard
from tidewater.llm.language_crf import op1_language
from tidewater.llm.mix_schedule import op5_mix
from tidewater.llm.oracle import ORACLE
from tidewater.llm.pack_complement import op7_pack
from tidewater.llm.phrase_hash import op13_phrase_hash
from tidewater.llm.pii_skipcrf import op6_pii
from tidewater.llm.quality_table import op10_quality
from tidewater.llm.substring_automata import op8_substrings
from tidewater.llm.toxicity_kn import op3_toxicity


def queries() -> dict:
    return {
        "op1_language": op1_language,
        "op2_jaccard": op2_jaccard,
        "op3_toxicity": op3_toxicity,
        "op4_brown": op4_brown,
        "op5_mix": op5_mix,
        "op6_pii": op6_pii,
        "op7_pack": op7_pack,
        "op8_substrings": op8_substrings,
        "op9_embeddings": op9_embeddings,
        "op10_quality": op10_quality,
        "op11_ball_kmeans": op11_ball_kmeans,
        "op12_chat_format": op12_chat_format,
        "op13_phrase_hash": op13_phrase_hash,
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
