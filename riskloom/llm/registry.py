"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from .bpe import op1_byte_bpe
from . import warc
from .chat import op5_chat_format
from .decontam import op6_decontaminate
from .mih import op8_multi_index_hashing
from .minhash import op2_minhash
from . import mixing, phrases, repair
from .pst import op4_suffix_tree_score
from .quality import op7_quality
from .suffix import op10_suffix_dedup
from .toxicity import op9_toxicity

QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_minhash, warc.op3_warc, op4_suffix_tree_score, op5_chat_format, op6_decontaminate, op7_quality, op8_multi_index_hashing, op9_toxicity, op10_suffix_dedup, mixing.op11_mix, repair.op12_repair, phrases.op13_phrases)}
ORACLE_SQL: dict[str, str] = {"op3_warc": warc.ORACLE, "op11_mix": mixing.ORACLE, "op13_phrases": phrases.ORACLE}
