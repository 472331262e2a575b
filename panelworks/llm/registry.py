"""The subpackage's queries for ``__spark_entry__``."""

from __future__ import annotations

from panelworks.llm.language_id import op4_language_id
from panelworks.llm.line_dedup import op8_line_dedup
from panelworks.llm.mixing import op6_mixing
from panelworks.llm.near_dedup import op7_near_dedup
from panelworks.llm.piece_encoding import op9_piece_encoding
from panelworks.llm.quality_classifier import op3_quality_classifier
from panelworks.llm.quality_rules import op2_quality_rules
from panelworks.llm.suffix_dedup import op5_suffix_dedup
from panelworks.llm.toxicity import op10_toxicity
from panelworks.llm import hard_negatives, oracles, top_k, vector_codes
from panelworks.llm.hard_negatives import op12_hard_negatives
from panelworks.llm.sharding import op11_sharding
from panelworks.llm.top_k import op1_top_k
from panelworks.llm.vector_codes import op13_vector_codes

QUERIES = {f.__name__: f for f in (op1_top_k, op2_quality_rules, op3_quality_classifier, op4_language_id, op5_suffix_dedup, op6_mixing, op7_near_dedup, op8_line_dedup, op9_piece_encoding, op10_toxicity, op11_sharding, op12_hard_negatives, op13_vector_codes)}
ORACLE_SQL: dict[str, str] = {"op1_top_k": top_k.ORACLE, "op2_quality_rules": oracles.QUALITY_RULES, "op7_near_dedup": oracles.NEAR_DEDUP, "op12_hard_negatives": hard_negatives.ORACLE, "op13_vector_codes": vector_codes.ORACLE}
