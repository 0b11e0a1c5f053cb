"""The queries of this subpackage by name, and the SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from tracewright.llm.byte_bpe import op4_byte_bpe
from tracewright.llm.line_dedup import SQL_OP9, op9_line_dedup
from tracewright.llm.max_score import SQL_OP5, op5_max_score
from tracewright.llm.near_dedup import SQL_OP8, op8_near_dedup
from tracewright.llm.packing import op10_packing
from tracewright.llm.piece_bpe import op13_piece_bpe
from tracewright.llm.pii import op2_pii
from tracewright.llm.quality_model import op3_quality_model
from tracewright.llm.quality_rules import SQL_OP6, op6_quality_rules
from tracewright.llm.suffix_dedup import SQL_OP1, op1_suffix_dedup
from tracewright.llm.token_alignment import op11_token_alignment
from tracewright.llm.token_counts import op7_token_counts
from tracewright.llm.whitening import op12_whitening


def queries() -> dict:
    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_pii": op2_pii,
        "op3_quality_model": op3_quality_model,
        "op4_byte_bpe": op4_byte_bpe,
        "op5_max_score": op5_max_score,
        "op6_quality_rules": op6_quality_rules,
        "op7_token_counts": op7_token_counts,
        "op8_near_dedup": op8_near_dedup,
        "op9_line_dedup": op9_line_dedup,
        "op10_packing": op10_packing,
        "op11_token_alignment": op11_token_alignment,
        "op12_whitening": op12_whitening,
        "op13_piece_bpe": op13_piece_bpe,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_dedup": SQL_OP1, "op5_max_score": SQL_OP5, "op6_quality_rules": SQL_OP6, "op8_near_dedup": SQL_OP8, "op9_line_dedup": SQL_OP9}
