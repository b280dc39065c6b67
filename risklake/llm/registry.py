"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from risklake.llm.alignment import op13
from risklake.llm.chat import OP1_SQL, op1
from risklake.llm.decontaminate import OP4_SQL, op4
from risklake.llm.licenses import op6
from risklake.llm.lines import op7
from risklake.llm.mixing import op8
from risklake.llm.quality import OP3_SQL, op3
from risklake.llm.sharding import op5
from risklake.llm.simhash import op2
from risklake.llm.spelling import OP12_SQL, op12
from risklake.llm.substring import OP9_SQL, op9
from risklake.llm.topk import OP11_SQL, op11
from risklake.llm.toxicity import op10

QUERIES = {"op1_prefix_target": op1, "op2_golay_simhash": op2, "op3_rule_ledger": op3, "op4_ngram_broadcast": op4, "op5_virtual_slots": op5, "op6_rare_token_index": op6, "op7_patience_lines": op7, "op8_sainte_lague": op8, "op9_relative_lz": op9, "op10_crf": op10}
QUERIES |= {"op11_uniform_threshold": op11, "op12_sorted_list_dp": op12, "op13_shared_cuts": op13}
ORACLES: dict[str, str] = {"op1_prefix_target": OP1_SQL, "op3_rule_ledger": OP3_SQL, "op4_ngram_broadcast": OP4_SQL, "op9_relative_lz": OP9_SQL, "op11_uniform_threshold": OP11_SQL, "op12_sorted_list_dp": OP12_SQL}
