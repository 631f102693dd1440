"""Registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from allotau.llm.ann_search import op7_ann_search
from allotau.llm.exact_topk import OP3_SQL, op3_exact_topk
from allotau.llm.html_extract import op2_html_extraction
from allotau.llm.language_id import op8_language_id
from allotau.llm.mixing import op10_mixing
from allotau.llm.near_dedup import op9_near_dedup
from allotau.llm.packing import op1_best_fit_packing
from allotau.llm.prefix_trie import OP13_SQL, op13_prefix_trie
from allotau.llm.repair import OP11_SQL, op11_conversation_repair
from allotau.llm.secrets import op6_secret_scan
from allotau.llm.sharding import op4_sharding
from allotau.llm.token_counts import op12_token_counts
from allotau.llm.toxicity import op5_toxicity

QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_html_extraction": op2_html_extraction,
    "op3_exact_topk": op3_exact_topk,
    "op4_sharding": op4_sharding,
    "op5_toxicity": op5_toxicity,
    "op6_secret_scan": op6_secret_scan,
    "op7_ann_search": op7_ann_search,
    "op8_language_id": op8_language_id,
    "op9_near_dedup": op9_near_dedup,
    "op10_mixing": op10_mixing,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_token_counts": op12_token_counts,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {"op3_exact_topk": OP3_SQL, "op11_conversation_repair": OP11_SQL, "op13_prefix_trie": OP13_SQL}
