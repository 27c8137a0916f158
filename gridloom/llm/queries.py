"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from . import tiered, topk
from .automaton import op12_tokenization_automaton
from .jaccard import op3_heavy_light_jaccard_join
from .langid import op10_crf_language_id
from .mixing import op8_multinomial_block_mixing
from .packing import op2_hilbert_curve_packing
from .periodic import op11_suffix_tree_runs
from .quality import op7_line_first_cleaning
from .secretscan import op9_entropy_secret_scan
from .sharding import op1_min_cost_flow_resharding
from .suffix import op4_prefix_doubling_dedup
from .tokencount import op6_token_length_histogram

QUERIES = {
    "op1_min_cost_flow_resharding": op1_min_cost_flow_resharding,
    "op2_hilbert_curve_packing": op2_hilbert_curve_packing,
    "op3_heavy_light_jaccard_join": op3_heavy_light_jaccard_join,
    "op4_prefix_doubling_dedup": op4_prefix_doubling_dedup,
    "op5_threshold_top_k": topk.op5_threshold_top_k,
    "op6_token_length_histogram": op6_token_length_histogram,
    "op7_line_first_cleaning": op7_line_first_cleaning,
    "op8_multinomial_block_mixing": op8_multinomial_block_mixing,
    "op9_entropy_secret_scan": op9_entropy_secret_scan,
    "op10_crf_language_id": op10_crf_language_id,
    "op11_suffix_tree_runs": op11_suffix_tree_runs,
    "op12_tokenization_automaton": op12_tokenization_automaton,
    "op13_tiered_index_search": tiered.op13_tiered_index_search,
}

ORACLE_SQL: dict[str, str] = {"op5_threshold_top_k": topk.SQL, "op13_tiered_index_search": tiered.SQL}
