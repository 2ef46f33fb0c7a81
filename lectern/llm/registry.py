"""Queries of the training-data operators and the SQL equal to them where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import bpe_counts, decontaminate, exact_dedup, html_text, knn_quality, lbl_scoring, lexical_search, line_dedup, minhash_dedup, mixing, sharding, toxicity, window_panes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_dedup": minhash_dedup.op1_minhash_dedup,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_quality": knn_quality.op4_quality,
    "op5_lm_scoring": lbl_scoring.op5_lm_scoring,
    "op6_mixing": mixing.op6_mixing,
    "op7_sharding": sharding.op7_sharding,
    "op8_html_text": html_text.op8_html_text,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_token_counts": bpe_counts.op11_token_counts,
    "op12_lexical_search": lexical_search.op12_lexical_search,
    "op13_window_panes": window_panes.op13_window_panes,
}

SQL: dict[str, str] = {"op3_exact_dedup": exact_dedup.SQL, "op6_mixing": mixing.SQL, "op7_sharding": sharding.SQL, "op12_lexical_search": lexical_search.SQL, "op13_window_panes": window_panes.SQL}
