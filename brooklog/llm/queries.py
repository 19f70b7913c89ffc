"""The queries of this subpackage: name -> function of (spark, sf_dir)."""

from __future__ import annotations

from brooklog.llm.ann import op8_ann
from brooklog.llm.decontamination import ORACLE, op2_decontamination
from brooklog.llm.html_text import op4_html_text
from brooklog.llm.language_id import op3_language_id
from brooklog.llm.packing import op6_packing
from brooklog.llm.pii import op1_pii
from brooklog.llm.shared import read_table
from brooklog.llm.sharding import op5_sharding
from brooklog.llm.simhash import op9_simhash
from brooklog.llm.token_counts import op7_token_counts
from brooklog.llm.toxicity import op10_toxicity


def queries() -> dict:
    return {
        "op1_pii": lambda s, d: op1_pii(read_table(s, d, "documents")),
        "op2_decontamination": lambda s, d: op2_decontamination(read_table(s, d, "documents"), read_table(s, d, "benchmark")),
        "op3_language_id": lambda s, d: op3_language_id(read_table(s, d, "documents")),
        "op4_html_text": lambda s, d: op4_html_text(read_table(s, d, "pages")),
        "op5_sharding": lambda s, d: op5_sharding(read_table(s, d, "documents")),
        "op6_packing": lambda s, d: op6_packing(read_table(s, d, "documents")),
        "op7_token_counts": lambda s, d: op7_token_counts(read_table(s, d, "documents")),
        "op8_ann": lambda s, d: op8_ann(read_table(s, d, "embeddings")),
        "op9_simhash": lambda s, d: op9_simhash(read_table(s, d, "documents")),
        "op10_toxicity": lambda s, d: op10_toxicity(read_table(s, d, "documents"), read_table(s, d, "labels")),
    }


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that DuckDB can express."""
    return {"op2_decontamination": ORACLE}
