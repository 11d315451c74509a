"""Queries of the text operators, as __spark_entry__ registers them."""

from __future__ import annotations

from parley.llm import oracles
from parley.llm.decontaminate import op1_winnowing
from parley.llm.importance import op12_importance_resampling
from parley.llm.langid import op8_language
from parley.llm.langmodel import op9_maximum_entropy
from parley.llm.lines import op7_line_labels
from parley.llm.mixing import op13_systematic_mixing
from parley.llm.nearjoin import op4_jaccard_join
from parley.llm.pack import op2_vector_packing
from parley.llm.periodic import op11_periodic_runs
from parley.llm.quality import op6_quality
from parley.llm.substrings import op5_suffix_array
from parley.llm.toxicity import op10_toxicity
from parley.llm.units import op3_line_hashing


def queries():
    from corpus_pipeline import run

    return {
        "op1_winnowing": op1_winnowing,
        "op2_vector_packing": op2_vector_packing,
        "op3_line_hashing": op3_line_hashing,
        "op4_jaccard_join": op4_jaccard_join,
        "op5_suffix_array": op5_suffix_array,
        "op6_quality": op6_quality,
        "op7_line_labels": op7_line_labels,
        "op8_language": op8_language,
        "op9_maximum_entropy": op9_maximum_entropy,
        "op10_toxicity": op10_toxicity,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_importance_resampling": op12_importance_resampling,
        "op13_systematic_mixing": op13_systematic_mixing,
        "pipeline": run,
    }


def oracle_sql():
    from corpus_pipeline import ORACLE_SQL

    return oracles.SQL | ({"pipeline": ORACLE_SQL} if ORACLE_SQL else {})
