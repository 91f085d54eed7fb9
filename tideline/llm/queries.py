"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from tideline.llm.embeddings import OP9_SQL, op9_embedding_near_dedup
from tideline.llm.exact_dedup import OP12_SQL, op12_exact_dedup
from tideline.llm.language_model import op7_lm_scoring
from tideline.llm.line_dedup import OP2_SQL, op2_line_dedup
from tideline.llm.mixing import op1_source_mixing
from tideline.llm.packing import op3_best_fit_packing
from tideline.llm.periodic_runs import op11_periodic_runs
from tideline.llm.personal_data import op5_personal_data
from tideline.llm.quality import op10_quality_rules
from tideline.llm.simhash import op8_simhash_near_dedup
from tideline.llm.suffix_dedup import op4_suffix_array_dedup
from tideline.llm.toxicity import op6_toxicity
from tideline.llm.whitening import op13_embedding_whitening

QUERIES = {
    "op1_source_mixing": op1_source_mixing,
    "op2_line_dedup": op2_line_dedup,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_personal_data": op5_personal_data,
    "op6_toxicity": op6_toxicity,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_embedding_near_dedup": op9_embedding_near_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_embedding_whitening": op13_embedding_whitening,
}

ORACLES = {
    "op2_line_dedup": OP2_SQL,
    "op9_embedding_near_dedup": OP9_SQL,
    "op12_exact_dedup": OP12_SQL,
}
