"""Queries and SQL of this subpackage, by the driver's contract."""

from __future__ import annotations

import corpus_pipeline
from proofmill.llm.binary import op6_binary_output
from proofmill.llm.decontamination import OP13_SQL, op13_decontamination
from proofmill.llm.divergence import OP12_SQL, op12_divergence
from proofmill.llm.importance import OP11_SQL, op11_importance
from proofmill.llm.line_dedup import OP5_SQL, op5_line_dedup
from proofmill.llm.mixing import op4_mixing
from proofmill.llm.near_join import op9_ngram_jaccard_join
from proofmill.llm.neighbours import op10_nearest_neighbours
from proofmill.llm.packing import op3_packing
from proofmill.llm.quality_classifier import op7_quality_classifier
from proofmill.llm.quality_rules import op2_quality_rules
from proofmill.llm.substring_dedup import op1_substring_dedup
from proofmill.llm.toxicity import op8_toxicity

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_packing": op3_packing,
    "op4_mixing": op4_mixing,
    "op5_line_dedup": op5_line_dedup,
    "op6_binary_output": op6_binary_output,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_toxicity": op8_toxicity,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_nearest_neighbours": op10_nearest_neighbours,
    "op11_importance": op11_importance,
    "op12_divergence": op12_divergence,
    "op13_decontamination": op13_decontamination,
    "pipeline": corpus_pipeline.run,
}
SQL: dict[str, str] = {"op5_line_dedup": OP5_SQL, "op11_importance": OP11_SQL, "op12_divergence": OP12_SQL, "op13_decontamination": OP13_SQL}
