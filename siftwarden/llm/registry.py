"""The queries of this subpackage and the SQL that some of them can be held against."""

from __future__ import annotations

from . import decontam, divergence, html_text, language, line_dedup, mixing, neardup, quality, scoring, sharding, toxicity, vectors, whitening

QUERIES = {"op7_html": html_text.op7_html, "op8_toxicity": toxicity.op8_toxicity, "op3_neardup": neardup.op3_neardup, "op1_decontamination": decontam.op1_decontamination, "op6_scoring": scoring.op6_scoring, "op9_language": language.op9_language, "op2_quality": quality.op2_quality, "op4_mixing": mixing.op4_mixing, "op5_line_dedup": line_dedup.op5_line_dedup, "op10_sharding": sharding.op10_sharding, "op11_whitening": whitening.op11_whitening, "op12_divergence": divergence.op12_divergence, "op13_vectors": vectors.op13_vectors}
ORACLES = {"op1_decontamination": decontam.ORACLE, "op3_neardup": neardup.ORACLE, "op5_line_dedup": line_dedup.ORACLE, "op12_divergence": divergence.ORACLE}
