"""The queries of this subpackage."""

from __future__ import annotations

from redactlake.llm.binary_output import op10_binary_output
from redactlake.llm.bpe import op2_byte_bpe
from redactlake.llm.decontaminate import op3_decontamination
from redactlake.llm.divergence import OP11_SQL, op11_source_divergence
from redactlake.llm.html_tree import op12_html
from redactlake.llm.language import op8_language
from redactlake.llm.licences import OP9_SQL, op9_licences
from redactlake.llm.lm_score import op1_lm_score
from redactlake.llm.nearest import OP7_SQL, op7_nearest
from redactlake.llm.resample import OP13_SQL, op13_resample
from redactlake.llm.sharding import op5_sharding
from redactlake.llm.simhash import op6_simhash
from redactlake.llm.suffix_dedup import op4_suffix_dedup

QUERIES = {
    "op1_lm_score": op1_lm_score, "op2_byte_bpe": op2_byte_bpe, "op3_decontamination": op3_decontamination, "op4_suffix_dedup": op4_suffix_dedup, "op5_sharding": op5_sharding, "op6_simhash": op6_simhash,
    "op7_nearest": op7_nearest, "op8_language": op8_language, "op9_licences": op9_licences, "op10_binary_output": op10_binary_output,
    "op11_source_divergence": op11_source_divergence, "op12_html": op12_html, "op13_resample": op13_resample,
}
ORACLE_SQL: dict[str, str] = {"op7_nearest": OP7_SQL, "op9_licences": OP9_SQL, "op11_source_divergence": OP11_SQL, "op13_resample": OP13_SQL}
