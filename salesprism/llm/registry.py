"""The subpackage's queries and the SQL they are compared with."""

import corpus_pipeline

from salesprism.llm.collocations import OP11_SQL, op11_collocations
from salesprism.llm.decontaminate import op3_decontaminate
from salesprism.llm.exact_dedup import OP12_SQL, op12_exact_dedup
from salesprism.llm.html_text import op5_main_text
from salesprism.llm.line_dedup import OP10_SQL, op10_line_dedup
from salesprism.llm.packing import op7_best_fit_packing
from salesprism.llm.quality import op9_quality_rules
from salesprism.llm.simhash import op8_simhash
from salesprism.llm.substring_dedup import op2_substring_dedup
from salesprism.llm.suffix_dedup import op1_suffix_array_dedup
from salesprism.llm.token_counts import op4_token_counts
from salesprism.llm.warc import op6_warc
from salesprism.llm.whitening import op13_whitening

QUERIES = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_decontaminate": op3_decontaminate,
    "op4_token_counts": op4_token_counts,
    "op5_main_text": op5_main_text,
    "op6_warc": op6_warc,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_simhash": op8_simhash,
    "op9_quality_rules": op9_quality_rules,
    "op10_line_dedup": op10_line_dedup,
    "op11_collocations": op11_collocations,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_whitening": op13_whitening,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {"op10_line_dedup": OP10_SQL, "op11_collocations": OP11_SQL, "op12_exact_dedup": OP12_SQL}
