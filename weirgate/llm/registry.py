"""The queries of this subpackage by name, with their SQL."""

from corpus_pipeline import run

from .exact_dedup import OP6_SQL, op6_exact_dedup
from .html_text import op9_html_text
from .language_id import op10_language_id
from .lm_score import op3_lm_score
from .mixing import OP8_SQL, op8_mix_sources
from .near_dedup import op2_near_dedup
from .packing import op4_best_fit_packing
from .quality import op5_quality_rules
from .runs import op13_periodic_runs
from .token_files import op1_token_files
from .suffix_dedup import op11_repeated_passages
from .warc import op7_warc
from .whitening import op12_whitening

QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_near_dedup": op2_near_dedup,
    "op3_lm_score": op3_lm_score,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_quality_rules": op5_quality_rules,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_warc": op7_warc,
    "op8_mix_sources": op8_mix_sources,
    "op9_html_text": op9_html_text,
    "op10_language_id": op10_language_id,
    "op11_repeated_passages": op11_repeated_passages,
    "op12_whitening": op12_whitening,
    "op13_periodic_runs": op13_periodic_runs,
    "pipeline": run,
}
ORACLES = {
    "op6_exact_dedup": OP6_SQL,
    "op8_mix_sources": OP8_SQL,
}
